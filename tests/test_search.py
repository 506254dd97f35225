import datetime
import decimal
import itertools
import re

import pytest
from pyspark.sql import functions as F

from hushlake import queries
from hushlake.errors import SealError
from hushlake.functions.keys import Keyring
from hushlake.functions.normalize import DIGITS, compact, normalize
from hushlake.operators.search import Budgets, Order, Sealed, SealedTable
from hushlake.plans import model as s
from hushlake.plans.predicate import Compiler, Leaf, Match, parse_like, pick_tokens, windows

ENGINE = Sealed(Keyring(bytes(range(32))))


def table(spark, path, registration, rows, schema):
    plain = spark.createDataFrame(rows, schema)
    ENGINE.seal_parent(plain, registration).write.parquet(f"{path}/parent")
    ENGINE.companion_of(plain, registration).write.parquet(f"{path}/companion")
    return SealedTable(registration, spark.read.parquet(f"{path}/parent"), spark.read.parquet(f"{path}/companion"))


def code_of(run):
    with pytest.raises(SealError) as e:
        run()
    return e.value.code


def like(value, pattern):
    """SQL LIKE over compact text: the plain meaning, by regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(compact(pattern[i]))
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(compact(c))
        i += 1
    return re.fullmatch(out, compact(value), re.DOTALL) is not None


PATTERNS = ["%ab%", "ab%", "%ba", "ab", "%ab%ba%", "ab%ba", "%aa%aa%", "aa%aa", "_ab%", "%ab_", "__ab", "%ab_ba%", "ab_ba", "%aab%ba_aa", "%_ab_%", "ab%_", "_%ab", "%ab%ab%ab%", "abab%", "%bb%_", "ab%_%ba", "%ba_%", "%AB%", "% a b %", "aba", "%abb_", "_aba%", "%aaaa%"]


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    values = ["".join(x) for n in range(1, 7) for x in itertools.product("ab", repeat=n)]
    values += ["", "가나😀다라", "ab%cd", "ab％cd", "ab_cd", "ab\\cd", "a b\tab", "ABBA", "ab" * 2001, "ab" * 500 + "bb" + "ab" * 500, "x" + "ba" * 30]
    r = s.Registration("words", "id", {"w": s.text(search={"exact": True, "substring": True}, nullable=True), "h": s.text(search={"exact": True, "substring": {"skip_grams": False}}, hardened=True, nullable=True)})
    rows = [(str(i), v, v) for i, v in enumerate(values)] + [("null", None, None)]
    return table(spark, str(tmp_path_factory.mktemp("words")), r, rows, "id string, w string, h string"), {i: v for i, v, _ in rows}


def found(t, match, **options):
    return sorted(r["id"] for r in ENGINE.where(t, match, **options).select("id").collect())


def test_like_equals_plain_like_everywhere(words):
    t, values = words
    more = ["%가나%다라", "가나_다라", "%😀다%", r"%b\%c%", r"ab\_cd", r"%b\\c%", "%ab％cd", "%bb%ab%", "ab%bb%ab"]
    columns = [c.alias(f"{kind}{i}") for i, p in enumerate(PATTERNS + more) for kind, c in (("w", ENGINE.condition(t.registration, lambda m, p=p: m.w.like(p))), ("h", ENGINE.condition(t.registration, lambda m, p=p: m.h.like(p))))]
    for part in (columns[i : i + 12] for i in range(0, len(columns), 12)):
        for r in t.companion.select("row_id", *part).collect():
            for name, got in r.asDict().items():
                if name != "row_id":
                    p = (PATTERNS + more)[int(name[1:])]
                    assert bool(got) == like(values[r.row_id], p), (values[r.row_id][:40], p, name)


def test_positions(words):
    t, values = words
    for term in ("ab", "abba", "aab", "AA a", "bbabb", "나😀", "ababababab"):
        c = compact(term)
        for op, plain in (("contains", lambda v, c=c: c in v), ("starts_with", lambda v, c=c: v.startswith(c)), ("ends_with", lambda v, c=c: v.endswith(c))):
            want = sorted(i for i, v in values.items() if v is not None and plain(compact(v)))
            for field in ("w", "h"):
                assert found(t, lambda m, op=op, field=field, term=term: getattr(m[field], op)(term)) == want
    for term in ("", "a", "ABBA", "ab%cd"):
        want = sorted(i for i, v in values.items() if v is not None and normalize(v) == normalize(term))
        assert found(t, lambda m, term=term: m.w.eq(term)) == found(t, lambda m, term=term: m.h.eq(term)) == want


def test_near_miss_is_found_in_linear_time(words):
    t, values = words
    want = sorted(i for i, v in values.items() if v and "abba" in compact(v))
    assert found(t, lambda m: m.w.contains("abba")) == want


def test_what_is_too_broad_or_not_offered(words):
    t, _ = words
    r = t.registration
    broad = [lambda m: m.w.contains("a"), lambda m: m.w.contains(" a "), lambda m: m.w.like("%"), lambda m: m.w.like("a%"), lambda m: m.w.like("ab%c"), lambda m: m.w.like("__"), lambda m: m.w.starts_with("")]
    assert {code_of(lambda f=f: ENGINE.where(t, f)) for f in broad} == {"QUERY_TOO_BROAD"}
    invalid = [lambda m: m.w.like("ab\\"), lambda m: m.w.like("a\\b"), lambda m: m.and_(), lambda m: m.or_(), lambda m: m.w.eq(5), lambda m: m.w.contains(None)]
    assert {code_of(lambda f=f: ENGINE.where(t, f)) for f in invalid} == {"INVALID_VALUE"}
    absent = [lambda m: m.nothing.eq("x"), lambda m: m.w.less_than("x"), lambda m: m.not_(m.w.eq("x"))]
    assert {code_of(lambda f=f: ENGINE.where(t, f)) for f in absent} == {"UNSUPPORTED_SEARCH"}
    only = s.Registration("m", "id", {"a": s.text(search={"exact": True}), "b": s.text(search={"substring": True}), "c": s.text()})
    for f in (lambda m: m.a.contains("xx"), lambda m: m.b.eq("xx"), lambda m: m.c.eq("x")):
        assert code_of(lambda f=f: f(Match(only))) == "UNSUPPORTED_SEARCH"


def test_patterns_and_windows():
    assert [p for p in (parse_like("%ab%_cd_%", "default").chunks)][1].literals == ((1, "cd"),)
    assert parse_like("ab%%cd", "default") == parse_like("a b%c d", "default")
    assert windows("abcd") == [(0, "ab"), (2, "cd")] and windows("abc") == [(0, "ab"), (1, "bc")] and windows("ab") == [(0, "ab")]
    assert pick_tokens([5, 1, 4, 2, 3]) == [1, 3, 5] and pick_tokens([2, 1, 2]) == [1, 2]


def test_tokens_never_miss(words):
    t, values = words
    p = t.registration.profile("w", "substring")
    for leaf in (Leaf("w", "contains", "abb"), Leaf("w", "starts_with", "aba"), Leaf("w", "ends_with", "bba"), Leaf("w", "like", "%ab%ba_")):
        tokens = Compiler(t.registration, ENGINE.ring, "_").tokens(leaf)
        proved = ENGINE.condition(t.registration, lambda m, leaf=leaf: getattr(m.w, leaf.op)(leaf.value))
        for r in t.companion.where(proved).select(f"tokens_{p.tag}").collect():
            assert set(tokens) <= set(r[0]) and list(r[0]) == sorted(set(r[0]))


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    r = s.Registration(
        "people", "id",
        {"name": s.text(search={"exact": True, "substring": True}), "age": s.integer(search={"exact": {"bits": 2}}, nullable=True), "pay": s.decimal(12, 2, search={"exact": True}, nullable=True),
         "big": s.bigint(search={"exact": True}, nullable=True), "phone": s.text(search={"exact": True, "normalizer": DIGITS}, nullable=True), "on": s.boolean(nullable=True), "at": s.instant(nullable=True)},
        scope="tenant", plain=("rank", "day"),
    )
    day = datetime.datetime(2024, 1, 1)
    rows = [(str(i), "ab"[i % 2], f"Person {i % 10} {i}", i % 7 if i % 5 else None, decimal.Decimal(i) / 4, decimal.Decimal(10**20 + i), f"+1 ({i:03d})", bool(i % 3), day + datetime.timedelta(milliseconds=i), i % 4 if i % 6 else None, day + datetime.timedelta(microseconds=i % 9)) for i in range(120)]
    return table(spark, str(tmp_path_factory.mktemp("people")), r, rows, "id string, tenant string, name string, age long, pay decimal(12,2), big decimal(38,0), phone string, on boolean, at timestamp, rank int, day timestamp"), rows


def test_exact_types_and_scopes(people):
    t, rows = people
    cases = [(lambda m: m.age.eq(3), lambda r: r[3] == 3), (lambda m: m.pay.eq("2.5"), lambda r: r[4] == decimal.Decimal("2.5")), (lambda m: m.big.eq(10**20 + 8), lambda r: r[5] == 10**20 + 8), (lambda m: m.phone.eq("1-(008)"), lambda r: r[0] == "8"), (lambda m: m.or_(m.age.eq(1), m.and_(m.name.contains("n3"), m.sql(F.col("rank") == 1))), lambda r: r[3] == 1 or "n3" in compact(r[2]).replace("perso", "") and r[9] == 1)]
    for match, plain in cases:
        for tenant in "ab":
            assert found(t, match, scope=tenant) == sorted(r[0] for r in rows if r[1] == tenant and plain(r))
            assert ENGINE.count(t, match, scope=tenant) == len(found(t, match, scope=tenant))
    assert ENGINE.count(t, scope="a") == 60 and ENGINE.count(t, lambda m: m.name.contains("son"), scope="zzz") == 0
    assert ENGINE.count(t, lambda m: m.name.contains("son"), scope="a", where=F.col("rank") == 1) == sum(r[1] == "a" and r[9] == 1 for r in rows)
    assert code_of(lambda: ENGINE.count(t)) == "INVALID_VALUE"
    assert code_of(lambda: ENGINE.count(t, lambda m: m.age.eq(2**53), scope="a")) == "INVALID_VALUE"


def test_opened_values_are_the_plain_ones(people):
    t, rows = people
    got = {r.id: r for r in ENGINE.open(t.parent, t.registration).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g.name, g.age, g.pay, g.big, g.phone, g.on, g["at"], g["rank"]) == (r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9])
    assert code_of(lambda: ENGINE.open(t.parent.drop("id"), t.registration)) == "ROW_CONTEXT_MISSING"
    some = t.parent.where("id in ('1', '2')")
    assert sorted(r["name"] for r in ENGINE.open_rows(some, t.registration, max_rows=2)) == ["Person 1 1", "Person 2 2"]
    assert code_of(lambda: ENGINE.open_rows(some, t.registration, max_rows=1)) == code_of(lambda: ENGINE.open_rows(some, t.registration, max_bytes=40)) == "LIMIT_EXCEEDED"
    nulls = ENGINE.open(t.parent.join(t.parent.select(F.col("id").alias("x")), F.col("x") == "none", "left"), t.registration)
    assert nulls.count() == len(rows)


def test_pages_cover_everything_once_in_order(people):
    t, rows = people
    mine = [r for r in rows if r[1] == "a"]
    nulls_last = lambda v: (v is None, v)
    for order, key in (([Order("rank"), Order("day", "desc")], None), (Order("day"), None), (Order("id", "desc"), lambda r: r[0]), (None, lambda r: r[0])):
        items, cursor, pages = [], None, 0
        while True:
            page = ENGINE.find_many(t, lambda m: m.name.contains("son"), scope="a", columns=["rank", "day"], order_by=order, limit=13, cursor=cursor, budgets=Budgets(batch=5))
            items, cursor, pages = items + page.items, page.next_cursor, pages + 1
            if cursor is None:
                break
        assert pages == 5 and sorted(i["id"] for i in items) == sorted(r[0] for r in mine)
        if isinstance(order, list):
            assert [nulls_last(i["rank"]) for i in items] == sorted(nulls_last(i["rank"]) for i in items)
            for _, group in itertools.groupby(items, lambda i: i["rank"]):
                ordered = [(i["day"], i["id"]) for i in group]
                assert ordered == sorted(ordered, reverse=True)
        if key:
            assert [i["id"] for i in items] == sorted((i["id"] for i in items), reverse=order is not None)
    exact = ENGINE.find_many(t, scope="a", limit=60)
    assert exact.next_cursor is not None and ENGINE.find_many(t, scope="a", limit=60, cursor=exact.next_cursor).items == []
    assert ENGINE.find_many(t, scope="a").next_cursor is None


def test_cursors_and_limits_are_checked(people):
    t, _ = people
    page = ENGINE.find_many(t, lambda m: m.age.eq(1), scope="a", limit=2)
    assert code_of(lambda: ENGINE.find_many(t, lambda m: m.age.eq(2), scope="a", cursor=page.next_cursor)) == "CURSOR_INVALID"
    assert code_of(lambda: ENGINE.find_many(t, lambda m: m.age.eq(1), scope="b", cursor=page.next_cursor)) == "CURSOR_INVALID"
    assert code_of(lambda: ENGINE.find_many(t, lambda m: m.age.eq(1), scope="a", cursor=page.next_cursor[:-2] + "AA")) == "CURSOR_INVALID"
    assert code_of(lambda: ENGINE.find_many(t, scope="a", cursor="*")) == "CURSOR_INVALID"
    assert len(ENGINE.find_many(t, lambda m: m.age.eq(1), scope="a", limit=50, columns=["age"], cursor=page.next_cursor).items) > 0
    for bad in ({"limit": 0}, {"limit": True}, {"columns": ["nope"]}, {"order_by": []}, {"order_by": Order("name_ct")}, {"order_by": [Order("rank"), Order("rank", "desc")]}, {"order_by": Order("rank", "up")}):
        assert code_of(lambda bad=bad: ENGINE.find_many(t, scope="a", **bad)) == "INVALID_VALUE"
    part = ENGINE.find_many(t, scope="a", limit=50, budgets=Budgets(fetch_bytes=2000))
    assert 0 < len(part.items) < 50 and part.next_cursor
    assert code_of(lambda: ENGINE.find_many(t, scope="a", limit=5, budgets=Budgets(fetch_bytes=1))) == "LIMIT_EXCEEDED"
    assert code_of(lambda: ENGINE.find_many(t, scope="a", limit=5, cancelled=lambda: True)) == "CANCELLED"
    assert code_of(lambda: ENGINE.count(t, scope="a", budgets=Budgets(deadline_ms=1))) == "LIMIT_EXCEEDED"
    assert code_of(lambda: Budgets(batch=0)) == "INVALID_VALUE"


def test_search_over_a_callers_join(spark, people, tmp_path):
    t, rows = people
    r = s.Registration("notes", "nid", {"body": s.text(search={"substring": True})}, scope="tenant", plain=("who",))
    notes = table(spark, str(tmp_path), r, [(f"n{i}", "a", f"note about {i % 3}", str(i % 20)) for i in range(90)], "nid string, tenant string, body string, who string")

    def join(parts):
        return parts.tables["n"].select("nid", "who", "body").join(parts.tables["p"].select(F.col("id").alias("who"), "name"), "who")

    match = {"p": (t, lambda m: m.name.contains("person")), "n": (notes, lambda m: m.body.ends_with("out1"))}
    items, cursor = [], None
    while True:
        page = ENGINE.search(match, join, scope="a", keyset=["who", "nid"], limit=4, cursor=cursor)
        items, cursor = items + page.items, page.next_cursor
        if cursor is None:
            break
    want = sorted((str(i % 20), f"n{i}") for i in range(90) if i % 3 == 1 and i % 20 % 2 == 0)
    assert [(i["who"], i["nid"]) for i in items] == want and all(i["name"].startswith("Person") for i in items)
    assert code_of(lambda: ENGINE.search(match, join, scope="a", keyset=["nope"], limit=4)) == "INVALID_CANDIDATE_SHAPE"
    assert code_of(lambda: ENGINE.search(match, join, scope="a", keyset=["body"], limit=40)) == "INVALID_CANDIDATE_SHAPE"
    assert code_of(lambda: ENGINE.search({"p": match["p"], "q": match["p"]}, join, scope="a")) == "INVALID_VALUE"

    def by(**options):
        return ENGINE.search(match, join, scope="a", keyset=["who", "nid"], **options)

    whole = by().items
    assert by(budgets=Budgets(batch=3)).items == whole and by(limit=5, budgets=Budgets(batch=3)).items == whole[:5]
    items, cursor, pages = [], None, 0
    while pages == 0 or cursor:
        page = by(cursor=cursor, budgets=Budgets(result_bytes=300))
        items, cursor, pages = items + page.items, page.next_cursor, pages + 1
    assert items == whole and pages > 1
    assert code_of(lambda: by(budgets=Budgets(result_bytes=1))) == "LIMIT_EXCEEDED"
    assert code_of(lambda: ENGINE.search(match, join, scope="a", budgets=Budgets(result_bytes=300))) == "LIMIT_EXCEEDED"
    assert code_of(lambda: by(budgets=Budgets(deadline_ms=1))) == "LIMIT_EXCEEDED"
    assert code_of(lambda: by(cancelled=lambda: True)) == "CANCELLED"
    assert code_of(lambda: by(budgets=Budgets(fetch_bytes=10))) == "INVALID_VALUE"
    assert code_of(lambda: by(columns={"p": ["nope"]})) == "INVALID_VALUE"
    assert code_of(lambda: by(limit=0)) == "INVALID_VALUE"
    seen = []
    ENGINE.search(match, lambda parts: (seen.append(parts.tables["p"].columns), join(parts))[1], scope="a", keyset=["who", "nid"], columns={"p": ["name"]}, limit=1)
    fields = set(match["p"][0].registration.fields)
    assert fields & set(seen[0]) == {"name"}


def test_plans_are_what_they_should_be(people):
    t, _ = people
    plan = ENGINE.count_rows(t, lambda m: m.name.like("per%11%"), scope="a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "parent" not in plan.split("companion")[0]
    p = t.registration.profile("name", "substring")
    assert f"pos_stamps_{p.tag}" in plan and f"eq_stamp_{t.registration.profile('age', 'exact').tag}" not in plan
    listed = ENGINE.list_rows(t, lambda m: m.name.contains("son"), scope="a", columns=["age"], limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in listed and "age_ct" in listed and "pay_ct" not in listed


def test_whole_documents_are_searched(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(7001, "x" * 500 + " É l"), (7002, "É" + "y" * 300), (7003, None), (7004, ""), (7005, "E\u0301l " + "z" * 300)], "doc_id long, text string")
    rows.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r["id"] for r in queries.QUERIES["contains_unicode"](spark, str(tmp_path)).collect())
    assert got == sorted(str(r.doc_id) for r in docs.collect() if "Él" in compact(r.text or ""))
    assert {"7001", "7005"} <= set(got)


def test_pages_and_outer_joins_take_all_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").collect()
    customers = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    pages = queries._pages(spark, sf, "orders", lambda m: m.priority.contains("med"), 60, None, order_by=Order("day"))
    want = sorted(str(r.o_orderkey) for r in orders if "med" in compact(r.o_orderpriority))
    assert sorted(i["id"] for i in pages) == want == sorted(r["id"] for r in queries.QUERIES["page_exhaust"](spark, sf).collect())
    urgent = [(str(r.o_custkey), str(r.o_orderkey)) for r in orders if "urgent" in compact(r.o_orderpriority)]
    none = [("on", str(c), None) for c in customers if str(c) not in {c for c, _ in urgent}]
    got = [tuple(r) for r in queries.QUERIES["left_join_on_vs_where"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(none + [(form, *x) for x in urgent for form in ("on", "where")], key=str)
