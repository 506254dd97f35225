import pytest
from pyspark.sql import functions as F

from hushlake.errors import SealError
from hushlake.functions.keys import Keyring
from hushlake.operators.search import Sealed
from hushlake.plans import model as s
from hushlake.plans.predicate import Compiler, Match
from hushlake.plans.tokens import ProfileKeys
from hushlake.sources import files
from hushlake.sources.store import Store, prepare_all
from hushlake.streaming.ingest import seal_stream

ENGINE = Sealed(Keyring(bytes(range(32))))
BOTH = {"exact": True, "substring": True}
REG = s.Registration("memo", "id", {"body": s.text(search=BOTH, nullable=True), "n": s.integer(search={"exact": True}, nullable=True), "doc": s.json(nullable=True)}, scope="tenant", plain=("label",))
SCHEMA = "id string, tenant string, body string, n long, doc string, label string"


def code_of(run):
    with pytest.raises(SealError) as e:
        run()
    return e.value.code


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path / "memo"), REG, ENGINE)
    out.insert(spark.createDataFrame([(f"r{i}", "ab"[i % 2], f"memo number {i}", i, "{}", f"l{i}") for i in range(20)], SCHEMA))
    return out


def rows(store):
    t = store.table()
    return {r.id: r for r in ENGINE.open(t.parent, t.registration).collect()}


def ids(store, match, scope):
    return sorted(r.id for r in ENGINE.where(store.table(), match, scope=scope).select("id").collect())


def index(store):
    return {r.row_id: r for r in store.table().companion.collect()}


def test_update_touches_only_what_it_patches(spark, store):
    before, index_before = {r.id: r for r in store.table().parent.collect()}, index(store)
    assert store.update(spark.createDataFrame([("r2", "a", "changed text")], "id string, tenant string, body string")) == 1
    after, index_after = {r.id: r for r in store.table().parent.collect()}, index(store)
    assert after["r2"].body_ct != before["r2"].body_ct and after["r2"].n_ct == before["r2"].n_ct and after["r2"].label == "l2"
    n = REG.profile("n", "exact").tag
    assert index_after["r2"][f"eq_salt_{n}"] == index_before["r2"][f"eq_salt_{n}"]
    assert {k: v for k, v in after.items() if k != "r2"} == {k: v for k, v in before.items() if k != "r2"}
    assert ids(store, lambda m: m.body.contains("changed"), "a") == ["r2"] and "r2" not in ids(store, lambda m: m.body.contains("number"), "a")
    assert ids(store, lambda m: m.n.eq(2), "a") == ["r2"]
    assert store.update(spark.createDataFrame([("r4", "a", "plain")], "id string, tenant string, label string")) == 1
    assert rows(store)["r4"].label == "plain" and index(store)["r4"] == index_before["r4"]


def test_nulls_leave_the_index(spark, store):
    store.update(spark.createDataFrame([("r2", "a", None, None)], "id string, tenant string, body string, n long"))
    assert "r2" not in index(store) and rows(store)["r2"].body is None and ENGINE.count(store.table(), scope="a") == 10
    store.insert(spark.createDataFrame([("x1", "a")], "id string, tenant string"))
    assert rows(store)["x1"].body is None and "x1" not in index(store)
    assert ids(store, lambda m: m.or_(m.n.eq(4), m.sql(F.col("id") == "x1")), "a") == ["r4", "x1"]


def test_upsert(spark, store):
    one = spark.createDataFrame([("r1", "b", "upserted old"), ("new", "b", "upserted new")], "id string, tenant string, body string")
    assert store.upsert(one) == (1, 1)
    assert ids(store, lambda m: m.body.starts_with("upserted"), "b") == ["new", "r1"] and rows(store)["r1"].n == 1
    assert code_of(lambda: store.upsert(spark.createDataFrame([("r1", "a", "x")], "id string, tenant string, body string"))) == "SCOPE_CONFLICT"


def test_upsert_is_one_commit(spark, store, monkeypatch):
    one = spark.createDataFrame([("r1", "b", "upserted old"), ("new", "b", "upserted new")], "id string, tenant string, body string")
    want, version = rows(store), store.version
    with monkeypatch.context() as m:
        m.setattr(Store, "_add", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(one)
    assert store.version == version and rows(store) == want
    assert store.upsert(one) == (1, 1) and store.version == version + 1
    assert len(rows(store)) == len(index(store)) == 21 and rows(store)["r1"].body == "upserted old"


def test_manifests_appear_whole(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/manifest-1"
    seen = []
    monkeypatch.setattr(files.os, "link", lambda a, b, link=files.os.link: (seen.append(files.names(spark, str(tmp_path))), link(a, b)))
    files.create(spark, path, "text")
    assert "manifest-1" not in seen[0] and files.names(spark, str(tmp_path)) == ["manifest-1"] and files.read(spark, path) == "text"
    assert code_of(lambda: files.create(spark, path, "other")) == "TRANSACTION_CONFLICT"
    assert files.names(spark, str(tmp_path)) == ["manifest-1"] and files.read(spark, path) == "text"


def test_vacuum(spark, store):
    store.delete(rows=spark.createDataFrame([("r1", "b")], "id string, tenant string"))
    store.compact()
    want, names = rows(store), files.names(spark, store.path)
    assert store.vacuum(keep=1) == 0 and files.names(spark, store.path) == names
    assert store.vacuum(keep=1, older_s=0) == len(names) - 3  # a manifest, a parent and an index stay
    assert rows(store) == want and len(index(store)) == 19


def test_no_key_in_any_plan(spark, store):
    keys = [k.hex().upper() for f in ("body", "n", "doc") for k in ENGINE._cipher(REG, f).keys]
    for _, p in REG.profiles:
        own = ProfileKeys.of(ENGINE.ring, p)
        for key, size in ((own.token, 128), (own.proof, 64)):
            keys += [key.hex().upper(), *(bytes(b ^ pad for b in key.ljust(size, b"\0")).hex().upper() for pad in (0x36, 0x5C))]
    t = store.table()
    plain = spark.createDataFrame([("q", "a", "body", 1, "{}", "l")], SCHEMA)
    for frame in (ENGINE.seal_parent(plain, REG), ENGINE.companion_of(plain, REG), ENGINE.open(t.parent, REG), ENGINE.list_rows(t, lambda m: m.body.contains("memo"), scope="a", limit=3), ENGINE.list_rows(t, scope="a")):
        frame.collect()
        q = frame._jdf.queryExecution()
        text = " ".join(str(x.toString()) for x in (q, q.logical(), q.analyzed(), q.optimizedPlan(), q.sparkPlan(), q.executedPlan())).upper()
        assert "__HL_KEY_BODY" in text or "ARROW" in text
        assert not [k for k in keys if k in text]


def test_delete_compact_reindex(spark, store):
    assert store.delete(lambda m: m.body.ends_with("13"), scope="b") == 1
    assert store.delete(scope="a", where=F.col("label") == "l4") == 1 and store.delete(rows=spark.createDataFrame([("zz", "a")], "id string, tenant string")) == 0
    assert len(rows(store)) == len(index(store)) == 18
    store.insert(spark.createDataFrame([("r13", "b", "memo again 13", 13, None, None)], SCHEMA))
    assert ids(store, lambda m: m.n.eq(13), "b") == ["r13"]
    want = rows(store)
    store.compact()
    assert rows(store) == want and len(index(store)) == 19
    salts = {k: v[f"eq_salt_{REG.profile('n', 'exact').tag}"] for k, v in index(store).items()}
    assert store.reindex("a") == 9
    fresh = {k: v[f"eq_salt_{REG.profile('n', 'exact').tag}"] for k, v in index(store).items()}
    assert {k for k in salts if salts[k] != fresh[k]} == {k for k, r in want.items() if r.tenant == "a"}
    assert store.reindex() == 19 and ids(store, lambda m: m.n.eq(13), "b") == ["r13"]


def test_writes_that_fail_change_nothing(spark, store):
    version, want = store.version, rows(store)
    make = lambda data, schema: spark.createDataFrame(data, schema)
    assert code_of(lambda: store.insert(make([], SCHEMA))) == "INVALID_VALUE"
    assert code_of(lambda: store.insert(make([("r1", "a")], "id string, tenant string"))) == "CONSTRAINT_VIOLATION"
    assert code_of(lambda: store.insert(make([("y", "a"), ("y", "b")], "id string, tenant string"))) == "CONSTRAINT_VIOLATION"
    assert code_of(lambda: store.insert(make([("", "a")], "id string, tenant string"))) == "INVALID_ID"
    assert code_of(lambda: store.insert(make([("y", "a", 2**60)], "id string, tenant string, n long"))) == "INVALID_VALUE"
    assert code_of(lambda: store.insert(make([("y", "a", 1)], "id string, tenant string, odd long"))) == "INVALID_VALUE"
    assert code_of(lambda: store.insert(make([("y",)], "id string"))) == "INVALID_VALUE"
    assert code_of(lambda: store.update(make([("nope", "a", "x")], "id string, tenant string, body string"))) == "NOT_FOUND"
    assert code_of(lambda: store.update(make([("r1", "b")], "id string, tenant string"))) == "INVALID_VALUE"
    assert store.version == version and rows(store) == want


def test_one_of_two_writers_wins(spark, store):
    m = store._manifest()
    store._commit(m)
    assert code_of(lambda: store._commit(m)) == "TRANSACTION_CONFLICT"


def test_other_keys_and_damage_are_noticed(spark, store):
    other = Store(spark, store.path, REG, Sealed(Keyring(bytes(32))))
    assert code_of(other.table) == "KEY_NOT_FOUND"
    wrong = s.Registration("memo", "id", {**REG.fields, "extra": s.text(search=BOTH)}, scope="tenant", plain=("label",))
    assert code_of(Store(spark, store.path, wrong, ENGINE).preflight) == "INVALID_SCHEMA"


def test_validators_uuids_and_limits(spark, tmp_path):
    r = s.Registration("u", "id", {"a": s.text(search={"exact": True}, max_bytes=5, validate=s.Validator("short", 1, lambda c: c != "bad")), "p": s.text(search={"exact": True, "normalizer": "digits"}, nullable=True)}, row_type="uuid")
    store = Store(spark, str(tmp_path / "u"), r, ENGINE)
    written = store.insert(spark.createDataFrame([("one",), ("two",)], "a string"), returning=True)
    assert sorted(len(x.id) for x in written.collect()) == [36, 36] and sorted(x.a for x in rows(store).values()) == ["one", "two"]
    assert ENGINE.count(store.table(), lambda m: m.a.eq("ONE")) == 1
    new = lambda a, p=None: store.insert(spark.createDataFrame([(a, p)], "a string, p string"))
    assert code_of(lambda: new("bad")) == "VALIDATION_FAILED" and code_of(lambda: new("toolong")) == "LIMIT_EXCEEDED" and code_of(lambda: new(None)) == "INVALID_VALUE"
    assert code_of(lambda: new("ok", "12a")) == "INVALID_VALUE"
    assert code_of(lambda: store.insert(spark.createDataFrame([("A0000000-0000-0000-0000-000000000000", "x")], "id string, a string"))) == "INVALID_ID"
    assert len(rows(store)) == 2


def test_prepare_all(spark, store, tmp_path):
    r = s.Registration("plain", "k", {"v": s.text(search=BOTH)})
    second = Store(spark, str(tmp_path / "second"), r, ENGINE)
    second.insert(spark.range(50).selectExpr("cast(id as string) as k", "concat('value ', id) as v"))
    got = prepare_all([store, second])
    assert [(x.model, x.rows, x.indexed) for x in got] == [("memo", 20, 20), ("plain", 50, 50)]
    assert code_of(lambda: prepare_all([])) == "INVALID_VALUE"


def test_stream_is_sealed_once(spark, tmp_path):
    r = s.Registration("stream", "id", {"v": s.text(search=BOTH)})
    store = Store(spark, str(tmp_path / "s"), r, ENGINE)
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("cast(id as string) as id", "concat('value ', id) as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id string, v string").parquet(str(tmp_path / "in"))
        seal_stream(source, store, str(tmp_path / "check")).awaitTermination()
    assert ENGINE.count(store.table(), lambda m: m.v.contains("value")) == 30
    again = spark.read.parquet(str(tmp_path / "in")).where("id = '0'")
    assert store.insert(again, batch=store._manifest()["batches"][0]) is None
    assert ENGINE.count(store.table()) == 30


LOOKS_UP = Sealed(Keyring(bytes(range(32))), lookup_bytes=0)
MATCHES = [
    lambda m: m.body.contains("number 1"),
    lambda m: m.body.eq("memo number 4"),
    lambda m: m.n.eq(6),
    lambda m: m.or_(m.n.eq(2), m.body.ends_with("number 10")),
    lambda m: m.and_(m.body.starts_with("memo"), m.n.eq(8)),
    lambda m: m.and_(m.body.like("%num%12"), m.sql(F.col("label") == "l12")),
    lambda m: m.or_(m.n.eq(2), m.sql(F.col("label") == "l4")),
    lambda m: m.body.contains("zebra"),
    lambda m: m.body.contains("changed"),
]


def test_look_ups_find_what_scans_find(spark, store):
    def same():
        t = store.table()
        assert t.postings is not None
        for match in MATCHES:
            want = sorted(r.id for r in ENGINE.where(t, match, scope="a").select("id").collect())
            assert sorted(r.id for r in LOOKS_UP.where(t, match, scope="a").select("id").collect()) == want
            assert LOOKS_UP.count(t, match, scope="a") == len(want)
            assert [i["id"] for i in LOOKS_UP.find_many(t, match, scope="a", columns=["body"]).items] == want

    same()
    t = store.table()
    found = lambda i: LOOKS_UP._candidates(t, MATCHES[i](Match(REG)), "a")
    assert found(2) == ["r6"] and found(4) == ["r8"] and found(6) is None and found(7) == []
    store.update(spark.createDataFrame([("r2", "a", "changed text")], "id string, tenant string, body string"))
    same()
    store.upsert(spark.createDataFrame([("r4", "a", "changed too", 6, "{}", "l4"), ("r90", "a", "memo number 10", 2, "{}", "l90")], SCHEMA))
    same()
    store.delete(rows=spark.createDataFrame([("r6", "a")], "id string, tenant string"))
    same()
    store.reindex("a")
    same()
    store.compact()
    same()
    store.vacuum(keep=1, older_s=0)
    same()


def test_parts_without_postings_are_scanned(spark, tmp_path):
    old = Store(spark, str(tmp_path / "memo"), REG, LOOKS_UP, postings=False)
    old.insert(spark.createDataFrame([("r1", "a", "memo one", 1, "{}", "l")], SCHEMA))
    new = Store(spark, old.path, REG, LOOKS_UP)
    new.insert(spark.createDataFrame([("r2", "a", "memo two", 1, "{}", "l")], SCHEMA))
    assert new.table().postings is None and LOOKS_UP.count(new.table(), lambda m: m.n.eq(1), scope="a") == 2
    new.reindex()
    assert new.table().postings is not None and LOOKS_UP.count(new.table(), lambda m: m.n.eq(1), scope="a") == 2


def test_look_ups_read_little_and_leave_common_terms_to_a_scan(spark, tmp_path):
    reg = s.Registration("ticket", "id", {"n": s.integer(search={"exact": True}), "kind": s.integer(search={"exact": True})})
    block = spark.sparkContext._jsc.hadoopConfiguration()
    block.set("parquet.block.size", "65536")
    try:
        store = Store(spark, str(tmp_path / "ticket"), reg, LOOKS_UP)
        store.insert(spark.range(40_000).selectExpr("lpad(id, 8, '0') as id", "id as n", "id % 2 as kind"))
    finally:
        block.unset("parquet.block.size")
    t = store.table()

    def read(frame):
        frame.collect()
        return frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    rare = Match(reg).n.eq(31_234)
    narrow = LOOKS_UP._narrowed(t, rare, reg.scope_value(None))
    token = next(iter(Compiler(reg, LOOKS_UP.ring, reg.scope_value(None)).clauses(rare)[0]))
    assert read(t.companion) == 40_000 and t.postings.count() == 80_000
    assert 0 < read(narrow.companion) < 2_000 and 0 < read(narrow.parent) < 2_000
    assert 0 < read(t.postings.where(F.col("token") == token)) < 4_000
    assert LOOKS_UP._candidates(t, Match(reg).kind.eq(1), reg.scope_value(None)) is None
    assert LOOKS_UP.count(t, lambda m: m.kind.eq(1)) == 20_000 and LOOKS_UP.count(t, lambda m: m.n.eq(31_234)) == 1
    # a frequent term goes by a rare one that must hold too
    assert LOOKS_UP._candidates(t, Match(reg).and_(Match(reg).kind.eq(0), rare), reg.scope_value(None)) == ["00031234"]
