"""Index columns made a batch at a time equal those of one value at a time, in bounded parts and over all cores."""

import os
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from hushlake import queries
from hushlake.functions.keys import Keyring
from hushlake.functions.normalize import compact, compact_all, normalize, normalize_all
from hushlake.operators import companion
from hushlake.operators.search import Order, Sealed
from hushlake.plans import model as s
from hushlake.plans.tokens import ProfileKeys, TextIndex, ValueIndex, grams, pieces, stamp
from hushlake.sources.store import Store

KEYS = ProfileKeys(bytes(range(48)), bytes(range(32)), 16)
random.seed(5)
TEXTS = ["", "a", " ", "ab", "aaaa", "É́x", "Él", " x y ", "😀x😀x", "\0", "a\0b", "́q", "ＡＢｃ！", "SMALL é"] + ["".join(random.choice("abcÉ é😀 ") for _ in range(random.randrange(60))) for _ in range(120)]


def one(text, scope, salt, skip):
    value, seen, out = compact(text), {}, []
    for offset, gram in enumerate(grams(value)):
        seen[gram] = seen.get(gram, 0) + 1
        out.append((stamp(KEYS.proof_of(scope, gram.encode()), salt, seen[gram]), offset))
    tokens = sorted({KEYS.token_of(scope, p) for p in pieces(value, skip, True, True)}) if len(value) >= 2 else None
    return tokens, len(value), [x for x, _ in sorted(out)], [x for _, x in sorted(out)]


def test_batches_of_texts_equal_single_ones(monkeypatch):
    for block in (7, 1 << 16):
        monkeypatch.setattr(TextIndex, "BLOCK", block)
        for texts in (TEXTS, [t for t in TEXTS if "\0" not in t] * 2, [], [""], ["a"]):
            assert compact_all(texts) == [compact(t) for t in texts] and normalize_all(texts) == [normalize(t) for t in texts]
            scopes = [random.choice(["s", "t", ""]) for _ in texts]
            for skip in (True, False):
                tokens, salt, size, stamps, offsets = (c.to_pylist() for c in TextIndex(KEYS, "default", skip, False).substring(texts, scopes))
                assert [(t, n, a, b) for t, n, a, b in zip(tokens, size, stamps, offsets)] == [one(t, x, y, skip) for t, x, y in zip(texts, scopes, salt)]
                assert len(set(salt)) == len(texts)
            assert len(TextIndex(KEYS, "default", True, True).substring(texts, scopes)) == 4


def test_batches_of_values_equal_single_ones():
    values = [os.urandom(i % 5) for i in range(50)]
    token, salt, proof = (c.to_pylist() for c in ValueIndex(KEYS, False).exact(values, ["s"] * 50))
    assert token == [KEYS.token_of("s", v) for v in values] and proof == [stamp(KEYS.proof_of("s", v), x) for v, x in zip(values, salt)]
    assert len(ValueIndex(KEYS, True).exact(values, ["s"] * 50)) == 2


def test_long_texts_are_indexed_in_bounded_parts():
    r = s.Registration("docs", "id", {"text": s.text(search={"substring": {"skip_grams": False}}, nullable=True)})
    (_, p), names = r.profiles[0], r.companion_schema()
    schema = pa.schema([(n, companion._ARROW[t]) for n, t in names.items()])
    run = companion._index([(KEYS, p)], schema)
    texts = [None if i % 9 == 0 else f"{i} " + "lorem ipsum dolor " * 300 for i in range(400)]

    def batches(n):
        yield pa.RecordBatch.from_arrays([pa.array(["_"] * n), pa.array([str(i) for i in range(n)]), pa.array(texts[:n])], ["scope_id", "row_id", "__0"])

    def peak(n):
        tracemalloc.start()
        rows, largest = 0, 0
        for b in run(batches(n)):
            rows, largest = rows + b.num_rows, max(largest, b.nbytes)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return top, largest

    (small, _), (large, part) = peak(100), peak(400)
    # four times the rows of a batch take no more memory, and no more is handed on at once
    assert large < 1.3 * small and part < 40 * companion.SLICE_BYTES


def test_one_partition_is_sealed_and_indexed_by_all_cores(spark, tmp_path):
    r = s.Registration("t", "id", {"v": s.text(search={"exact": True, "substring": True})})
    store = Store(spark, str(tmp_path / "t"), r, Sealed(Keyring(bytes(32))))
    rows = spark.range(4000).selectExpr("cast(id as string) as id", "concat('value ', id) as v").coalesce(1)
    store.insert(rows)
    t = store.table()
    cores = spark.sparkContext.defaultParallelism
    for frame in (t.parent, t.companion):
        sizes = [x["count"] for x in frame.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) >= cores and max(sizes) < 2 * 4000 / cores
    made = spark.createDataFrame([(f"n{i}", "new") for i in range(20)], "id string, v string")  # of unknown size
    assert store._spread(made).rdd.getNumPartitions() <= 4 * cores
    assert store.sealed.count(t, lambda m: m.v.contains("399")) == sum("399" in f"value{i}" for i in range(4000))


def test_all_pages_are_those_of_the_cursors_from_one_search(spark, sf, tmp_path, monkeypatch):
    t = queries.sealed_table(spark, sf, "customer_gaps")
    match, orders = lambda m: m.rank.eq(4), [Order("segment"), Order("balance", "desc")]
    want = queries._pages(spark, sf, "customer_gaps", match, 8, None, columns=["note", "balance"], order_by=orders)
    got = sorted(queries._engine.all_pages(t, match, folder=str(tmp_path / "p"), limit=8, columns=["note", "balance"], order_by=orders).collect(), key=lambda r: r["at"])
    assert [(i // 8, i, x) for i, x in enumerate(want)] == [(r["page"], r["at"], {k: r[k] for k in ("id", "note", "balance")}) for r in got]
    assert queries._engine.all_pages(t, lambda m: m.note.contains("zzz"), folder=str(tmp_path / "q"), limit=8).count() == 0
    monkeypatch.setattr(Sealed, "find_many", lambda *_, **__: 1 / 0)
    assert queries.QUERIES["page_exhaust"](spark, sf).count() > 0  # no search for each page


def test_joins_move_no_index(spark, sf):
    t = queries.sealed_table(spark, sf, "customer_gaps")
    mixed = queries._engine.where(t, lambda m: m.or_(m.and_(m.rank.eq(3), m.note.contains("ab")), m.sql(F.col("segment") == "MACHINERY")))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    above = plan[: plan.index(join) + len(join)]
    assert "__hl_0" in above and "pos_stamps" not in above and "eq_stamp" not in above
    plan = queries.QUERIES["left_join_on_vs_where"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "x_pos" in line for line in plan.splitlines()) and "x_pos_stamps" not in plan
