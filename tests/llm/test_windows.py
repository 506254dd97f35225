import hashlib
import re

import numpy as np
import pytest

from hushlake.llm.decontaminate import decontaminate
from hushlake.llm.kernel import SPACE, U64, Texts, Words
from hushlake.llm.substring_dedup import dedup_substrings

PASSAGE = " ".join(f"w{i}" for i in range(60))
EDGE = [(5000, None), (5001, ""), (5002, " \n\t "), (5003, PASSAGE), (5004, "lead in " + PASSAGE + " tail"), (5005, " ".join(f"w{i}" for i in range(12))), (5006, "ha " * 4000), (5007, "ha " * 40), (5008, "é " * 30), (5009, "x" * 200_000)]


def brute_dedup(rows, window=13):
    first, words = {}, []
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append((i, ws))
        for p in range(len(ws) - window + 1) if i is not None else ():
            k = tuple(ws[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for p in range(len(ws) - window + 1) if i is not None else ():
            if first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows + EDGE + [(None, PASSAGE), (5003, PASSAGE), (5004, "other text under the same id")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as h", "2 as at", "3 as flags", "4 as mark", "5 as items")


@pytest.mark.parametrize(("window", "limit"), [(13, 100_000), (13, 1), (13, 50), (20, 100_000), (8, 7)])
def test_substring_dedup_equals_brute_force(spark, docs, window, limit):
    got = dedup_substrings(frame(spark, docs).repartition(5), window=window, run_limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(docs, window)


@pytest.mark.parametrize("limit", [100_000, 1])
def test_windows_that_share_half_a_fingerprint_are_not_repeats(spark, limit):
    short = lambda texts: Words(Texts.of(texts), SPACE)
    heads = [" ".join(f"c{i}x{j}" for j in range(7)) for i in range(4000)]
    words = short(heads)
    head = heads[int(words.span(words.first[:-1], 7).argmin())]
    tails = [f"{head} " + " ".join(f"t{i}x{j}" for j in range(6)) for i in range(300_000)]
    words = short(tails)
    half = words.span(words.first[:-1], 13) >> U64(32)
    order = half.argsort(kind="stable")
    at = np.flatnonzero(half[order[1:]] == half[order[:-1]])
    assert len(at)
    rows = [(2 * n + k, tails[order[i + k]]) for n, i in enumerate(at.tolist()) for k in (0, 1)]
    got = dedup_substrings(frame(spark, rows), run_limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(rows)


def brute_hits(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        ws = low(t)
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1) if n and i is not None else ():
            wins.setdefault(tuple(ws[p : p + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in rows:
        ws, hit, found = low(t), set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                if (k := tuple(ws[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= wins[k]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_decontaminate_equals_brute_force(spark, sf, docs, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, "The"), (901, PASSAGE.upper()), (902, ""), (903, None), (None, "of the"), (904, "that it"), (900, "ha ha ha"), (905, "Ha, ha-ha")]
    rows = docs + [(6000, "THE thing"), (6001, "that-it"), (6002, "x " + items[0][1] + " y")]
    got = decontaminate(frame(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).drop("items").collect()
    want = brute_hits(rows, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(w[5] for w in want) > 3


def test_decontaminate_over_several_chunks(spark):
    long = "filler " * 400_000
    rows = [(1, long), (2, long + PASSAGE), (3, long), (4, PASSAGE)]
    got = decontaminate(frame(spark, rows).coalesce(1), spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_hit, r.items) for r in got] == [(1, 0, []), (2, 60, [7]), (3, 0, []), (4, 60, [7])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dedup_substrings(none).count() == 0
    assert decontaminate(none, items).count() == 0
    assert [tuple(r)[:4] for r in decontaminate(some, items).collect()] == [(1, 3, 0, 0)]
    kept = decontaminate(some.selectExpr("doc_id", "text", "7 as rest", "8 as hits"), items, with_rows=True).first()
    assert kept["text"] == "a b c" and kept["rest"].asDict() == {"doc_id": 1, "rest": 7, "hits": 8}


def test_decontaminate_reads_documents_twice(spark):
    read = spark.sparkContext.accumulator(0)
    docs = frame(spark, [(i, f"{PASSAGE} number {i}") for i in range(40)])

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)] + [(99, PASSAGE)]
    got = decontaminate(docs.mapInArrow(seen, docs.schema), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200).collect()
    assert all(r.contaminated and r.items == [99] for r in got) and read.value == 80
