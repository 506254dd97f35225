import re

import pytest

from hushlake.llm.components import components
from hushlake.llm.ngram_join import choose_bands, ngram_join

WORDS = [f"w{i}" for i in range(100)]
EDGE = [(7000, None), (7001, ""), (7002, "..."), (7003, "one two"), (7004, "One, two!"), (7005, " ".join(WORDS)), (7006, " ".join([*WORDS[:99], "other"])), (7007, " ".join(WORDS).upper()), (None, " ".join(WORDS)), (7005, " ".join(WORDS)), (7003, "something else under the same id"), (7010, "x" * 100_000)]
EDGE += [(7100 + i, " ".join([*WORDS[:50], f"v{i}", *WORDS[51:], f"u{i}"])) for i in range(40)]


def brute(rows, n=5):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = []
    for i, t in rows:
        ws = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[p : p + n]) for p in range(max(len(ws) - n + 1, min(1, len(ws))))} if i is not None else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k)), i is None or i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bounds", [{}, {"block_classes": 3}, {"block_grams": 300}])
def test_equals_brute_force(spark, sf, bounds):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as v", "2 as bands", "3 as h").repartition(3)
    got = ngram_join(docs, **bounds)
    assert sorted((tuple(r) for r in got.drop("class_id").collect()), key=str) == brute(rows)
    assert {r.class_id for r in got.where("doc_id in (7005, 7007)").collect()} == {7005}


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8)
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands * rows <= 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (200, 200), (None, 3)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ngram_join(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()] == [(1, 0, 1, True, 1)]
