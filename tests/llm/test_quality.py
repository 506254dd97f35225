import zlib

import numpy as np
import pyarrow as pa

from hushlake.llm import quality


def test_learns_the_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.9


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    scores = lambda l: [r.score for r in quality.classify(docs, l).orderBy("doc_id").collect()]
    assert scores(labels) == scores(turned) == scores(labels.unionByName(labels))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, "x" * 100_000, 4)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    odd = spark.createDataFrame([(None, 1), (2, None), (1, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert len(quality.classify(docs, odd).collect()) == 5
    assert quality.classify(docs.limit(0), odd).count() == 0


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 5)).astype(np.float32), rng.normal(-1, 1, (300, 5)).astype(np.float32)
    w, scale, b = quality.minimise(good[:100].copy(), np.concatenate([good[100:], bad]), 0.4)
    w = w / scale
    assert np.mean(good @ w + b > bad @ w + b) > 0.95
    model = quality.Model(np.zeros(quality.PAIRS + quality.SHAPES, np.float32), 0.0, 0.5)
    assert model.score(pa.array(["a", None, "b c"])).tolist() == [0.5] * 3
