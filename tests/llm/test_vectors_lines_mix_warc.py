import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import warc
from hushlake.llm.embedding_dedup import dedup_embeddings, spherical_k_means
from hushlake.llm.line_dedup import dedup_lines
from hushlake.llm.mixture import mix, prepared, rake, shares, tempered

# Vectors ------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    def unit(v, label, i):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        x /= np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v, label, i) for i, label, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and rows[a][1] == rows[b][1] and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k)), i is None or i == least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def near(rng, x, cos):
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    y /= np.sqrt(y @ y)
    return cos * x + math.sqrt(1 - cos * cos) * y


@pytest.mark.parametrize("bounds", [{}, {"cell_share": 1.5}, {"cell_share": 1, "block": 7, "sample": 100}])
def test_embeddings_equal_brute_force(spark, bounds):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        x = rng.normal(size=6)
        x /= np.sqrt(x @ x)
        rows += [(len(rows) + k, g % 3, (near(rng, x, rng.uniform(0.85, 1.0)) * rng.uniform(0.1, 9)).tolist()) for k in range(12)]
    rows += [(900 + k, 1, rows[0][2]) for k in range(3)] + [(900, 1, rows[0][2]), (None, 1, rows[0][2])]
    rows += [(950, None, rows[0][2]), (951, 1, None), (952, 1, []), (953, 1, [0.0] * 6), (954, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (955, 1, [math.nan] * 6), (956, 1, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (957, 1, [1.0, 2.0]), (958, 1, [2.0, 4.0]), (959, 1, [1e-300] * 6), (960, 1, [1e300] * 6)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("vec_id", "label", "embedding", "1 as v", "2 as cell").repartition(3)
    got = [tuple(r) for r in dedup_embeddings(frame, **bounds).collect()]
    assert sorted(got, key=str) == brute_vectors(rows)


def test_no_vectors(spark):
    assert dedup_embeddings(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_k_means_finds_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 4)) for c in np.eye(4)])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    fit = (x @ spherical_k_means(x, 8).T).max(axis=1)
    assert fit.min() > 0.9
    assert spherical_k_means(x[:2], 5).shape[0] == 2


# Lines --------------------------------------------------------------------------


def brute_lines(rows, least):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            k = line.strip(" \t\r")
            if k:
                sites.setdefault(k, set()).update({s} - {None})
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [bool(k := x.strip(" \t\r")) and len(sites[k]) >= least and (i is None or first.get(k) != i) and not (i is None and k not in first) for x in lines]
        out.append((i, sum(bool(x.strip(" \t\r")) for x in lines), sum(gone), None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 10, 300])
def test_lines_equal_brute_force(spark, sf, least):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(2000 + i, f"nav\n\n  own {i}\r\nfoot \t", f"s{i}") for i in range(400)] + [(2000 + i, f"mid {i % 11}\nfew", f"s{i % 14}") for i in range(1000, 1200)]
    rows += [(5000, None, "s1"), (5001, "", "s1"), (None, "nav\nx", "s2"), (5002, "nav\nnav", None), (5003, "nav", "s3"), (5003, "other\nnav", "s3"), (5004, "nav\ny", "s4"), (5004, "nav\ny", "s4"), (5005, "z\n" * 20_000 + "nav", "s5")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "9 as n_lines", "'k' as key", "'l' as line")
    got = dedup_lines(frame, min_sites=least)
    assert got.columns == ["doc_id", "text", "source", "key", "line", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == brute_lines(rows, least)


def test_no_lines(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# Mixture --------------------------------------------------------------------------


def test_margins_are_met_and_drawn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = prepared(docs).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    targets = {"source": tempered(cells, "source", 0.5), "lang": shares({"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25, "xx": 9.0}, spark), "topic": tempered(cells, "topic", 0.7)}
    for one_task in (20_000, 0):
        got = rake(cells, targets, rounds=30, one_task=one_task).toPandas()
        total = got.tokens.sum()
        assert got.weight.sum() == pytest.approx(total)
        assert (got.groupby("lang").weight.sum() / total).tolist() == pytest.approx([0.25] * 4, rel=1e-2)
        for m in ("source", "topic"):
            want = {r.value: r.share for r in targets[m].collect()}
            for value, weight in got.groupby(m).weight.sum().items():
                assert weight / total == pytest.approx(want[value], rel=1e-2)
    out = mix(docs, targets=targets, rate=0.5).toPandas()
    assert len(out) == docs.count()
    assert (out.copies * out.n_tokens).sum() == pytest.approx(0.5 * out.n_tokens.sum(), rel=0.15)
    assert ((out.copies - out.expected).abs() < 1).all()


def test_mixture_edges(spark):
    rows = [(1, "a b c", "s", "en"), (2, None, None, None), (3, "", "s", "en"), (3, "", "s", "en"), (None, "x y", "t", "de"), (5, "w " * 50_000, "t", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as weight", "2 as topic", "3 as expected")
    targets = {"source": 0.5, "lang": shares({"en": 0.5, "de": 0.5}, spark), "topic": 1.0}
    got = mix(docs, targets=targets)
    assert got.count() == 6
    assert {(r.source, r.lang) for r in got.where("doc_id = 2").collect()} == {("(none)", "(none)")}
    assert got.where("n_tokens = 0 and doc_id = 2").first()["expected"] == 0
    assert mix(docs.limit(0), targets=targets).count() == 0


# Archives -------------------------------------------------------------------------


def brute_pages(rows, least=1000):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == raw and j is not None] if len(raw) >= least else []
        last = max(same, default=None)
        revisit = last is not None and (i is None or i < last)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes", [1 << 20, 5000])
def test_archives_round_trip(spark, sf, tmp_path, file_bytes):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    big, small = "é" * 500, "e" * 999
    rows += [(9000, "http://a", big), (9001, None, big), (9001, "http://b", big), (None, "http://c", big), (9002, "http://d\r\nX: y", small), (9003, "", small), (9004, "http://e", None), (9005, "http://f", ""), (9006, "http://g", "x\r\n\r\ny" * 100_000), (None, None, "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as payload", "2 as same").repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), file_bytes=file_bytes)
    got = warc.read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_pages(rows)
    html = {(i, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id, r.payload_digest] for r in got if r.record_type == "response")
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    assert {f"{tmp_path}/w/{p.name}" for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")} == {r.archive for r in manifest.collect()}


def test_each_record_stands_alone():
    records = [warc.record(i, f"http://x/{i}", (f"<html>page {i} " + "common words " * 20).encode()) for i in range(200)]
    dictionary = warc.train(records)
    out = io.BytesIO()
    writer = warc.Writer(out, dictionary)
    places = [writer.add(r) for r in records]
    raw = out.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and warc.read_dictionary(io.BytesIO(raw)) == dictionary
    import zstandard

    at, size = places[77]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(raw[at : at + size])
    assert one == records[77]
    assert [f["Page-ID"] for f, _ in warc.read_records(io.BytesIO(raw))] == [str(i) for i in range(200)]
    assert len(raw) < sum(map(len, records)) / 4
    for cut in (raw[:-30], raw[4:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_records(io.BytesIO(cut)))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(none, str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
