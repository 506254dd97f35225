import corpus_pipeline
from hushlake.llm import quality
from hushlake.llm.queries import LANGUAGES

from .test_ngram_join import brute as brute_groups
from .test_vectors_lines_mix_warc import brute_lines
from .test_windows import brute_hits

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        after = {r.doc_id: r for r in out.collect()}
        rows = [(i, r.text) for i, r in before.items()]
        assert 0 < len(after) <= len(before)
        if stage is corpus_pipeline.good_quality:
            want = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert set(after) == want and len(want) < len(before)
        elif stage is corpus_pipeline.without_boilerplate:
            want = brute_lines([(i, r.text, r.source) for i, r in before.items()], 10)
            assert sorted((i, r.text) for i, r in after.items()) == sorted((w[0], w[3]) for w in want)
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif stage is corpus_pipeline.one_of_each:
            want = {i for i, _, _, kept in brute_groups(rows) if kept}
            assert set(after) == want and len(want) < len(before)
        elif stage is corpus_pipeline.clean_of_benchmarks:
            want = {w[0] for w in brute_hits(rows, items) if not w[5]}
            assert set(after) == want and len(want) < len(before)
        else:
            assert all(r.copies >= 1 and abs(r.copies - r.expected) < 1 for r in after.values())
            tokens = {k: sum(r.n_tokens * r.copies for r in after.values() if r.lang == k) for k in LANGUAGES}
            assert abs(tokens["en"] / sum(tokens.values()) - LANGUAGES["en"]) < 0.2
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns and all(after[i].source == before[i].source for i in after)
        assert all(r.text == before[i].text for i, r in after.items()) or stage is corpus_pipeline.without_boilerplate
        docs = out


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a b c", None, None, 5), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0)], docs.schema)
    both = docs.limit(60).unionByName(odd)
    for frame in (both, docs.limit(0)):
        now = frame.withColumnsRenamed({})
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{frame is both}-{name}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    for c in ("score", "Mark", "carried", "__score", "__hit_id", "hit_pos", "HIT_OUT", "__mark", "__carry", "a.b", "kept", "rest", "hits", "items"):
        docs = docs.withColumn(c, docs["doc_id"] + 1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.where("score <> doc_id + 1 or `a.b` <> doc_id + 1 or hits <> doc_id + 1").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_repeated_ids_go_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, c + " more"), (7, None), (7, "..."), (8, c), (None, a), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    want = [(1, a), (5, b), (7, None), (7, "..."), (None, a), (9, ""), (9, "")]
    assert sorted((x for x in got if x not in ((7, c), (7, c + " more"))), key=str) == sorted(want, key=str)
    assert len(got) == len(want) + 1
