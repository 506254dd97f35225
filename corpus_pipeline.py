"""From raw documents to a mixed training set: five stages over `documents`, each on all that its predecessor kept.

Quality classifier, line dedup, n-gram near-duplicates, benchmark
decontamination, mixing to target weights.  Every stage takes (spark, docs,
sf_dir) and returns documents with the columns it got (the last one adds how
often each is taken), so stages can be written out and read again in between.

Null and repeated ids, null and empty texts and empty tables are handled as the
operators' docstrings say: a null text is scored like an empty one, has no lines,
no n-grams and no benchmark passage, and is drawn by the rate of its cell.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import decontaminate as decontamination
from hushlake.llm import line_dedup, ngram_join, quality
from hushlake.llm.queries import mixed
from hushlake.llm.scratch import cut, drop, empty, settled, unused


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels that are not held out, on these documents."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return quality.scored(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the smallest id; each row goes or stays for its own text."""
    rows = cut(ngram_join.ngram_join(docs, with_mark=True).where("has_words").select("doc_id", "mark", "kept"))
    mark, columns = unused(docs, "mark"), [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(mark, F.xxhash64("text"))
    on = lambda t: (marked["doc_id"] == t["doc_id"]) & (marked[mark] == t["mark"])
    gone = rows.where("not kept").select("doc_id", "mark").distinct()
    # rows of one group that share the smallest id
    alike = rows.where("kept").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("mark").alias("mark")).where("n > 1")
    if empty(alike):
        return marked.join(gone, on(gone), "left_anti").select(*columns)
    alike = cut(alike)
    away = gone.unionByName(rows.where("kept").join(alike.select("doc_id"), "doc_id").select("doc_id", "mark").distinct())
    one = marked.join(alike, on(alike), "left_semi").groupBy("doc_id", mark).agg(F.first(F.struct(*columns)).alias("row"))
    return marked.join(away, on(away), "left_anti").select(*columns).unionByName(one.select("row.*"))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_rows=True)
    return found.where(~F.col("contaminated")).select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their topic, their expected number of copies and the number drawn."""
    return mixed(spark, docs, carry=["text", "n_chars"]).where("copies > 0")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing to target weights", mixed_to_targets),
]

#: The classifier has no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        # later stages read their input more than once; what a stage wrote for itself and what it read go
        before, docs = docs, settled(functools.partial(stage, spark, docs, sf_dir))
        if i:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
