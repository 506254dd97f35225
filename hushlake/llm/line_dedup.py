"""Removal of lines that many sites share.

Distinct-site spread.  A HyperLogLog sketch of the sites is kept for each line
hash, and sketches merge in the aggregation before and after the shuffle, so a line
that every page carries is as cheap as any other.  Lines whose estimate is well above the threshold are
boilerplate, lines well below are not; those within the error band of the threshold
get an exact count of distinct sites.

Scale: one shuffle of a sketch for each different line of a task, one of (line,
site) pairs for the lines near the threshold, and one of the texts that meet
their removals.  Lines that cannot reach the threshold, because
they occur too few times at all, leave before anything else is asked.  The set of
boilerplate lines grows with the corpus and is broadcast only where its
measured size is below the session's broadcast limit; else it is a shuffled join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, small_batches, unused

MIN_SITES = 10
#: log2 of the registers of a sketch; its relative error is about 1.04 / sqrt(2**LG_K), and four times that is the band.
LG_K = 8
_TRIM = " \t\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Lines that are not blank, with the hash of what is left after trimming."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_TRIM))).where("line <> ''")
    return rows.select("doc_id", "site", "mark", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))


def site_spread(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(key, first_doc) of lines on at least min_sites different sites; key is the MD5 of the trimmed line."""
    lines = _lines(docs, id_col, text_col, site_col)
    band = 4 * 1.04 / 2 ** (lg_k / 2)
    sketched = lines.groupBy("key").agg(F.count("site").alias("n"), F.min("doc_id").alias("first_doc"), F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    likely = cut(sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - band))).select("key", "first_doc", (F.col("sites") <= min_sites * (1 + band) + 1).alias("near")))
    near = likely.where("near").select("key")
    exact = lines.where("site is not null").join(near, "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("key")
    sure = likely.where("not near").select("key", "first_doc")
    return sure.unionByName(likely.where("near").join(exact, "key", "left_semi").select("key", "first_doc"))


_RESULT = T.StructType().add("text", "string").add("n_lines", "long").add("n_removed", "long")


@F.arrow_udf(_RESULT)
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    kept, n_lines, n_removed = [], [], []
    for value, positions in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        lines = (value or "").split("\n")
        n_lines.append(sum(1 for x in lines if x.strip(_TRIM)))
        n_removed.append(len(positions or ()))
        if positions:
            drop = set(positions)
            value = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        kept.append(value)
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The input rows with boilerplate lines taken out of the text, and n_lines and n_removed.

    A line (trimmed of spaces, tabs and returns; blank lines are none) on at
    least min_sites different sites is boilerplate and goes, except in the document with the
    smallest id that holds it, so that no content is lost altogether.
    Other lines and blank lines stay as they are.  n_lines counts the lines
    that are not blank, before removal.

    Null text stays null and has no lines; a null site is no site; rows with a
    null id are never the one that keeps a line; rows that share an id
    are treated each by its own text.  Further columns stay; the two new ones replace any of
    the same names.  An empty table gives an empty table.
    """
    small_batches(docs)
    boiler = cut(site_spread(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, lg_k=lg_k))
    lines = _lines(docs, id_col, text_col, site_col).select("doc_id", "mark", "pos", "key")
    hits = lines.join(boiler, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    # rows that repeat whole give each position once
    own_id, own_mark, pos, out = (unused(docs, f"hit_{x}") for x in ("id", "mark", "pos", "out"))
    per_doc = hits.groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set("pos").alias(pos))
    text = F.col(text_col).cast("string")
    rows = docs.join(per_doc, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_mark)), "left")
    done = rows.withColumn(out, _without(text, F.col(pos)))
    keep = [F.col(f"{out}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*keep, F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_removed").alias("n_removed"))
