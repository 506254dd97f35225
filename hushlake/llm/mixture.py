"""Mixing sources to target weights, with DataFrame operations only.

Iterative proportional fitting.  Tokens are summed over the cells that source,
language and topic span; the sums are then scaled to the target share of each
source, of each language and of each topic in turn, until all three hold. What a
cell ends with, over what it began with, is the rate at which its documents are
taken: a document is expected `rate` times, so many whole copies of it are kept and
one more if a hash of its id falls below the remaining fraction.

Scale: documents are aggregated before they are shuffled and only cells take
part in the fitting; there are at most as many as combinations of the three
values.  Up to `one_task` cells are fitted inside one partition, where no step
needs an exchange; more are fitted with one small exchange for each step.  The
cells go back to the documents by a join that broadcasts them only below the same
bound; a source that holds a third of all documents is one row on that side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, unused

MARGINS = ("source", "lang", "topic")
ROUNDS = 12
MOST_ROUNDS, TOLERANCE = 120, 1e-6
ONE_TASK = 20_000
NONE = "(none)"

#: Words as everywhere here: runs of anything but space and the ASCII controls 09-0D.
TOKEN = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic from what the text holds, for tables without one."""
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("icense"), "licence").when(has(" | "), "table").when(has("@"), "contact").when(F.length(text) < 1000, "short").when(F.length(text) >= 5000, "long").otherwise("prose")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share) with shares in proportion to a power of the tokens: below one, large values give way to small ones."""
    own = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("w"))
    everything = own.agg(F.sum("w").alias("w")).first()["w"]
    return own.select("value", (F.col("w") / F.lit(everything or 1.0)).alias("share"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def _scaled(out: DataFrame, rounds: int, few: bool) -> DataFrame:
    """Each margin scaled to its goal in turn, so many times."""
    for _ in range(rounds):
        for m in MARGINS:
            if few:
                own = F.sum("weight").over(Window.partitionBy(m))
            else:
                # summed before the shuffle and joined back: all cells of one language never meet in one task
                sums = cut(out.groupBy(m).agg(F.sum("weight").alias("own")))
                out, own = out.join(sums, m), F.col("own")
            out = out.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"goal_{m}") / own).otherwise(F.lit(0.0)))
            if not few:
                out = cut(out.drop("own"))
    return out


def worst(cells: DataFrame) -> float:
    """The largest distance of a margin from its goal, as a share of all tokens."""
    total = cells.agg(F.sum("weight").alias("t")).first()["t"] or 1.0
    apart = [cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"goal_{m}")).alias("d")).agg(F.max("d").alias("d")) for m in MARGINS]
    return float(max(r["d"] or 0.0 for r in reduce(DataFrame.unionAll, apart).collect()) / total)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, one_task: int = ONE_TASK, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """The cells with `weight`: tokens scaled so that the shares of each margin are its targets'.

    targets: for each margin (value, share); shares of values that have tokens are scaled to
    sum to one, a value that is not listed gets nothing.  Weights sum to the tokens.  After each `rounds` rounds the margins are
    compared with their goals; it ends when none is off by more than `tolerance` of all tokens, when that no longer gets better, or
    after `most` rounds.  Where the targets contradict the empty cells, what the last round leaves is returned: topics exact, the others nearly.
    """
    few = cells.count() <= one_task
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("tokens").alias("total")).first()["total"] or 0)
    for m in MARGINS:
        share = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias(f"share_{m}"))
        out = out.join(F.broadcast(share) if few else share, m, "left").fillna({f"share_{m}": 0.0})
        # only shares of values that have tokens count
        live = cells.where("tokens > 0").select(m).distinct().join(share, m).agg(F.sum(f"share_{m}").alias("live")).first()["live"]
        out = out.withColumn(f"goal_{m}", F.lit(total) * F.col(f"share_{m}") / F.lit(live or 1.0))
    out = cut(out.select(*cells.columns, "weight", *(f"goal_{m}" for m in MARGINS)))
    apart = float("inf")
    for _ in range(max(1, most // max(1, rounds))):
        out = cut(_scaled(out.coalesce(1) if few else out, rounds, few))
        before, apart = apart, worst(out)
        if apart <= tolerance or apart > 0.9 * before:
            break
    return out.select(*cells.columns, "weight")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit(NONE)), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of: Column | None = None, further: list[Column] | None = None) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), value(F.col(source_col)).alias("source"), value(F.col(lang_col)).alias("lang"),
        value(topic(text) if topic_of is None else topic_of).alias("topic"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens"), *(further or ()),
    )


def mix(docs: DataFrame, *, targets: dict[str, DataFrame | float], rate: float = 0.5, seed: int = 1, rounds: int = ROUNDS, one_task: int = ONE_TASK, carry: list[str] | None = None, **columns) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, expected and copies for each document.

    targets has for each of source, lang and topic either a table (value, share)
    or a power by which the present shares are tempered; rate is the share of all
    tokens to be taken in expectation.  expected is how many times the
    document is taken on average and copies how many times it is taken here.
    Columns named in carry follow unchanged (then the texts are read a second time rather than moved).

    Null source, language or topic is a value of its own, "(none)", which a
    table of targets may list.  Null and empty texts have no tokens and get the
    rate of their cell, or 0 if nobody in it has tokens.  Repeated ids are
    drawn alike; a null id is drawn like the text "(none)".  Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    rows = cut(prepared(docs, **columns))
    cells = cut(cells_of(rows))
    tables = {m: t if isinstance(t, DataFrame) else tempered(cells, m, float(t)) for m, t in targets.items()}
    fitted = rake(cells, tables, rounds, one_task).withColumn("expected", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens") * rate).otherwise(F.lit(0.0)))
    fitted = fitted.select(*MARGINS, "expected")
    fitted = F.broadcast(fitted) if cells.count() <= one_task else fitted
    whole = F.floor("expected")
    copies = whole + F.when(draw(F.col("doc_id"), seed) < F.col("expected") - whole, 1).otherwise(0)
    if carry:
        carried = unused(docs, "carried")
        rows = prepared(docs.withColumn(carried, F.struct(*(F.col(f"`{c}`") for c in carry))), further=[F.col(carried).alias("carried")], **columns)
    out = rows.join(fitted, list(MARGINS))
    return out.select("doc_id", *MARGINS, "n_tokens", "expected", copies.cast("long").alias("copies"), *(F.col(f"carried.`{c}`") for c in carry or ()))


def shares(pairs: dict[str, float], spark) -> DataFrame:
    """A table of targets from a dictionary."""
    rows = [F.struct(F.lit(k).alias("value"), F.lit(float(v)).alias("share")) for k, v in pairs.items()]
    return spark.range(1).select(F.explode(reduce(lambda a, b: F.concat(a, b), [F.array(r) for r in rows])).alias("r")).select("r.*")
