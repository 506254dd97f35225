"""Connected components of a graph given by its edges, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, drop, empty


_SIGN = -(1 << 63)


def vertex(rep: Column, key: Column) -> Column:
    """A binary that sorts by rep and then by key, so that the smallest vertex of a component tells its smallest rep."""
    return F.concat(F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(_SIGN))), 16, "0")), key)


def rep_of(v: Column) -> Column:
    return F.conv(F.hex(F.substring(v, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest vertex of its component.

    Each round hooks every vertex to its smallest neighbour, follows the hooks
    one step further, and replaces both ends of each edge by where they hang;
    edges inside one tree vanish, so the graph shrinks geometrically and a star
    (which near-duplicate candidates form) is done in one round.  Vertices that
    many edges share are aggregated before the shuffle (a minimum) and written, so that joins on
    them read two plain tables and the optimizer splits skewed partitions.  Every
    round is written to the shared folder, so a lost executor costs one round.
    Null ends and loops are ignored; no edges give an empty table.
    """
    links = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not empty(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        step = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        hook = cut(near.join(step, "p").select("v", F.col("q").alias("p")))
        drop(near)
        ends = hook.select(F.col("v").alias("a"), F.col("p").alias("x"))
        ends_b = hook.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = links.join(ends, "a").join(ends_b, "b").where("x <> y")
        rest = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = hook.select("v", F.col("p").alias("root"))
        else:
            old = labels
            labels = cut(old.join(hook.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")))
            drop(old)
            drop(hook)
        drop(links)
        links = rest
    if labels is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    drop(links)
    return labels
