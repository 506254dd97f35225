"""Documents whose word n-gram sets have a Jaccard similarity of at least a threshold.

MinHash banding.  The number of rows in a band is the largest that the hash
budget allows and the number of bands follows from the recall that is asked
for at the threshold.  Documents with equal n-gram sets are one class from the
start, so copies never meet; classes are shuffled on their band hashes, and
those that share one are candidates.  Candidates are verified on their full
n-gram sets, with whole-number arithmetic.

No pairs are written out.  Each bucket gives one edge from each member to its
smallest; the components of these edges are the cells in which all pairs are
verified, as products of incidence blocks.  A cell is cut into blocks of a
bounded number of n-grams by hash of the class, and each pair of blocks is a group of
its own, so a cell of any size is spread over many tasks of equal size and
what leaves a group is one row for each class with its number of links and its
label within the group, never the links themselves.  Should chains of chance
candidates make a cell far larger than the buckets it consists of, its buckets
are used as cells in its place, and a pair counts in the first bucket that it shares.

Scale: texts are read twice and moved once, and only n-gram sets of classes that
have a candidate travel, once for each block of their cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, rep_of, vertex
from .kernel import NOT_ALNUM, U64, Words, chunks, mix
from .scratch import cut, drop, small_batches

RECALL = 0.9999
HASHES = 128
BLOCK_CLASSES, BLOCK_GRAMS = 256, 1 << 17


def choose_bands(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): most rows for which bands * rows <= hashes still reach the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct n-grams, by row and hash; a shorter text that has words is one n-gram."""
    at = words.window_starts(n)
    row, value = words.row[at], words.span(at, n)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        row = np.concatenate([row, few])
        value = np.concatenate([value, words.span(words.first[few], words.counts[few])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _class_ids(row: np.ndarray, value: np.ndarray, rows: int) -> list[bytes | None]:
    """16 bytes for each row's set; none for an empty set."""
    first = np.searchsorted(row, np.arange(rows + 1))
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(value) + 1, dtype=U64)
        np.cumsum(mix(value ^ U64(salt)), out=total[1:])
        sums.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)))
    return [a + b if n else None for a, b, n in zip((x.astype(">u8").tobytes() for x in sums[0]), (x.astype(">u8").tobytes() for x in sums[1]), np.diff(first).tolist(), strict=True)]


def _sketch(n: int, bands: int, rows: int):
    keys = mix(np.arange(1, bands * rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("v", pa.binary()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                row, value = gram_sets(Words(texts, NOT_ALNUM, fold=True), n)
                ids = _class_ids(row, value, len(texts))
                some = np.unique(row)
                hashes = np.zeros((len(texts), bands), dtype=U64)
                if len(some):
                    first = np.searchsorted(row, some)
                    for b in range(bands):
                        band = np.full(len(some), b + 1, dtype=U64)
                        for k in keys[b * rows : (b + 1) * rows]:
                            band = mix(band * U64(0x2545F4914F6CDD1D) + np.minimum.reduceat(value * k, first))
                        hashes[some, b] = band
                n_grams = np.bincount(row, minlength=len(texts))
                no_id = np.array(batch.column(0).slice(texts.lo, len(texts)).is_null())
                none = [x is None or gone for x, gone in zip(ids, no_id.tolist(), strict=True)]
                flat = pa.array(hashes.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.lo, len(texts)),
                        batch.column(2).slice(texts.lo, len(texts)),
                        pa.array([None if gone else x for x, gone in zip(ids, none, strict=True)], pa.binary()),
                        pa.array(n_grams),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat, mask=pa.array(none)),
                    ],
                    schema=schema,
                )

    return run


def _sets(n: int):
    """The n-gram set of each text, if it is still the text of the class that was asked for."""
    schema = pa.schema([("v", pa.binary()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            want = batch.column(0)
            for texts in chunks(batch.column(1)):
                row, value = gram_sets(Words(texts, NOT_ALNUM, fold=True), n)
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                ids, asked = _class_ids(row, value, len(texts)), want.slice(texts.lo, len(texts)).to_pylist()
                keep = [r for r in range(len(texts)) if ids[r] == asked[r]]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(texts.lo, len(texts)).take(pa.array(keep, pa.int64())), pa.array([value[first[r] : first[r + 1]].tobytes() for r in keep], pa.binary())], schema=schema)

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks of bounded size."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    often = times[column] > 1
    owner, column = owner[often], column[often]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    if not len(owner):
        return total
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.concatenate([[0], np.cumsum(np.diff(column[order]) != 0)])
    width = max(64, (2 << 20) // len(sets))
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), dtype=np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        total += block @ block.T
    return total


def local_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by the links."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def groups(batches, keys: list[str]):
    """Tables of rows that agree in the keys, from batches sorted by them; only one group is held."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = [held[-1].column(held[-1].schema.names.index(k))[-1].as_py() for k in keys]
            new[0] = any(c[0] != x for c, x in zip(columns, last, strict=True))
        cuts = np.flatnonzero(new).tolist()
        lo = 0
        for at in cuts:
            if at > lo:
                held.append(batch.slice(lo, at - lo))
            if held:
                yield pa.Table.from_batches(held)
            held, lo = [], at
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _verify(threshold: float):
    schema = pa.schema([("v", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])

    def run(batches):
        for table in groups(batches, ["cell", "i", "j"]):
            ids = table["v"].to_pylist()
            where: dict[bytes, int] = {}
            for k, v in enumerate(ids):
                where.setdefault(v, k)
            keep = list(where.values())
            if len(keep) < 2:
                continue
            ids = [ids[k] for k in keep]
            part = table.take(keep)
            sets = [np.frombuffer(g.as_buffer(), U64) for g in part["grams"].combine_chunks()]
            weight = part["weight"].to_numpy()
            block = part["block"].to_numpy()
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            size = np.array([len(s) for s in sets], dtype=np.float64)
            both = shared_counts(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block[None, :]
            bands = np.array(part["bands"].to_pylist(), dtype=np.int64)
            first = part["band"].to_numpy()[0]
            if first >= 0:  # a bucket as cell: pairs that share an earlier one count there
                for b in range(int(first)):
                    linked &= bands[:, b][:, None] != bands[:, b][None, :]
            links = linked @ weight
            label = local_labels(linked)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([ids[label[k]] for k in some], pa.binary())], schema=schema)

    return run


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = RECALL, hashes: int = HASHES, block_classes: int = BLOCK_CLASSES, block_grams: int = BLOCK_GRAMS, with_mark: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_links (other documents at or above the threshold), component_id (smallest id reached by links), kept (it is that one), class_id (smallest id with an equal n-gram set).

    Words are runs of 0-9, a-z (A-Z lower-cased) and all characters from U+0080; a text of fewer
    than n words, but not none, is one n-gram.  Texts without words, null texts
    and rows with a null id link with nothing: n_links 0, component_id and
    class_id their own id, kept.  Rows that repeat an id count as documents of
    their own; equal sets are linked with each other.  Other columns are
    ignored, whatever their names; an empty table gives an empty table.

    With with_mark there are two more columns that tell rows apart that share an
    id: mark (xxhash64 of the text) and has_words (whether the row can link).
    """
    small_batches(docs)
    bands, rows = choose_bands(threshold, recall, hashes)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(texts.withColumn("mark", F.xxhash64("text")).mapInArrow(_sketch(n, bands, rows), "doc_id long, mark long, v binary, n_grams long, bands array<long>"))
    classes = cut(sketch.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).select(F.col("v").alias("key"), vertex(F.col("rep"), F.col("v")).alias("v"), "rep", "weight", "n_grams", "bands"))
    spread = classes.select("v", F.posexplode("bands").alias("band", "h"))
    buckets = cut(spread.groupBy("h").agg(F.min("v").alias("least"), F.count("*").alias("n")).where("n > 1"))
    members = spread.join(buckets, "h")
    cells = cut(components(members.select(F.col("least").alias("a"), F.col("v").alias("b"))))

    # a component as cell, or, where that would compare far more pairs, each of its buckets
    sized = cells.join(classes, "v")
    whole = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    by_bucket = buckets.join(cells, buckets["least"] == cells["v"]).groupBy("root").agg(F.sum(F.col("n").cast("double") * F.greatest(F.col("n") / block_classes, F.lit(1.0))).alias("bucket_cost"))
    plan = whole.join(by_bucket, "root").withColumn("by_bucket", F.col("n").cast("double") * F.greatest(F.col("n") / block_classes, F.lit(1.0)) > 4 * F.col("bucket_cost"))
    plan = plan.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block_classes, F.col("grams") / block_grams)))
    plan = cut(plan.select("root", "by_bucket", "blocks"))
    placed = cut(sized.join(plan, "root"))
    drop(plan)
    one = placed.where("not by_bucket").select("v", "rep", "weight", "bands", F.xxhash64("root").alias("cell"), F.lit(-1).alias("band"), "blocks")
    split = placed.where("by_bucket").select("v", "rep", "weight", "n_grams", "bands", F.posexplode("bands").alias("band", "cell"))
    per_bucket = split.groupBy("cell").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).where("n > 1").select("cell", F.ceil(F.greatest(F.col("n") / block_classes, F.col("grams") / block_grams)).alias("blocks"))
    more = split.join(per_bucket, "cell").select("v", "rep", "weight", "bands", "cell", "band", "blocks")
    members = one.unionByName(more)
    members = members.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    reps = texts.join(placed.select("v", "key", F.col("rep").alias("doc_id")), "doc_id").select("key", "text", "v")
    sets = reps.mapInArrow(_sets(n), "v binary, grams binary").groupBy("v").agg(F.first("grams").alias("grams"))
    pairs = members.select("v", "weight", "bands", "cell", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "v")
    dealt = pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(dealt.mapInArrow(_verify(threshold), "v binary, links long, label binary"))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("v").alias("a"), F.col("label").alias("b")))
    per_class = classes.select("key", "v", "rep", "weight").join(links, "v", "left").join(roots, "v", "left")
    # the smallest vertex of a component has its smallest id
    per_class = per_class.select(F.col("key").alias("v"), F.col("rep").alias("class_id"), rep_of(F.coalesce("root", "v")).alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    more = [F.col("mark"), F.col("v").isNotNull().alias("has_words")] if with_mark else []
    out = sketch.select("doc_id", "v", *(["mark"] if with_mark else [])).join(per_class, "v", "left")
    own = lambda c: F.coalesce(c, "doc_id").alias(c)
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), own("class_id"), *more)
