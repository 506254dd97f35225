"""Vectors of one label with a cosine similarity of at least a threshold, one kept for each group.

Spherical k-means cuts the unit sphere into cells; vectors meet only in cells,
as products of blocks.  No link is lost at the borders: a vector also visits
every cell (with a smaller number than its own) that may own a vector within
reach.  That is the case only if its distance to the plane between the two
centroids is at most the sine of the threshold angle, and its angle to the other
centroid at most that angle and the radius of the cell, both of which follow
from the triangle inequality on the sphere.

Equal vectors are one class from the start, so copies never meet.  A cell is cut
into blocks by hash, each pair of blocks is a group of its own, and what
leaves a group is one row for each class with the number of its links and its label
within the group, so neither a label nor a cell that holds a third of all rows
makes a large task, and no pairs are written.

The centroids are fitted on the driver on at most `sample` classes, the first by
hash (a documented, fixed bound); they decide only how the work is cut, never
which links are found.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, rep_of, vertex
from .ngram_join import groups, local_labels
from .scratch import cut, small_batches

THRESHOLD = 0.93
SAMPLE = 20_000
#: Cells for each label: the root of its largest number of classes over CELL_SHARE.
CELL_SHARE, MOST_CELLS = 16, 1024
BLOCK = 2048


def _units(batches):
    """Class and unit vector of each row that can link: a label, no null or non-finite component, not zero."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("label", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])
    for batch in batches:
        label, column = batch.column(1), batch.column(2)
        n = batch.num_rows
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        value = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
        ends = np.cumsum(sizes)
        usable = np.array(label.is_valid()) & (sizes > 0)
        ids: list[bytes | None] = [None] * n
        units: list[bytes | None] = [None] * n
        for size in np.unique(sizes[usable]):
            rows = np.flatnonzero(usable & (sizes == size))
            x = value[(ends[rows] - size)[:, None] + np.arange(size)]
            largest = np.abs(x).max(axis=1)
            good = np.isfinite(x).all(axis=1) & (largest > 0)
            y = x[good] / largest[good][:, None]
            y /= np.sqrt((y * y).sum(axis=1))[:, None]
            for r, raw, unit in zip(rows[good].tolist(), x[good], y, strict=True):
                ids[r] = hashlib.md5(b"%d:" % label[r].as_py() + raw.tobytes(), usedforsecurity=False).digest()
                units[r] = unit.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), label.cast(pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(units, pa.binary())], schema=schema)


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k unit centroids; an empty cell takes the vector that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1))
        lost = np.flatnonzero(norm < 1e-9)
        if len(lost):
            fit = (x * centroids[own]).sum(axis=1)
            total[lost], norm[lost] = x[np.argsort(fit)[: len(lost)]], 1
        centroids = total / norm[:, None]
    return centroids


def _assigned(centroids: dict[int, np.ndarray], radius: dict[tuple[int, int], float] | None, angle: float):
    """Own cell and cosine to its centroid of each class; with the radii also a row for each cell that it visits."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            dims = batch.column(names.index("dim")).to_numpy()
            units = batch.column(names.index("unit")).to_pylist()
            take, cells, owned, near = [], [], [], []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[r] for r in rows), np.float64).reshape(len(rows), dim)
                c = centroids.get(int(dim))
                if c is None:
                    c = np.eye(1, int(dim))
                cos = x @ c.T
                own = cos.argmax(axis=1)
                best = cos[np.arange(len(rows)), own]
                take.append(rows)
                cells.append(own)
                owned.append(np.ones(len(rows), dtype=bool))
                near.append(best)
                if radius is not None:
                    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))[own]
                    reach = np.array([radius.get((int(dim), j), -1.0) for j in range(len(c))])
                    visit = (best[:, None] - cos <= math.sin(angle) * apart + 1e-9) & (np.arange(len(c))[None, :] < own[:, None]) & (reach >= 0)[None, :]
                    visit &= np.arccos(np.clip(cos, -1, 1)) <= angle + reach[None, :] + 1e-6
                    r, j = np.nonzero(visit)
                    take.append(rows[r])
                    cells.append(j)
                    owned.append(np.zeros(len(r), dtype=bool))
                    near.append(cos[r, j])
            if take:
                part = batch.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(owned)), pa.array(np.concatenate(near))], names=[*names, "cell", "owned", "near"])

    return run


def _compare(threshold: float):
    schema = pa.schema([("v", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])

    def run(batches):
        for table in groups(batches, ["label", "dim", "cell", "i", "j"]):
            if table.num_rows < 2:
                continue
            ids = table["v"].to_pylist()
            x = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
            own = np.flatnonzero(table["owned"].to_numpy(zero_copy_only=False).astype(bool))
            weight = table["weight"].to_numpy()
            linked = x[own] @ x.T >= threshold
            linked[np.arange(len(own)), own] = False
            if table["i"][0] != table["j"][0]:
                block = table["block"].to_numpy()
                linked &= block[own][:, None] != block[None, :]
            links = weight[own] @ linked  # right for visitors; owned rows follow
            links[own] = linked @ weight
            some = np.flatnonzero(links)
            if not len(some):
                continue
            square = np.zeros((len(ids), len(some)), dtype=bool)
            square[own] = linked[:, some]
            square = square[some]
            label = some[local_labels(square | square.T)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([ids[k] for k in label], pa.binary())], schema=schema)

    return run


def dedup_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, cell_share: float = CELL_SHARE, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links (others with the same label and a cosine of at least the threshold), component_id (smallest vec_id reachable by links), kept (it is that one).

    A vector that is null, empty, zero or holds a null or non-finite component, or
    whose label or id is null, links with nothing: n_links 0, component_id its
    own id, kept.  Vectors of different lengths do not link.  Equal vectors of a label are links of each other, rows
    that repeat an id count as vectors of their own.  Other columns are ignored, whatever their
    names; an empty table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    small_batches(vectors)
    angle = math.acos(threshold)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col).isNotNull(), F.col(label_col).cast("long")).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = "vec_id long, v binary, label long, dim int, unit binary"
    units = cut(rows.mapInArrow(_units, schema))
    classes = cut(units.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")).select(F.col("v").alias("key"), vertex(F.col("rep"), F.col("v")).alias("v"), "rep", "weight", "label", "dim", "unit"))
    sizes = classes.groupBy("label", "dim").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    n, k = sizes["all"], int(min(MOST_CELLS, max(1, math.ceil(math.sqrt(sizes["most"]) / cell_share))))
    centroids: dict[int, np.ndarray] = {}
    if k > 1:
        picked: dict[int, list[bytes]] = {}
        for r in classes.select("dim", "unit").orderBy(F.xxhash64("v"), "v").limit(sample).toLocalIterator():
            picked.setdefault(r["dim"], []).append(bytes(r["unit"]))
        for dim, some in picked.items():
            centroids[dim] = spherical_k_means(np.frombuffer(b"".join(some), np.float64).reshape(-1, dim), max(1, k * len(some) // min(n, sample)))
    with_cell = "v binary, weight long, label long, dim int, unit binary, cell long, owned boolean, near double"
    inputs = classes.select("v", "weight", "label", "dim", "unit")
    # one row for each centroid: bounded by MOST_CELLS for each length of vector
    radii = inputs.mapInArrow(_assigned(centroids, None, angle), with_cell).groupBy("dim", "cell").agg(F.min("near").alias("near"))
    radius = {(r["dim"], r["cell"]): math.acos(max(-1.0, min(1.0, r["near"]))) for r in radii.toLocalIterator()}
    placed = cut(inputs.mapInArrow(_assigned(centroids, radius, angle), with_cell))
    blocks = cut(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")))
    members = placed.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = members.select("v", "weight", "label", "dim", "unit", "cell", "owned", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["label", "dim", "cell", "i", "j"]
    found = cut(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "v binary, links long, label binary"))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("v").alias("a"), F.col("label").alias("b")))
    per_class = classes.select("key", "v", "weight").join(links, "v", "left").join(roots, "v", "left")
    # the smallest vertex of a component has its smallest id
    per_class = per_class.select(F.col("key").alias("v"), rep_of(F.coalesce("root", "v")).alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = units.select("vec_id", "v").join(per_class, "v", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
