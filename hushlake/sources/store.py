"""Sealed tables on disk: parent and companion in Parquet, versions in manifests.

A version is a manifest that lists parts and tombstones.  Writing adds parts (and
tombstones of rows that are replaced or deleted) and then creates the next manifest, whose name
can be created only once: parent and companion change together or not at all, readers
keep the version they opened, and of two writers one gets TRANSACTION_CONFLICT.  Writing costs what it changes, and a
look at the ids that are there; compact() folds tombstones in, vacuum() removes old versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ensure, from_spark
from ..operators.companion import build_postings
from ..operators.search import Sealed, SealedTable
from ..plans.model import UNSCOPED, Registration
from . import files

WRITER = 1
POSTINGS = "_postings/tokens"
#: Bytes of rows, as they are read, that make a partition of a write; and that a core gets before it is given more than one.
PART_BYTES, CORE_BYTES = 8 << 20, 1 << 20
#: Bytes of a row group, at most: scans hold a group of each task in memory, and index rows of long texts are large.
GROUP_BYTES = 16 << 20
#: Spark gives frames of which it knows no size about 2**63 bytes.
UNKNOWN_BYTES = 1 << 50


@dataclass(frozen=True)
class Receipt:
    """What prepare_all() has found and rebuilt."""

    model: str
    version: int
    rows: int
    indexed: int


class Store:
    """Where a registration's rows are kept; with postings, selective searches look rows up instead of scanning the companion."""

    def __init__(self, spark: SparkSession, path: str, registration: Registration, sealed: Sealed, *, postings: bool = True):
        self.spark, self.path, self.registration, self.sealed, self.postings = spark, path.rstrip("/"), registration, sealed, postings

    # Manifests -----------------------------------------------------------------

    def _manifest(self) -> dict:
        found = [n for n in files.names(self.spark, self.path) if n.startswith("manifest-")]
        if not found:
            return {"version": 0, "writer": WRITER, "ring": self._ring(), "parent": [], "companion": [], "gone": [], "gone_index": [], "batches": [], "rows": 0}
        manifest = json.loads(files.read(self.spark, f"{self.path}/{found[-1]}"))
        ensure(manifest["writer"] == WRITER, "INVALID_SCHEMA")
        ensure(manifest["ring"] == self._ring(), "KEY_NOT_FOUND")
        return manifest

    def _ring(self) -> str:
        return self.sealed.ring.digest(self.registration.model)

    def _commit(self, old: dict, **changes) -> dict:
        new = {**old, **changes, "version": old["version"] + 1}
        new["postings"] = [name for name, _ in new["companion"] if name in new.get("postings", [])]
        files.create(self.spark, f"{self.path}/manifest-{new['version']:010d}.json", json.dumps(new))
        return new

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def _write(self, rows: DataFrame, kind: str, name: str | None = None) -> str:
        name = name or f"{kind}-{uuid.uuid4().hex}"
        try:
            group = self.spark.sparkContext._jsc.hadoopConfiguration().getLong("parquet.block.size", GROUP_BYTES)
            rows.write.option("parquet.block.size", min(group, GROUP_BYTES)).parquet(f"{self.path}/{name}")
        except Exception as e:
            files.remove(self.spark, f"{self.path}/{name}")
            raise from_spark(e) from e
        return name

    def _write_index(self, m: dict, rows: DataFrame) -> tuple[str, list]:
        """A part of the companion, and the names of the parts that hold postings, with this one.

        Postings lie in a folder of their part that scans of it pass over. They only propose
        rows, so those of rows that were replaced or deleted since do no harm until compact() drops them.
        """
        index, postings = self._write(rows, "index"), m.get("postings", [])
        found = build_postings(self.spark.read.parquet(f"{self.path}/{index}"), self.registration) if self.postings else None
        if found is not None:
            self._write(found, "postings", f"{index}/{POSTINGS}")
            postings = [*postings, index]
        return index, postings

    # Reading -------------------------------------------------------------------

    def _parent_schema(self) -> str:
        r = self.registration
        plain = ", ".join(f"`{c}` {t}" for c, t in self._plain_types().items())
        sealed = ", ".join(f"`{r.column(n)}` binary" for n in r.fields)
        return ", ".join(x for x in (*(f"`{k}` string" for k in r.keys), plain, sealed) if x)

    def _plain_types(self) -> dict[str, str]:
        parts = self._manifest()["parent"]
        if not parts:
            return {}
        types = dict(self.spark.read.parquet(f"{self.path}/{parts[0][0]}").dtypes)
        return {c: types[c] for c in self.registration.plain if c in types}

    def _union(self, parts: list, gone: list, keys: list[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        # parts may lack plain columns that others have
        read = lambda names: self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{n}" for n in names))
        if not gone:
            return read([n for n, _ in parts])
        dead = None
        for name, seq in gone:
            part = read([name]).select(*(F.col(k).alias(f"__gone_{k}") for k in keys), F.lit(seq).alias("__gone_seq"))
            dead = part if dead is None else dead.unionByName(part)
        dead = dead.groupBy(*(f"__gone_{k}" for k in keys)).agg(F.max("__gone_seq").alias("__gone_seq"))
        out = None
        for seq in sorted({s for _, s in parts}):
            part = read([n for n, s in parts if s == seq]).withColumn("__seq", F.lit(seq))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        same = [F.col(k) == F.col(f"__gone_{k}") for k in keys]
        return out.join(dead, [*same, F.col("__seq") < F.col("__gone_seq")], "left_anti").drop("__seq")

    def table(self) -> SealedTable:
        """The newest version."""
        return self._table(self._manifest())

    def _table(self, m: dict) -> SealedTable:
        schema = ", ".join(f"`{c}` {t}" for c, t in self.registration.companion_schema().items())
        parent = self._union(m["parent"], m["gone"], self.registration.keys, self._parent_schema())
        names = [name for name, _ in m["companion"]]
        # only whole: a part without postings would be missed
        whole = names and set(names) <= set(m.get("postings", []))
        postings = self.spark.read.schema("token long, row_id string").parquet(*(f"{self.path}/{n}/{POSTINGS}" for n in names)) if whole else None
        return SealedTable(self.registration, parent, self._union(m["companion"], m["gone_index"], ["scope_id", "row_id"], schema), postings)

    def _index_keys(self, rows: DataFrame) -> DataFrame:
        r = self.registration
        return rows.select((F.col(r.scope) if r.scope else F.lit(UNSCOPED)).alias("scope_id"), F.col(r.row).alias("row_id"))

    # Writing -------------------------------------------------------------------

    def _ready(self, rows: DataFrame, known: bool = False) -> DataFrame:
        r = self.registration
        allowed = {*r.keys, *r.plain, *r.fields}
        ensure(set(rows.columns) <= allowed and len(set(rows.columns)) == len(rows.columns))
        ensure(r.scope is None or r.scope in rows.columns)
        if r.row not in rows.columns:
            ensure(r.row_type == "uuid" and not known, "INVALID_ID")
            rows = rows.withColumn(r.row, F.uuid())
        return rows

    def _distinct(self, rows: DataFrame) -> None:
        twice = rows.groupBy(*self._identity()).count().where("count > 1").limit(1).count()
        ensure(not twice, "CONSTRAINT_VIOLATION")

    def _identity(self) -> list[str]:
        return [self.registration.row] if self.registration.unique_row else self.registration.keys

    def _add(self, m: dict, rows: DataFrame) -> dict:
        """Parts of new rows: the companion is built from what was written and opens, not from the caller's rows."""
        r, seq = self.registration, m["version"] + 1
        parent = self._write(self.sealed.seal_parent(self._spread(rows), r).sortWithinPartitions(*r.keys), "parent")
        written = self.spark.read.parquet(f"{self.path}/{parent}")
        plain = self.sealed.open(written, r)
        index, postings = self._write_index(m, self.sealed.companion_of(plain, r).sortWithinPartitions("scope_id", "row_id")) if r.profiles else (None, m.get("postings", []))
        return {"parent": [*m["parent"], [parent, seq]], "companion": [*m["companion"], *([[index, seq]] if index else [])], "postings": postings, "written": written}

    def _spread(self, rows: DataFrame) -> DataFrame:
        """The rows over all cores, whatever partitions they come in: sealing and indexing take far longer than reading, and a file of one row group is one task."""
        # in ranges, so that scans still skip by scope and row; the size is that of what is read, since sizes of joins are products
        leaves, size = rows._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
        while leaves.hasNext():
            size += int(leaves.next().stats().sizeInBytes())
        cores = self.spark.sparkContext.defaultParallelism
        if size >= UNKNOWN_BYTES:
            return rows.repartitionByRange(*self.registration.keys)  # as many as its bytes turn out to need
        return rows.repartitionByRange(cores if size < cores * CORE_BYTES else max(3 * cores, -(-size // PART_BYTES)), *self.registration.keys)

    def _inserted(self, m: dict, rows: DataFrame) -> tuple[dict, DataFrame]:
        """The manifest with new rows, not yet committed, and what was written."""
        if m["version"]:
            old = self._table(m).parent.select(*self._identity())
            if self.registration.row in rows.columns:
                ensure(not rows.join(old, self._identity(), "left_semi").limit(1).count(), "CONSTRAINT_VIOLATION")
        added = self._add(m, rows)
        written = added.pop("written")
        self._distinct(written)
        return {**m, **added, "rows": m["rows"] + written.count()}, written

    def insert(self, rows: DataFrame, *, returning: bool = False, batch: str | None = None) -> DataFrame | None:
        """Seal and add rows; missing UUIDs are made, omitted nullable fields are null.  A named batch is added once."""
        m, rows = self._manifest(), self._ready(rows)
        if batch is not None and batch in m["batches"]:
            return None
        ensure(batch is not None or rows.limit(1).count())
        new, written = self._inserted(m, rows)
        self._commit(new, batches=[*m["batches"], *([batch] if batch is not None else [])])
        return written if returning else None

    def update(self, patch: DataFrame, *, must_exist: bool = True) -> int:
        """Replace the given fields of rows named by their keys; what is not given keeps its ciphertext and its proofs."""
        m, patch = self._manifest(), self._ready(patch, known=True)
        new, n = self._updated(m, patch, must_exist)
        if n:
            self._commit(new)
        return n

    def _updated(self, m: dict, patch: DataFrame, must_exist: bool) -> tuple[dict, int]:
        """The manifest with replaced rows, not yet committed, and their number."""
        r = self.registration
        given = [c for c in patch.columns if c not in r.keys]
        ensure(given)
        self._distinct(patch)
        table, seq = self._table(m), m["version"] + 1
        keys = patch.select(*r.keys)
        old = table.parent.join(keys, r.keys, "left_semi")
        n = old.count()
        ensure(not must_exist or n == patch.count(), "NOT_FOUND")
        if not n:
            return m, 0
        patch = patch.join(old.select(*r.keys), r.keys, "left_semi")
        fields = [c for c in given if c in r.fields]
        fresh = self.sealed.seal_parent(patch, r, fields)
        replaced = [r.column(c) if c in r.fields else c for c in given]
        kept = old.drop(*replaced)
        parent = self._write(kept.join(fresh, r.keys).select(*table.parent.columns), "parent")
        written = self.spark.read.parquet(f"{self.path}/{parent}")
        changes = {"parent": [*m["parent"], [parent, seq]], "gone": [*m["gone"], [self._write(written.select(*r.keys), "gone"), seq]]}
        touched = [p for name, p in r.profiles if name in fields]
        if touched:
            opened = self.sealed.open(written, r)
            built = self.sealed.companion_of(opened, r)
            new_columns = [c for p in touched for c in p.columns]
            fresh_index = built.select("scope_id", "row_id", *new_columns)
            rest = [c for c in table.companion.columns if c not in ("scope_id", "row_id", *new_columns)]
            ids = self._index_keys(written)
            old_index = table.companion.join(ids, ["scope_id", "row_id"], "left_semi").select("scope_id", "row_id", *rest)
            merged = ids.join(fresh_index, ["scope_id", "row_id"], "left").join(old_index, ["scope_id", "row_id"], "left").select(*table.companion.columns)
            some = [F.col(next(c for c in p.columns if "len" in c or "stamp" in c)).isNotNull() for _, p in r.profiles]
            live = some[0]
            for x in some[1:]:
                live = live | x
            index, postings = self._write_index(m, merged.where(live))
            changes |= {"postings": postings, "companion": [*m["companion"], [index, seq]], "gone_index": [*m["gone_index"], [self._write(ids, "gone"), seq]]}
        return {**m, **changes}, n

    def upsert(self, rows: DataFrame) -> tuple[int, int]:
        """(inserted, updated): rows that are there take the given values, the others are added, in one commit; a row of another scope is SCOPE_CONFLICT."""
        r, rows, m = self.registration, self._ready(rows, known=True), self._manifest()
        table = self._table(m)
        if r.scope and r.unique_row:
            held = table.parent.select(F.col(r.row), F.col(r.scope).alias("__scope"))
            ensure(not rows.join(held, r.row).where(F.col(r.scope) != F.col("__scope")).limit(1).count(), "SCOPE_CONFLICT")
        self._distinct(rows)
        there = rows.join(table.parent.select(*r.keys), r.keys, "left_semi")
        new = rows.join(table.parent.select(*r.keys), r.keys, "left_anti")
        n_new = new.count()
        changed, updated = self._updated(m, there, False) if set(rows.columns) - set(r.keys) else (m, there.count())
        if n_new:
            # of the same version: the tombstones of the update do not reach these parts
            changed, _ = self._inserted(changed, new)
        if changed is not m:
            self._commit(changed)
        return n_new, updated

    def delete(self, match=None, *, scope: str | None = None, where=None, rows: DataFrame | None = None) -> int:
        """Remove rows, by the same predicates that find them or by their keys; the companion follows."""
        r, m = self.registration, self._manifest()
        table, seq = self._table(m), m["version"] + 1
        found = table.parent.join(rows.select(*r.keys), r.keys, "left_semi") if rows is not None else self.sealed.where(table, match, scope=scope, where=where)
        gone = self._write(found.select(*r.keys), "gone")
        keys = self.spark.read.parquet(f"{self.path}/{gone}")
        n = keys.count()
        if n:
            index = self._write(self._index_keys(keys), "gone")
            self._commit(m, gone=[*m["gone"], [gone, seq]], gone_index=[*m["gone_index"], [index, seq]], rows=m["rows"] - n)
        return n

    def reindex(self, scope: str | None = None) -> int:
        """Open every row (of a scope) and build its companion anew; returns the rows visited."""
        r, m = self.registration, self._manifest()
        table, seq = self._table(m), m["version"] + 1
        parent = table.parent if scope is None else table.parent.where(F.col(r.scope) == r.scope_value(scope))
        index, postings = self._write_index(m, self.sealed.companion_of(self.sealed.open(parent, r), r).sortWithinPartitions("scope_id", "row_id"))
        if scope is None:
            self._commit(m, companion=[[index, seq]], postings=postings, gone_index=[])
        else:
            gone = self._write(table.companion.where(F.col("scope_id") == scope).select("scope_id", "row_id"), "gone")
            self._commit(m, companion=[*m["companion"], [index, seq]], postings=postings, gone_index=[*m["gone_index"], [gone, seq]])
        return parent.count()

    def compact(self) -> None:
        """Fold all parts and tombstones into one part each."""
        m = self._manifest()
        table, seq = self._table(m), m["version"] + 1
        parent = self._write(table.parent.sortWithinPartitions(*self.registration.keys), "parent")
        index, postings = self._write_index(m, table.companion.sortWithinPartitions("scope_id", "row_id"))
        self._commit(m, parent=[[parent, seq]], companion=[[index, seq]], postings=postings, gone=[], gone_index=[])

    def vacuum(self, *, keep: int = 10, older_s: float = 86_400) -> int:
        """Remove all but the newest versions, and files that none of these names; files younger than older_s may belong to a writer and stay. Returns how many names went."""
        ensure(keep >= 1)
        ages = files.ages(self.spark, self.path)
        versions = sorted(n for n in ages if n.startswith("manifest-"))
        kept = [json.loads(files.read(self.spark, f"{self.path}/{n}")) for n in versions[-keep:]]
        named = {name for m in kept for k in ("parent", "companion", "gone", "gone_index") for name, _ in m[k]} | set(versions[-keep:])
        gone = [n for n, age in ages.items() if n not in named and age >= older_s and n.startswith(("manifest-", "parent-", "index-", "gone-", "writing-"))]
        for n in sorted(gone, key=lambda n: not n.startswith("manifest-")):  # first the manifests that name the others
            files.remove(self.spark, f"{self.path}/{n}")
        return len(gone)

    def preflight(self) -> int:
        """Check what is on disk against the registration; returns the number of rows."""
        r, table = self.registration, self.table()
        types = dict(table.parent.dtypes)
        ensure(all(types.get(k) == "string" for k in r.keys) and all(types.get(r.column(n)) == "binary" for n in r.fields), "INVALID_SCHEMA")
        wanted = {c: t.replace("long", "bigint") for c, t in r.companion_schema().items()}
        ensure(dict(table.companion.dtypes) == wanted, "INVALID_SCHEMA")
        row = table.parent.agg(F.count("*").alias("n"), F.count_distinct(*self._identity()).alias("ids")).first()
        ensure(row["n"] == row["ids"], "CONSTRAINT_VIOLATION")
        return row["n"]


def prepare_all(stores: list[Store]) -> list[Receipt]:
    """Check all stores, rebuild all companions, and prove that no row was missed; nothing is rebuilt unless all checks hold."""
    ensure(stores)
    before = [s.preflight() for s in stores]
    out = []
    for store, rows in zip(stores, before, strict=True):
        visited, after = store.reindex(), store.preflight()
        ensure(rows == visited == after, "REBUILD_INCOMPLETE")
        out.append(Receipt(store.registration.model, store.version, visited, store.table().companion.count()))
    return out
