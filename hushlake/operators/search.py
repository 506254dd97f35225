"""Sealed tables and what can be asked of them: where, condition, count, find_many, search, open."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SealError, ensure, from_spark
from ..functions import codec
from ..functions.crypto import SHARDS, FieldCipher, shard_col
from ..functions.framing import canonical
from ..functions.keys import Keyring
from ..plans.cursor import open_cursor, query_digest, seal_cursor
from ..plans.model import UNSCOPED, UUID_PATTERN, Registration
from ..plans.predicate import Compiler, Group, Match, Node, Plain, fingerprint, secure, validate
from .companion import build_companion

SAFE_COUNT = 2**53 - 1
#: Candidates that a look-up may give; beyond that a scan is the better plan.
LOOKUP_ROWS = 256
#: Bytes of a companion from which a look-up is worth its job.
LOOKUP_BYTES = 256 << 20
#: Tokens that a look-up may ask for.
LOOKUP_TOKENS = 24
#: Types that rows may be ordered and paged by.
_ORDERED = ("tinyint", "smallint", "int", "bigint", "decimal", "string", "date", "timestamp", "timestamp_ntz", "boolean")


@dataclass(frozen=True)
class Budgets:
    """Limits of one page; a page that runs into one ends early and can be continued."""

    batch: int | None = None
    fetch_bytes: int | None = None
    decrypted_bytes: int | None = None
    result_bytes: int | None = None
    deadline_ms: int | None = None

    def __post_init__(self):
        for value in (self.batch, self.fetch_bytes, self.decrypted_bytes, self.result_bytes, self.deadline_ms):
            ensure(value is None or isinstance(value, int) and value > 0)


@dataclass(frozen=True)
class Page:
    items: list[dict]
    next_cursor: str | None


@dataclass(frozen=True)
class Order:
    column: str
    direction: str = "asc"


@dataclass(frozen=True)
class SealedTable:
    """A registration with its parent, its companion and, where they are kept, the postings of the companion's tokens."""

    registration: Registration
    parent: DataFrame
    companion: DataFrame
    postings: DataFrame | None = None


@dataclass(frozen=True)
class SearchParts:
    """What a caller's join gets: parents reduced to what matches, the order, and the position to go on after."""

    tables: dict[str, DataFrame]
    keyset: list[str]
    finish: Callable[[DataFrame], DataFrame] = field(repr=False)
    limit: int | None = None


def _action(run):
    try:
        return run()
    except SealError:
        raise
    except Exception as e:  # whatever the executors raise becomes a code
        raise from_spark(e) from e


def _without_secure(node: Node, trees: list[Node]) -> Node:
    """The tree with columns __hl_0, __hl_1, ... for its purely encrypted parts, which are added to the list."""
    if isinstance(node, Plain):
        return node
    if secure(node):
        trees.append(node)
        return Plain(F.col(f"__hl_{len(trees) - 1}"))
    return Group(node.op, tuple(_without_secure(c, trees) for c in node.children))


class Sealed:
    """The engine for one key ring; companions of fewer than lookup_bytes are scanned, whatever index there is."""

    def __init__(self, ring: Keyring, *, lookup_bytes: int = LOOKUP_BYTES):
        self.ring, self.lookup_bytes = ring, lookup_bytes
        self._ciphers: dict[tuple, FieldCipher] = {}
        self._tables: dict[tuple, DataFrame] = {}

    # Sealing -----------------------------------------------------------------

    def _cipher(self, registration: Registration, name: str) -> FieldCipher:
        spec = registration.fields[name]
        key = registration.model, registration.field_id(name), spec.kind, spec.parameters
        if key not in self._ciphers:
            self._ciphers[key] = FieldCipher(self.ring, *key)
        return self._ciphers[key]

    def _keyed(self, rows: DataFrame, registration: Registration, names: list[str], row: str) -> DataFrame:
        """The rows with a key for each of the fields: from a table of SHARDS rows that is broadcast, so that no plan, event log or UI shows a key."""
        if not names:
            return rows
        spark = rows.sparkSession
        key = (id(spark), registration.model, *((n, registration.field_id(n), registration.fields[n].kind, registration.fields[n].parameters) for n in names))
        if key not in self._tables:
            keys = {f"__hl_key_{n}": pa.array(self._cipher(registration, n).keys, pa.binary()) for n in names}
            self._tables[key] = spark.createDataFrame(pa.table({"__hl_shard": pa.array(range(SHARDS), pa.int32()), **keys}))
        table = self._tables[key]
        return rows.join(F.broadcast(table), shard_col(F.col(f"`{row}`")) == F.col("__hl_shard"), "left")

    def _checked_keys(self, rows: DataFrame, registration: Registration) -> DataFrame:
        for name, kind in ((registration.row, registration.row_type), (registration.scope, registration.scope_type)):
            if name:
                c = F.col(name)
                ok = c.isNotNull() & (c != "") & ~F.contains(c, F.lit("\0"))
                if kind == "uuid":
                    ok = ok & c.rlike(UUID_PATTERN)
                rows = rows.withColumn(name, F.when(ok, c).otherwise(F.raise_error(F.lit("HUSHLAKE INVALID_ID")).cast("string")))
        return rows

    def seal_parent(self, rows: DataFrame, registration: Registration, fields: list[str] | None = None) -> DataFrame:
        """The parent's columns, with the fields' values sealed; fields not given in the rows are null."""
        fields = list(registration.fields) if fields is None else fields
        keyed = self._keyed(self._checked_keys(rows, registration), registration, [n for n in fields if n in rows.columns], registration.row)
        scope = F.col(registration.scope) if registration.scope else F.lit(UNSCOPED)
        out = []
        for name in fields:
            spec = registration.fields[name]
            if name not in rows.columns:
                ensure(spec.nullable, "INVALID_VALUE", name)
                out.append(F.lit(None).cast("binary").alias(registration.column(name)))
                continue
            value = F.col(name)
            raw = codec.encode_col(spec.kind, value, spec.precision, spec.scale)
            bad = F.lit(False) if spec.nullable else value.isNull()
            if spec.max_bytes is not None:
                raw = F.when(F.octet_length(raw) > spec.max_bytes, F.raise_error(F.lit(f"HUSHLAKE LIMIT_EXCEEDED: {name}")).cast("binary")).otherwise(raw)
            raw = F.when(bad, F.raise_error(F.lit(f"HUSHLAKE INVALID_VALUE: {name}")).cast("binary")).otherwise(raw)
            if spec.validate is not None:
                raw = F.when(value.isNotNull() & ~spec.validate.check(value), F.raise_error(F.lit(f"HUSHLAKE VALIDATION_FAILED: {name}")).cast("binary")).otherwise(raw)
            out.append(self._cipher(registration, name).seal(raw, scope, F.col(registration.row), F.col(f"__hl_key_{name}")).alias(registration.column(name)))
        return keyed.select(*registration.keys, *(c for c in registration.plain if c in rows.columns), *out)

    def companion_of(self, rows: DataFrame, registration: Registration, **options) -> DataFrame:
        return build_companion(rows, registration, self.ring, **options)

    def open(self, rows: DataFrame, registration: Registration, *, columns: dict[str, str] | None = None, row: str | None = None, scope: str | None = None, strict: bool = True) -> DataFrame:
        """The rows with their sealed columns opened in place.

        By default every sealed column that is there becomes a column with its field's name; columns
        maps field names to the columns that hold them (binary, or hex text after \\x) where they were renamed, and row and
        scope name the columns of the row's identity and its tenant.  Do it before a join that repeats rows.
        """
        row, scope = row or registration.row, scope or registration.scope
        ensure(row in rows.columns and (scope is None or scope in rows.columns), "ROW_CONTEXT_MISSING")
        where = {n: registration.column(n) for n in registration.fields if registration.column(n) in rows.columns} if columns is None else columns
        ensure(set(where) <= set(registration.fields) and set(where.values()) <= set(rows.columns))
        scope_col = F.col(f"`{scope}`") if scope else F.lit(UNSCOPED)
        opened, types = {}, dict(rows.dtypes)
        for name, column in where.items():
            spec = registration.fields[name]
            sealed = F.col(f"`{column}`")
            if types[column] == "string":
                # as drivers write binary values: \\x and pairs of hex digits
                bad = F.raise_error(F.lit(f"HUSHLAKE INVALID_VALUE: {name}")).cast("binary") if strict else F.lit(None).cast("binary")
                sealed = F.when(sealed.isNull() | sealed.rlike(r"^\\x(?:[0-9a-fA-F]{2})*$"), F.unhex(F.substring(sealed, 3, 1 << 30))).otherwise(bad)
            raw = self._cipher(registration, name).open(sealed, scope_col, F.col(f"`{row}`"), strict, F.col(f"__hl_key_{name}"))
            opened[column] = codec.decode_col(spec.kind, raw, spec.precision, spec.scale).alias(name if columns is None else column)
        keyed = self._keyed(rows, registration, list(where), row)
        return keyed.select(*(opened.get(c, F.col(f"`{c}`")) for c in rows.columns))

    def open_rows(self, rows: DataFrame, registration: Registration, *, max_rows: int | None = None, max_bytes: int | None = None, deadline_ms: int | None = None, **options) -> list[dict]:
        """open() brought to the driver, all or nothing: beyond a limit it is LIMIT_EXCEEDED."""
        budgets = Budgets(batch=max_rows, fetch_bytes=max_bytes, deadline_ms=deadline_ms)
        sealed = [c for c in (options.get("columns") or {n: registration.column(n) for n in registration.fields}).values() if c in rows.columns]
        size = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in sealed), F.lit(0))
        few = rows if max_rows is None else rows.limit(max_rows + 1)
        opened = self.open(few.withColumn("__hl_size", size), registration, **options)
        found = [r.asDict() for r in self._within(opened, opened.collect, budgets, None)]
        ensure(max_rows is None or len(found) <= max_rows, "LIMIT_EXCEEDED")
        ensure(sum(r.pop("__hl_size") for r in found) <= (max_bytes or float("inf")), "LIMIT_EXCEEDED")
        return found

    # Predicates ----------------------------------------------------------------

    def _node(self, registration: Registration, match: Callable[[Match], Node] | None) -> Node | None:
        if match is None:
            return None
        node = match(Match(registration))
        validate(node, registration)
        return node

    def condition(self, registration: Registration, match: Callable[[Match], Node], *, scope: str | None = None, prefix: str = "") -> Column:
        """The predicate as a column over a companion, or over a frame that it was joined to; null where a field is null."""
        node = self._node(registration, match)
        ensure(node is not None)
        return Compiler(registration, self.ring, registration.scope_value(scope), prefix).column(node)

    def _scoped(self, table: SealedTable, scope: str, side: str) -> DataFrame:
        r = table.registration
        if side == "companion":
            return table.companion.where(F.col("scope_id") == scope)
        return table.parent.where(F.col(r.scope) == scope) if r.scope else table.parent

    def _candidates(self, table: SealedTable, node: Node | None, scope_id: str) -> list[str] | None:
        """Row ids that hold all matches, where the postings of some token of each clause are few; None where a scan is the better plan.

        One job over the row groups that the tokens fall into, of at most LOOKUP_ROWS + 1 rows a token. The
        literal ids reach the scans of companion and parent, so pruning goes by them too; for
        that the session's limit of values pushed to Parquet is raised to LOOKUP_ROWS.
        """
        clauses = Compiler(table.registration, self.ring, scope_id).clauses(node) if node is not None and table.postings is not None else None
        if not clauses or len(set().union(*clauses)) > LOOKUP_TOKENS:
            return None
        if int(table.companion._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < self.lookup_bytes:
            return None
        tokens = sorted(set().union(*clauses))
        few = [table.postings.where(F.col("token") == t).limit(LOOKUP_ROWS + 1) for t in tokens]
        rows = _action(reduce(DataFrame.unionAll, few).collect)
        ids = {t: [r.row_id for r in rows if r.token == t] for t in tokens}
        rarest = [min((ids[t] for t in clause), key=len) for clause in clauses]
        found = sorted({i for part in rarest for i in part})
        if len(found) > LOOKUP_ROWS or any(len(part) > LOOKUP_ROWS for part in rarest):
            return None
        conf, most = table.companion.sparkSession.conf, "spark.sql.parquet.pushdown.inFilterThreshold"
        if int(conf.get(most)) < LOOKUP_ROWS:
            conf.set(most, str(LOOKUP_ROWS))
        return found

    def _narrowed(self, table: SealedTable, node: Node | None, scope_id: str) -> SealedTable:
        """The table without the rows that the postings rule out."""
        found = self._candidates(table, node, scope_id)
        if found is None:
            return table
        among = lambda rows, c: rows.where(F.col(c).isin(found) if found else F.lit(False))
        return SealedTable(table.registration, among(table.parent, table.registration.row), among(table.companion, "row_id"))

    def where(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, scope: str | None = None, where: Column | None = None) -> DataFrame:
        """The parent's rows that match, sealed as they are.

        A tree of encrypted predicates alone becomes one semi-join with the companion's matching
        rows; where plain conditions are mixed in, the companion is joined and the whole tree is one filter.
        """
        r = table.registration
        scope_id, node = r.scope_value(scope), self._node(r, match)
        table = self._narrowed(table, node, scope_id)
        parent = self._scoped(table, scope_id, "parent")
        if where is not None:
            parent = parent.where(where)
        if node is None:
            return parent
        found = Compiler(r, self.ring, scope_id, "").column(node) if secure(node) else None
        if found is not None:
            ids = self._scoped(table, scope_id, "companion").where(found).select(F.col("row_id").alias(r.row))
            return parent.join(ids, r.row, "left_semi")
        # what is encrypted is decided on the companion: the join moves a Boolean for each such tree, not the index
        trees: list[Node] = []
        outer = _without_secure(node, trees)
        compiler = Compiler(r, self.ring, scope_id)
        index = self._scoped(table, scope_id, "companion").select(F.col("row_id").alias("__hl_row"), *(compiler.column(t).alias(f"__hl_{i}") for i, t in enumerate(trees)))
        joined = parent.join(index, F.col(r.row) == F.col("__hl_row"), "left")
        return joined.where(compiler.column(outer)).select(*parent.columns)

    # Reading -------------------------------------------------------------------

    def count_rows(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, scope: str | None = None, where: Column | None = None) -> DataFrame:
        """One row with `count`: from the companion alone where no plain condition needs the parent; nothing is opened."""
        r = table.registration
        node = self._node(r, match)
        if node is not None and where is None and secure(node):
            scope_id = r.scope_value(scope)
            table = self._narrowed(table, node, scope_id)
            rows = self._scoped(table, scope_id, "companion").where(Compiler(r, self.ring, scope_id).column(node))
        else:
            rows = self.where(table, match, scope=scope, where=where)
        return rows.agg(F.count("*").alias("count"))

    def count(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, scope: str | None = None, where: Column | None = None, budgets: Budgets | None = None, cancelled: Callable[[], bool] | None = None) -> int:
        rows = self.count_rows(table, match, scope=scope, where=where)
        n = self._within(rows, lambda: rows.collect()[0]["count"], budgets or Budgets(), cancelled)
        ensure(n <= SAFE_COUNT, "LIMIT_EXCEEDED")
        return n

    def _within(self, rows: DataFrame, run, budgets: Budgets, cancelled):
        """Run an action; past the deadline its Spark jobs are cancelled."""
        ensure(not (cancelled and cancelled()), "CANCELLED")
        if budgets.deadline_ms is None:
            return _action(run)
        sc, tag, late = rows.sparkSession.sparkContext, f"hushlake-{time.monotonic_ns()}", threading.Event()
        timer = threading.Timer(budgets.deadline_ms / 1000, lambda: (late.set(), sc.cancelJobsWithTag(tag)))
        sc.addJobTag(tag)
        timer.start()
        try:
            out = _action(run)
            ensure(not late.is_set(), "LIMIT_EXCEEDED")
            return out
        except SealError as e:
            if late.is_set():
                raise SealError("LIMIT_EXCEEDED") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def _orders(self, table: SealedTable, order_by) -> list[Order]:
        r = table.registration
        orders = [o if isinstance(o, Order) else Order(*((o,) if isinstance(o, str) else o)) for o in ([] if order_by is None else order_by if isinstance(order_by, list) else [order_by])]
        ensure(order_by is None or orders)
        types = dict(table.parent.dtypes)
        sealed = {r.column(n) for n in r.fields}
        for o in orders:
            ensure(o.column in types and o.column not in sealed and o.direction in ("asc", "desc") and types[o.column].split("(")[0] in _ORDERED)
        ensure(len({o.column for o in orders}) == len(orders))
        if not any(o.column == r.row for o in orders):
            orders.append(Order(r.row, orders[-1].direction if orders else "asc"))
        return orders

    @staticmethod
    def sort_columns(orders: list[Order]) -> list[Column]:
        """Ascending puts nulls last and descending first."""
        return [F.col(o.column).asc_nulls_last() if o.direction == "asc" else F.col(o.column).desc_nulls_first() for o in orders]

    @staticmethod
    def after(orders: list[Order], types: dict[str, str], position: list) -> Column:
        """Rows that come later than a position; the first column also stands alone so that scans can skip by it."""
        ensure(len(position) == len(orders), "CURSOR_INVALID")
        values = [F.lit(None if v is None else v).cast(types[o.column]) for o, v in zip(orders, position, strict=True)]
        found = F.lit(False)
        for i in reversed(range(len(orders))):
            c, v, up = F.col(orders[i].column), values[i], orders[i].direction == "asc"
            if position[i] is None:
                beyond = F.lit(False) if up else c.isNotNull()
            else:
                beyond = (c > v) | c.isNull() if up else F.coalesce(c < v, F.lit(False))
            found = beyond | (c.eqNullSafe(v) & found)
        first, v = F.col(orders[0].column), values[0]
        if position[0] is not None:
            found = ((first >= v) | first.isNull() if orders[0].direction == "asc" else first <= v) & found
        return found

    @staticmethod
    def _position_columns(orders: list[Order], types: dict[str, str]) -> list[Column]:
        text = lambda c, t: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if t.startswith("timestamp") else c.cast("string")
        return [text(F.col(o.column), types[o.column]).alias(f"__hl_sort_{i}") for i, o in enumerate(orders)]

    def list_rows(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, scope: str | None = None, where: Column | None = None, columns: list[str] | None = None, order_by=None, limit: int | None = None, position: list | None = None, opened: bool = True, _internal: bool = False) -> DataFrame:
        """find_many() as a DataFrame: matching rows in order, with only the asked columns opened."""
        r = table.registration
        orders, types = self._orders(table, order_by), dict(table.parent.dtypes)
        names = {**{c: c for c in (*r.keys, *r.plain)}, **{n: r.column(n) for n in r.fields}}
        chosen = list(names) if columns is None else columns
        ensure(all(c in names for c in chosen))
        ensure(limit is None or isinstance(limit, int) and not isinstance(limit, bool) and limit > 0)
        chosen = list(dict.fromkeys([*r.keys, *chosen]))
        rows = self.where(table, match, scope=scope, where=where)
        if position is not None:
            rows = rows.where(self.after(orders, types, position))
        # opened after the limit, so that no row is opened in vain; without one, ordered at the end, since opening is a join
        sorts = [F.col(o.column).alias(f"__hl_order_{i}") for i, o in enumerate(orders)] if limit is None else []
        if limit is not None:
            rows = rows.orderBy(*self.sort_columns(orders)).limit(limit)
        rows = rows.select(*sorts, *(names[c] for c in chosen), *(self._position_columns(orders, types) if _internal else []), *([sum((F.coalesce(F.octet_length(names[c]), F.lit(0)) for c in chosen if c in r.fields), F.lit(0)).alias("__hl_size")] if _internal else []))
        rows = self.open(rows, r) if opened else rows
        if limit is None:
            rows = rows.orderBy(*self.sort_columns([Order(f"__hl_order_{i}", o.direction) for i, o in enumerate(orders)])).drop(*(f"__hl_order_{i}" for i in range(len(orders))))
        return rows

    def find_many(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, scope: str | None = None, where: Column | None = None, columns: list[str] | None = None, order_by=None, limit: int | None = None, cursor: str | None = None, budgets: Budgets | None = None, cancelled: Callable[[], bool] | None = None) -> Page:
        """A page of opened rows and the cursor to the next; None once a page came out short."""
        r, budgets = table.registration, budgets or Budgets()
        ensure(limit is None or isinstance(limit, int) and not isinstance(limit, bool) and limit > 0)
        orders, node, scope_id = self._orders(table, order_by), self._node(r, match), r.scope_value(scope)
        digest = query_digest({"scope": scope_id, "match": fingerprint(node), "where": None if where is None else str(where._jc), "order": [[o.column, o.direction] for o in orders]})
        position = None if cursor is None else open_cursor(self.ring, r, scope_id, digest, cursor)
        end = None if budgets.deadline_ms is None else time.monotonic() + budgets.deadline_ms / 1000
        items: list[dict] = []
        spent, result_bytes, limited, exhausted = [0, 0], 0, False, False
        while not limited and not exhausted and (limit is None or len(items) < limit):
            left = None if limit is None else limit - len(items)
            ask = min(x for x in (left, budgets.batch) if x is not None) if left or budgets.batch else None
            rows = self.list_rows(table, match, scope=scope, where=where, columns=columns, order_by=order_by, limit=ask, position=position, _internal=True)
            own = Budgets(deadline_ms=None if end is None else max(1, int((end - time.monotonic()) * 1000)))
            n = 0
            found = self._within(rows, rows.collect if ask is not None else lambda rows=rows: rows.toLocalIterator(), own, cancelled)
            for row in found:
                ensure(not (cancelled and cancelled()), "CANCELLED")
                data = row.asDict()
                sealed = data.pop("__hl_size")
                sort = [data.pop(f"__hl_sort_{i}") for i in range(len(orders))]
                n += 1
                size = len(canonical({k: v if not isinstance(v, bytearray) else bytes(v) for k, v in data.items()})) if budgets.result_bytes else 0
                over = (budgets.fetch_bytes and spent[0] + sealed > budgets.fetch_bytes) or (budgets.decrypted_bytes and spent[1] + sealed > budgets.decrypted_bytes) or (budgets.result_bytes and result_bytes + size > budgets.result_bytes)
                if over or end is not None and time.monotonic() >= end:
                    limited = True
                    break
                spent, result_bytes, position = [spent[0] + sealed, spent[1] + sealed], result_bytes + size, sort
                items.append(data)
            exhausted = not limited and (ask is None or n < ask)
        if limited and not items:
            raise SealError("LIMIT_EXCEEDED")
        done = exhausted or position is None
        return Page(items, None if done else seal_cursor(self.ring, r, scope_id, digest, position))

    def all_pages(self, table: SealedTable, match: Callable[[Match], Node] | None = None, *, folder: str, limit: int, scope: str | None = None, where: Column | None = None, columns: list[str] | None = None, order_by=None) -> DataFrame:
        """What find_many() gives page after page, with the number of its `page` (from 0) and its place `at` among all rows, as a DataFrame.

        A chain of cursors searches the table once for each page, in time that grows with the square of the matches. This searches
        and sorts once: the matching rows, still sealed, are written in order to the folder (which must be new), counted by file, and opened as they are read.
        """
        ensure(isinstance(limit, int) and not isinstance(limit, bool) and limit > 0)
        r, spark = table.registration, table.parent.sparkSession
        orders = self._orders(table, order_by)
        names = {**{c: c for c in (*r.keys, *r.plain)}, **{n: r.column(n) for n in r.fields}}
        ensure(all(c in names for c in columns or []))
        chosen = list(dict.fromkeys([*r.keys, *(names if columns is None else columns)]))
        sorts = [F.col(o.column).alias(f"__hl_order_{i}") for i, o in enumerate(orders)]
        rows = self.where(table, match, scope=scope, where=where).select(*sorts, *(names[c] for c in chosen))
        ordered = rows.orderBy(*self.sort_columns([Order(f"__hl_order_{i}", o.direction) for i, o in enumerate(orders)])).drop(*(f"__hl_order_{i}" for i in range(len(orders))))
        # the number of the partition, then of the row in it
        _action(lambda: ordered.withColumn("__hl_at", F.monotonically_increasing_id()).write.parquet(folder))
        written = spark.read.parquet(folder)
        part = F.shiftright("__hl_at", 33).alias("__hl_part")
        counts = sorted(_action(written.groupBy(part).count().collect))
        before = accumulate((n for _, n in counts), initial=0)
        first = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, before)], "__hl_part long, __hl_first long")
        at = (F.col("__hl_first") + F.col("__hl_at").bitwiseAND((1 << 33) - 1)).alias("at")
        placed = written.withColumn("__hl_part", part).join(F.broadcast(first), "__hl_part")
        numbered = placed.select(at, *(names[c] for c in chosen)).select(F.floor(F.col("at") / limit).cast("long").alias("page"), "*")
        return self.open(numbered, r)

    def search(self, match: dict[str, tuple[SealedTable, Callable[[Match], Node] | None]], query: Callable[[SearchParts], DataFrame], *, scope: str | None = None, keyset: list[str] | None = None, columns: dict[str, list[str]] | None = None, limit: int | None = None, cursor: str | None = None, budgets: Budgets | None = None, cancelled: Callable[[], bool] | None = None) -> Page:
        """A caller's own join over several sealed tables.

        query gets each table reduced to its matching rows (opened, so that a join that repeats
        rows does not open them again) and returns the joined frame; keyset names columns of it that
        identify a result row, in ascending order, and pages go by them.  columns gives, for a table, the
        sealed fields that it needs; the others are neither opened nor there.

        Past the deadline it is LIMIT_EXCEEDED. A page that runs into result_bytes ends early, and without a keyset to
        go on by it is LIMIT_EXCEEDED too; batch is the number of rows fetched at a time, by the keyset. Sealed
        bytes can't be told once a join has repeated or dropped rows, so budgets of them are refused.
        """
        budgets, columns = budgets or Budgets(), columns or {}
        ensure(match and (keyset is not None or cursor is None))
        ensure(limit is None or isinstance(limit, int) and not isinstance(limit, bool) and limit > 0)
        ensure(budgets.fetch_bytes is None and budgets.decrypted_bytes is None and (budgets.batch is None or bool(keyset)))
        ensure(set(columns) <= set(match) and all(set(names) <= set(match[k][0].registration.fields) for k, names in columns.items()))
        scoped = {t.registration.scope is not None for t, _ in match.values()}
        ensure(len(scoped) == 1 and len({t.registration.model for t, _ in match.values()}) == len(match))
        first = next(iter(match.values()))[0].registration
        scope_id = first.scope_value(scope)
        nodes = {k: fingerprint(self._node(t.registration, m)) for k, (t, m) in match.items()}
        digest = query_digest({"scope": scope_id, "match": nodes, "keyset": keyset, "models": [t.registration.model for t, _ in match.values()]})
        orders = [Order(k) for k in keyset or []]
        position = None if cursor is None else open_cursor(self.ring, first, scope_id, digest, cursor)
        end = None if budgets.deadline_ms is None else time.monotonic() + budgets.deadline_ms / 1000
        tables = {k: self._opened(t, m, scope, columns.get(k)) for k, (t, m) in match.items()}
        items: list[dict] = []
        result_bytes, limited, more = 0, False, True
        while more and not limited:
            ask = min((n for n in (None if limit is None else limit - len(items), budgets.batch) if n is not None), default=None)

            def finish(frame: DataFrame, position=position, ask=ask) -> DataFrame:
                types = dict(frame.dtypes)
                ensure(all(k in types for k in keyset or []), "INVALID_CANDIDATE_SHAPE")
                out = frame if position is None else frame.where(self.after(orders, types, position))
                out = out.orderBy(*self.sort_columns(orders)) if orders else out
                return out if ask is None else out.limit(ask)

            frame = finish(query(SearchParts(tables, keyset or [], finish, ask)))
            frame = frame.select("*", *self._position_columns(orders, dict(frame.dtypes)))
            own = Budgets(deadline_ms=None if end is None else max(1, int((end - time.monotonic()) * 1000)))
            found = self._within(frame, frame.collect, own, cancelled)
            for row in found:
                ensure(not (cancelled and cancelled()), "CANCELLED")
                data = row.asDict()
                sort = [data.pop(f"__hl_sort_{i}") for i in range(len(orders))]
                ensure(not orders or sort != position, "INVALID_CANDIDATE_SHAPE")
                data = {k: v for k, v in data.items() if not k.startswith("__hl_")}
                if budgets.result_bytes:
                    result_bytes += len(canonical({k: bytes(v) if isinstance(v, bytearray) else v for k, v in data.items()}))
                    limited = result_bytes > budgets.result_bytes
                    if limited:
                        break
                items.append(data)
                position = sort
            more = ask is not None and len(found) == ask and bool(orders)
            if limit is not None and len(items) >= limit:
                break
        ensure(not limited or items and orders, "LIMIT_EXCEEDED")
        return Page(items, seal_cursor(self.ring, first, scope_id, digest, position) if limited or more else None)

    def _opened(self, table: SealedTable, match, scope: str | None, names: list[str] | None) -> DataFrame:
        """The matching rows with these of their fields opened, all by default; the rest of the sealed columns are left out."""
        rows, r = self.where(table, match, scope=scope), table.registration
        left_out = [] if names is None else [r.column(n) for n in r.fields if n not in names]
        return self.open(rows.drop(*left_out), r)
