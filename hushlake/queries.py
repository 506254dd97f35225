"""One query for each thing the engine does, and the plain SQL that must give the same rows.

Sealed models are built from the driver's tables and written once for each directory and
session; no query returns ciphertext, salts or stamps, which are random.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import from_spark
from .functions import codec
from .functions.keys import Keyring
from .functions.normalize import DIGITS, KEEP_SPACES, normalize_col, normalize_sql
from .operators.search import Order, Sealed, SealedTable
from .plans import model as s
from .sources import files
from .sources.store import Store, prepare_all

KEY = bytes(range(32))  # of the fixtures
N = normalize_sql

_PHONE = "concat('+(', lpad(cast(c_custkey % 100 as string), 2, '0'), ')-', lpad(cast(c_custkey as string), 4, '0'), '-', lpad(cast((c_custkey * 7919) % 10000 as string), 4, '0'))"
PHONE_SQL = _PHONE.replace("as string", "as varchar")

#: model: (registration, table, columns of its rows)
MODELS: dict[str, tuple[s.Registration, str, dict[str, str]]] = {}


def _model(name: str, table: str, row: str, fields: dict[str, tuple[s.FieldSpec, str]], plain: dict[str, str] | None = None, scope: str | None = None) -> None:
    registration = s.Registration(name, "id", {k: f for k, (f, _) in fields.items()}, scope="tenant" if scope else None, plain=tuple(plain or {}))
    columns = {"id": f"cast({row} as string)", **({"tenant": scope} if scope else {}), **(plain or {}), **{k: e for k, (_, e) in fields.items()}}
    MODELS[name] = registration, table, columns


_BOTH = {"exact": True, "substring": True}
_model("customer", "customer", "c_custkey", {
    "name": (s.text(search=_BOTH), "c_name"),
    "acctbal": (s.decimal(12, 2, search={"exact": True}), "cast(c_acctbal as decimal(12,2))"),
    "custkey": (s.bigint(search={"exact": {"bits": 12}}), "c_custkey"),
}, {"nation": "c_nationkey", "segment": "c_mktsegment"})
_model("customer_scoped", "customer", "c_custkey", {
    "name": (s.text(search=_BOTH), "c_name"),
    "nation": (s.integer(search={"exact": True}), "c_nationkey"),
}, scope="c_mktsegment")
_model("customer_hard", "customer", "c_custkey", {
    "name": (s.text(search=_BOTH, hardened=True), "c_name"),
    "segment": (s.text(search=_BOTH), "c_mktsegment"),
}, {"nation": "c_nationkey"})
_model("customer_gaps", "customer", "c_custkey", {
    "note": (s.text(search=_BOTH, nullable=True), "case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then '' when c_custkey % 13 = 0 then 'x' else concat(c_name, ' ', c_mktsegment) end"),
    "rank": (s.integer(search={"exact": {"bits": 2}}, nullable=True), "case when c_custkey % 5 = 0 then null else c_custkey % 9 end"),
}, {"balance": "case when c_custkey % 3 = 0 then null else cast(c_acctbal as decimal(12,2)) end", "segment": "c_mktsegment"})
_model("segment", "customer", "c_custkey", {"segment": (s.text(search={"exact": {"bits": 2}}), "c_mktsegment")}, {"nation": "c_nationkey"})
_model("part", "part", "p_partkey", {"name": (s.text(search=_BOTH), "p_name"), "kind": (s.text(search={"exact": True}), "p_type")}, {"size": "p_size", "price": "cast(p_retailprice as decimal(12,2))"})
_model("supplier", "supplier", "s_suppkey", {"name": (s.text(search=_BOTH), "s_name")}, {"nation": "s_nationkey"})
_model("orders", "orders", "o_orderkey", {"priority": (s.text(search=_BOTH), "o_orderpriority")}, {"customer": "o_custkey", "total": "cast(o_totalprice as decimal(12,2))", "day": "o_orderdate"})
_model("turns", "conversations", "concat(conv_id, ':', turn)", {"body": (s.text(search=_BOTH), "text")}, {"conv": "conv_id", "turn": "turn"}, scope="role")
_model("whole", "documents", "doc_id", {"text": (s.text(search={"substring": {"skip_grams": False}}, nullable=True), "text")}, {"lang": "lang", "source": "source"})
_model("event", "events", "event_id", {
    "props": (s.json(), "props"), "at": (s.instant(), "ts"), "value": (s.decimal(18, 4), "cast(value as decimal(18,4))"),
    "kind": (s.text(search={"exact": True}), "event_type"), "odd": (s.boolean(), "event_id % 2 = 1"), "raw": (s.bytes_(), "cast(event_type as binary)"),
}, {"user": "user_id"})
_model("phone", "customer", "c_custkey", {"phone": (s.text(search={**_BOTH, "normalizer": DIGITS}), _PHONE)})
_model("spaced", "part", "p_partkey", {"name": (s.text(search={**_BOTH, "normalizer": KEEP_SPACES}), "p_name")})
_model("wide", "supplier", "s_suppkey", {"name": (s.text(search=_BOTH), "concat('Ｓ', substring(s_name, 2), ' E\\u0301 É')")})

_engine = Sealed(Keyring(KEY))
_made: dict[tuple[str, str, str], SealedTable] = {}
_scratch: list[str] = []


def _folder(spark: SparkSession) -> str:
    """A folder of this session: beneath the shared one where the cluster names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/hushlake-models-{spark.sparkContext.applicationId}"
    if folder not in _scratch:
        _scratch.append(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the program
        files.remove(spark, folder)


def plain_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, table, columns = MODELS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} as `{c}`" for c, e in columns.items()))


def sealed_table(spark: SparkSession, sf_dir: str, name: str) -> SealedTable:
    """The sealed model, written on its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        store = _new_store(spark, name)
        store.insert(plain_rows(spark, sf_dir, name))
        _made[key] = store.table()
    return _made[key]


def _new_store(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", MODELS[name][0], _engine)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _ids(name: str, match, **options):
    """A query for the ids that match."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine.where(sealed_table(spark, sf_dir, name), match, **options).select("id")

    return run


def ids(key: str, model: str, match, condition: str, **options) -> None:
    _, table, columns = MODELS[model]
    QUERIES[key] = _ids(model, match, **options)
    ORACLES[key] = f"SELECT {columns['id'].replace('as string', 'as varchar')} AS id FROM {table} WHERE {condition}"


def _like(column: str, pattern: str, kind: str = "default") -> str:
    return rf"{N(column, kind)} LIKE '{pattern}' ESCAPE '\'"


# Predicates -------------------------------------------------------------------

ids("eq_name", "customer", lambda m: m.name.eq("CUSTOMER #000000042"), f"{N('c_name')} = 'customer#000000042'")
ids("eq_empty", "customer_gaps", lambda m: m.note.eq(""), "c_custkey % 7 <> 0 AND c_custkey % 11 = 0")
ids("eq_one_char", "customer_gaps", lambda m: m.note.eq("X"), "c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 = 0")
QUERIES["eq_decimal_acctbal"] = lambda spark, sf: _engine.where(sealed_table(spark, sf, "customer"), lambda m: m.or_(*(m.acctbal.eq(str(r["b"])) for r in spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey in (3, 77)").selectExpr("cast(c_acctbal as decimal(12,2)) as b").collect()))).select("id")
ORACLES["eq_decimal_acctbal"] = "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) IN (SELECT CAST(c_acctbal AS DECIMAL(12,2)) FROM customer WHERE c_custkey IN (3, 77))"
ids("eq_bigint_custkey", "customer", lambda m: m.custkey.eq(99), "c_custkey = 99")
ids("eq_int_nation", "customer_scoped", lambda m: m.nation.eq(7), "c_nationkey = 7 AND c_mktsegment = 'BUILDING'", scope="BUILDING")
ids("eq_int_nullable_bits2", "customer_gaps", lambda m: m.rank.eq(4), "c_custkey % 5 <> 0 AND c_custkey % 9 = 4")
ids("eq_bits2_segment", "segment", lambda m: m.segment.eq("building"), f"{N('c_mktsegment')} = 'building'")
ids("contains_2char", "customer", lambda m: m.name.contains("77"), f"contains({N('c_name')}, '77')")
ids("contains_repeated_pair", "customer", lambda m: m.name.contains("0000"), f"contains({N('c_name')}, '0000')")
ids("contains_long", "customer", lambda m: m.name.contains("omer#0000001"), f"contains({N('c_name')}, 'omer#0000001')")
ids("contains_zero", "customer", lambda m: m.name.contains("remotsuc"), f"contains({N('c_name')}, 'remotsuc')")
ids("contains_across_space", "part", lambda m: m.name.contains("E G"), f"contains({N('p_name')}, 'eg')")
ids("contains_unicode", "whole", lambda m: m.text.contains("Él"), f"contains({N('text')}, 'Él')")
ids("contains_decomposed", "wide", lambda m: m.name.contains("1E\u0301 E\u0301"), f"contains({N("concat('Ｓ', substring(s_name, 2), ' E', chr(769), ' É')")}, '1ÉÉ')")
ids("contains_full_width", "wide", lambda m: m.name.contains("supplier#0000"), f"contains({N('s_name')}, 'supplier#0000')")
ids("contains_long_text", "turns", lambda m: m.body.contains("then"), f"contains({N('text')}, 'then') AND role = 'user'", scope="user")
ids("starts_with", "part", lambda m: m.name.starts_with("large g"), f"starts_with({N('p_name')}, 'largeg')")
ids("starts_with_longer", "customer", lambda m: m.name.starts_with("Customer#00000000"), f"starts_with({N('c_name')}, 'customer#00000000')")
ids("ends_with", "customer", lambda m: m.name.ends_with("00"), f"suffix({N('c_name')}, '00')")
ids("ends_with_repeated", "customer", lambda m: m.name.ends_with("0100"), f"suffix({N('c_name')}, '0100')")
ids("like_multi_segment", "customer", lambda m: m.name.like("cu%er#%12"), _like("c_name", "cu%er#%12"))
ids("like_same_twice", "customer", lambda m: m.name.like("%00%00%11%"), _like("c_name", "%00%00%11%"))
ids("like_underscore", "customer", lambda m: m.name.like("%00_21%"), _like("c_name", "%00_21%"))
ids("like_underscore_edges", "customer", lambda m: m.name.like("_ustomer%00_"), _like("c_name", "_ustomer%00_"))
ids("like_fixed_width", "customer", lambda m: m.name.like("cust____#00000__47"), _like("c_name", "cust____#00000__47"))
ids("like_whole", "customer", lambda m: m.name.like("Customer#000000015"), _like("c_name", "customer#000000015"))
ids("like_edge", "customer", lambda m: m.name.like("%%15"), _like("c_name", "%15"))
ids("like_spaces_in_literal", "part", lambda m: m.name.like("%ar% e g%"), _like("p_name", "%ar%eg%"))
ids("and_two_fields", "part", lambda m: m.and_(m.name.contains("ea"), m.kind.eq("standard")), f"contains({N('p_name')}, 'ea') AND {N('p_type')} = 'standard'")
ids("or_two_fields", "part", lambda m: m.or_(m.name.contains("ea"), m.kind.eq("ECONOMY")), f"contains({N('p_name')}, 'ea') OR {N('p_type')} = 'economy'")
ids("nested_bool", "customer", lambda m: m.or_(m.and_(m.name.contains("11"), m.or_(m.name.ends_with("51"), m.name.ends_with("12"))), m.custkey.eq(5)), f"(contains({N('c_name')}, '11') AND (suffix({N('c_name')}, '51') OR suffix({N('c_name')}, '12'))) OR c_custkey = 5")
ids("or_with_nulls", "customer_gaps", lambda m: m.or_(m.note.contains("building"), m.rank.eq(3)), f"contains({N('case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then chr(0) when c_custkey % 13 = 0 then chr(0) else c_mktsegment end')}, 'building') OR (c_custkey % 5 <> 0 AND c_custkey % 9 = 3)")
ids("or_with_plain_sql", "customer_gaps", lambda m: m.or_(m.rank.eq(3), m.sql(F.col("segment") == "MACHINERY")), "(c_custkey % 5 <> 0 AND c_custkey % 9 = 3) OR c_mktsegment = 'MACHINERY'")
ids("and_with_plain_sql", "customer", lambda m: m.and_(m.name.contains("12"), m.sql(F.col("nation") < 10)), f"contains({N('c_name')}, '12') AND c_nationkey < 10")
ids("hardened_eq", "customer_hard", lambda m: m.name.eq("customer#000000007"), f"{N('c_name')} = 'customer#000000007'")
ids("hardened_contains", "customer_hard", lambda m: m.name.contains("033"), f"contains({N('c_name')}, '033')")
ids("hardened_like", "customer_hard", lambda m: m.name.like("cust%#0%33%"), _like("c_name", "cust%#0%33%"))
ids("mixed_hardened_and_ordinary", "customer_hard", lambda m: m.and_(m.name.ends_with("11"), m.segment.starts_with("bu")), f"suffix({N('c_name')}, '11') AND starts_with({N('c_mktsegment')}, 'bu')")
ids("digits_contains", "phone", lambda m: m.phone.contains("12-3"), f"contains({N(PHONE_SQL, DIGITS)}, '123')")
ids("digits_eq", "phone", lambda m: m.phone.eq("+17 0017 4623"), f"{N(PHONE_SQL, DIGITS)} = '1700174623'")
ids("digits_starts_with", "phone", lambda m: m.phone.starts_with("(42)"), f"starts_with({N(PHONE_SQL, DIGITS)}, '42')")
ids("keep_spaces_eq", "spaced", lambda m: m.name.eq("LARGE GEAR"), f"{N('p_name', KEEP_SPACES)} = 'large gear'")
ids("keep_spaces_eq_needs_space", "spaced", lambda m: m.name.eq("largegear"), f"{N('p_name', KEEP_SPACES)} = 'largegear'")
ids("keep_spaces_contains", "spaced", lambda m: m.name.contains("e g"), f"contains({N('p_name')}, 'eg')")
ids("scope_isolation", "customer_scoped", lambda m: m.name.contains("12"), f"contains({N('c_name')}, '12') AND c_mktsegment = 'MACHINERY'", scope="MACHINERY")


# Counts and aggregates --------------------------------------------------------


@query(f"SELECT count(*) AS count FROM customer WHERE contains({N('c_name')}, '11')")
def count_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.count_rows(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("11"))


@query(f"SELECT count(*) AS count FROM customer WHERE starts_with({N('c_name')}, 'customer#0000000')")
def count_companion_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sealed_table(spark, sf_dir, "customer")
    # the parent is not there at all
    return _engine.count_rows(SealedTable(table.registration, table.parent.limit(0), table.companion), lambda m: m.name.starts_with("customer#0000000"))


@query("SELECT count(*) AS count FROM customer")
def count_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.count_rows(sealed_table(spark, sf_dir, "customer_gaps"))


@query("SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def scoped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.count_rows(sealed_table(spark, sf_dir, "customer_scoped"), lambda m: m.nation.eq(3), scope="BUILDING")


@query(f"SELECT count(*) AS count FROM customer WHERE contains({N('c_name')}, '1') AND contains({N('c_name')}, '12') AND c_nationkey >= 20")
def count_with_plain_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.count_rows(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("12"), where=F.col("nation") >= 20)


@query(f"SELECT sum(CAST(p_retailprice AS DECIMAL(12,2)))::DECIMAL(22,2) AS total, round(avg(CAST(p_retailprice AS DECIMAL(12,2))), 4) AS mean, count(*) AS n FROM part WHERE contains({N('p_name')}, 'ea')")
def sum_avg_under_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _engine.where(sealed_table(spark, sf_dir, "part"), lambda m: m.name.contains("ea"))
    return rows.agg(F.sum("price").cast("decimal(22,2)").alias("total"), F.round(F.avg(F.col("price").cast("double")), 4).alias("mean"), F.count("*").alias("n"))


@query(f"""SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(12,2)))::DECIMAL(22,2) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey WHERE contains({N('c_name')}, '11') GROUP BY ALL""")
def group_by_segment_under_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by a part of their sealed name, with their orders, by segment."""
    found = _engine.where(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("11")).select("id", "segment")
    orders = sealed_table(spark, sf_dir, "orders").parent.select(F.col("customer").cast("string").alias("id"), "total")
    return found.join(orders, "id").groupBy("segment").agg(F.count_distinct("id").alias("customers"), F.count("*").alias("orders"), F.sum("total").cast("decimal(22,2)").alias("revenue"))


# Joins ------------------------------------------------------------------------


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE suffix({N('c_name')}, '07')")
def join_orders_under_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sealed_table(spark, sf_dir, "customer")
    # opened once for each customer, before the join repeats them
    found = _engine.open(_engine.where(table, lambda m: m.name.ends_with("07")).select("id", "name_ct"), table.registration)
    orders = sealed_table(spark, sf_dir, "orders").parent.select(F.col("id").alias("order_id"), F.col("customer").cast("string").alias("id"))
    return found.join(orders, "id").select("order_id", "name")


@query(f"SELECT count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey WHERE contains({N('c_name')}, '3') AND contains({N('c_name')}, '33')")
def join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine.where(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("33")).select("id")
    orders = sealed_table(spark, sf_dir, "orders").parent.select(F.col("customer").cast("string").alias("id"))
    return orders.join(found, "id").agg(F.count("*").alias("count"))


_ON = f"contains({N('o_orderpriority')}, 'urgent')"


@query(f"""SELECT 'on' AS form, c_custkey::VARCHAR AS id, o_orderkey::VARCHAR AS order_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {_ON}
UNION ALL SELECT 'where', c_custkey::VARCHAR, o_orderkey::VARCHAR FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE {_ON}""")
def left_join_on_vs_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_and_where(spark, sf_dir, sealed_table(spark, sf_dir, "customer").parent.select("id"))


def _on_and_where(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    orders = sealed_table(spark, sf_dir, "orders")
    r, urgent = orders.registration, lambda m: m.priority.contains("urgent")
    first = _engine.where(orders, urgent).select(F.col("id").alias("order_id"), F.col("customer").cast("string").alias("id"))
    on = customers.join(first, "id", "left").select(F.lit("on").alias("form"), "id", "order_id")
    # decided on the companion, so that the join moves a Boolean and not the index
    index = orders.companion.select(F.col("row_id").alias("order_id"), _engine.condition(r, urgent).alias("urgent"))
    every = orders.parent.select(F.col("id").alias("order_id"), F.col("customer").cast("string").alias("id"))
    joined = customers.join(every, "id", "left").join(index, "order_id", "left").where("urgent")
    return on.unionByName(joined.select(F.lit("where").alias("form"), "id", "order_id"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE contains({N('c_name')}, '77')) AND starts_with({N('o_orderpriority')}, '1-')")
def subquery_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine.where(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("77")).select(F.col("id").alias("c"))
    orders = _engine.where(sealed_table(spark, sf_dir, "orders"), lambda m: m.priority.starts_with("1-"))
    return orders.join(found, F.col("customer").cast("string") == F.col("c"), "left_semi").select("id")


@query(f"""SELECT s_name AS supplier, p_name AS part, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
WHERE suffix({N('s_name')}, '7') AND contains({N('s_name')}, '07') AND contains({N('p_name')}, 'gear') GROUP BY ALL""")
def two_sealed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, parts = sealed_table(spark, sf_dir, "supplier"), sealed_table(spark, sf_dir, "part")
    s_rows = _engine.open(_engine.where(suppliers, lambda m: m.name.ends_with("07")), suppliers.registration).select(F.col("id").alias("s"), F.col("name").alias("supplier"))
    p_rows = _engine.open(_engine.where(parts, lambda m: m.name.contains("gear")), parts.registration).select(F.col("id").alias("p"), F.col("name").alias("part"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("s"), F.col("l_partkey").cast("string").alias("p"))
    return lines.join(s_rows, "s").join(p_rows, "p").groupBy("supplier", "part").agg(F.count("*").alias("n"))


ORACLES["two_sealed_tables"] = ORACLES["two_sealed_tables"].replace(f"suffix({N('s_name')}, '7') AND contains({N('s_name')}, '07')", f"suffix({N('s_name')}, '07')")


@query(f"SELECT c_name AS name, o_orderkey::VARCHAR AS order_id, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey WHERE suffix({N('c_name')}, '12') AND contains({N('o_orderpriority')}, 'low') ORDER BY c_custkey::VARCHAR, o_orderkey::VARCHAR LIMIT 20")
def search_over_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = sealed_table(spark, sf_dir, "customer"), sealed_table(spark, sf_dir, "orders")

    def join(parts):
        customers = parts.tables["c"].select(F.col("id").alias("cid"), "name")
        orders = parts.tables["o"].select(F.col("id").alias("order_id"), F.col("customer").cast("string").alias("cid"), "priority")
        return customers.join(orders, "cid")

    match = {"c": (c, lambda m: m.name.ends_with("12")), "o": (o, lambda m: m.priority.contains("low"))}
    items, cursor = [], None
    while len(items) < 20:
        page = _engine.search(match, join, keyset=["cid", "order_id"], limit=7 if len(items) < 14 else 6, cursor=cursor)
        items, cursor = items + page.items, page.next_cursor
        if cursor is None:
            break
    return spark.createDataFrame([(i["name"], i["order_id"], i["priority"]) for i in items], "name string, order_id string, priority string")


# Opening ----------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def open_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.list_rows(sealed_table(spark, sf_dir, "part"), columns=["name"])


@query("SELECT CAST(event_id AS VARCHAR) AS id, props, epoch_us(ts) // 1000 AS at_ms, CAST(value AS DECIMAL(18,4)) AS value, event_type AS kind, event_id % 2 = 1 AS odd, event_type AS raw, user_id AS user FROM events")
def open_roundtrip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sealed_table(spark, sf_dir, "event")
    opened = _engine.open(table.parent, table.registration)
    return opened.select("id", "props", F.unix_millis("at").alias("at_ms"), "value", "kind", "odd", F.col("raw").cast("string").alias("raw"), "user")


@query("SELECT CAST(c_custkey AS VARCHAR) AS who, c_name AS secret, c_nationkey AS n FROM customer WHERE c_nationkey = 4")
def open_raw_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sealed_table(spark, sf_dir, "customer")
    raw = table.parent.where("nation = 4").select(F.col("id").alias("who"), F.col("name_ct").alias("secret"), F.col("nation").alias("n"))
    return _engine.open(raw, table.registration, columns={"name": "secret"}, row="who")


@query("SELECT count(*) AS rows, count(*) AS foreign_rows, count(*) AS damaged FROM customer")
def tamper_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes that were moved to another row or changed in one byte do not open."""
    table = sealed_table(spark, sf_dir, "customer")
    moved = table.parent.withColumn("id", F.concat("id", F.lit("x")))
    cut = table.parent.withColumn("name_ct", F.concat(F.expr("substring(name_ct, 1, octet_length(name_ct) - 1)"), F.unhex(F.lpad(F.hex((F.conv(F.hex(F.expr("substring(name_ct, -1, 1)")), 16, 10).cast("long") + 1) % 256), 2, "0"))))
    fails = lambda rows: _engine.open(rows, table.registration, columns={"name": "name_ct"}, strict=False).agg(F.count_if(F.col("name_ct").isNull()).alias("n"))
    counts = [table.parent.count(), *(fails(x).first()["n"] for x in (moved, cut))]
    return spark.createDataFrame([tuple(counts)], "rows long, foreign_rows long, damaged long")


_REJECTS = [
    ("integer", "3", False), ("integer", "3.7", True), ("integer", "9007199254740992", True), ("integer", "x", True), ("bigint", "12345678901234567890123", False), ("bigint", "12345678901234567890.5", True),
    ("bigint", "3.7", True), ("decimal", "1.25", False), ("decimal", "1.2500", False), ("decimal", "1.255", True), ("decimal", "12345678901.00", True), ("json", '{"a": [1, null]}', False), ("json", "not json {", True), ("json", "", True),
]


@query("SELECT kind, value, rejected FROM (VALUES " + ", ".join(f"('{k}', '{v}', {r})" for k, v, r in _REJECTS) + ") t(kind, value, rejected)")
def codec_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that their type would change are refused, not stored changed."""
    out = []
    for kind, value, _ in _REJECTS:
        row = spark.range(1).select(codec.encode_col(kind, F.lit(value), 12, 2).alias("raw"))
        try:
            out.append((kind, value, row.first()["raw"] is None))
        except Exception as e:
            out.append((kind, value, from_spark(e).code == "INVALID_VALUE"))
    return spark.createDataFrame(out, "kind string, value string, rejected boolean")


ids("like_escape", "whole", lambda m: m.text.like(r"%100\%%"), r"%s LIKE '%%100\%%%%' ESCAPE '\'" % N("text"))

# Order and pages ----------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str, model: str, match, size: int, most: int | None, **options) -> list[dict]:
    """The rows of so many pages, or of all."""
    items, cursor = [], None
    for _ in itertools.count() if most is None else range(most):
        page = _engine.find_many(sealed_table(spark, sf_dir, model), match, limit=size, cursor=cursor, **options)
        items.extend(page.items)
        cursor = page.next_cursor
        if cursor is None:
            break
    return items


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE contains({N('c_name')}, '11') ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 20")
def page_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine.list_rows(sealed_table(spark, sf_dir, "customer"), lambda m: m.name.contains("11"), columns=["name"], limit=20)


@query("""SELECT id, balance FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS balance, c_mktsegment AS s FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 9 = 4)
ORDER BY s, balance DESC NULLS FIRST, id DESC LIMIT 24""")
def page_desc_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of eight by two columns, with nulls among them."""
    items = _pages(spark, sf_dir, "customer_gaps", lambda m: m.rank.eq(4), 8, 3, columns=["balance"], order_by=[Order("segment"), Order("balance", "desc")])
    return spark.createDataFrame([(i["id"], i["balance"]) for i in items], "id string, balance decimal(12,2)")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority FROM orders WHERE contains({N('o_orderpriority')}, 'med')")
def page_exhaust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages over all orders that match, until there is no next one."""
    folder = f"{_folder(spark)}/pages-{uuid.uuid4().hex[:12]}"
    pages = _engine.all_pages(sealed_table(spark, sf_dir, "orders"), lambda m: m.priority.contains("med"), folder=folder, limit=500, columns=["priority"], order_by=Order("day"))
    return pages.select("id", "priority")


# Writing ------------------------------------------------------------------------


@query(f"SELECT c_name AS name FROM customer WHERE contains({N('c_name')}, '12') UNION ALL SELECT 'Neu ' || n_name FROM nation WHERE contains({N(chr(39) + 'neu' + chr(39) + ' || n_name')}, 'an') OR contains({N('n_name')}, '12')")
def insert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "customer")
    store.insert(plain_rows(spark, sf_dir, "customer"))
    store.insert(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('n', n_nationkey) as id", "n_nationkey as nation", "'NEW' as segment", "concat('Neu ', n_name) as name", "cast(0 as decimal(12,2)) as acctbal", "cast(n_nationkey as long) as custkey"))
    table = store.table()
    found = _engine.where(table, lambda m: m.or_(m.name.contains("12"), m.and_(m.name.starts_with("neu"), m.name.contains("an"))))
    return _engine.open(found, table.registration).select("name")


ORACLES["insert_then_search"] = f"SELECT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT 'Neu ' || n_name FROM nation) WHERE contains({N('name')}, '12') OR (starts_with({N('name')}, 'neu') AND contains({N('name')}, 'an'))"


@query(f"SELECT id, name, kind FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 10 = 0 THEN 'changed ' || p_name ELSE p_name END AS name, p_type AS kind FROM part) WHERE contains({N('name')}, 'ed') AND {N('kind')} = 'promo'")
def update_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "part")
    rows = plain_rows(spark, sf_dir, "part")
    store.insert(rows)
    store.update(rows.where("cast(id as long) % 10 = 0").selectExpr("id", "concat('changed ', name) as name"))
    table = store.table()
    found = _engine.where(table, lambda m: m.and_(m.name.contains("ed"), m.kind.eq("PROMO")))
    return _engine.open(found, table.registration).select("id", "name", "kind")


@query(f"SELECT id, name, nation FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey < 20 THEN 'Renamed#' || s_suppkey ELSE s_name END AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'Renamed#' || r_name, CAST(r_regionkey AS INT) FROM region) WHERE starts_with({N('name')}, 'renamed#')")
def upsert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "supplier")
    rows = plain_rows(spark, sf_dir, "supplier")
    store.insert(rows)
    new = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("concat('r', r_regionkey) as id", "cast(r_regionkey as int) as nation", "concat('Renamed#', r_name) as name")
    store.upsert(rows.where("cast(id as long) < 20").selectExpr("id", "nation", "concat('Renamed#', id) as name").unionByName(new))
    table = store.table()
    return _engine.open(_engine.where(table, lambda m: m.name.starts_with("Renamed#")), table.registration).select("id", "name", "nation")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE NOT suffix({N('s_name')}, '03') AND s_suppkey <> 5 AND contains({N('s_name')}, '000')")
def delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "supplier")
    store.insert(plain_rows(spark, sf_dir, "supplier"))
    store.delete(lambda m: m.name.ends_with("03"))
    store.delete(rows=spark.createDataFrame([("5",)], "id string"))
    table = store.table()
    by_index = table.companion.select(F.col("row_id").alias("id"))
    return _engine.where(table, lambda m: m.name.contains("000")).select("id").join(by_index, "id", "left_semi")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE contains({N('s_name')}, '1')  AND contains({N('s_name')}, '01')")
def reindex_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, "supplier")
    store.insert(plain_rows(spark, sf_dir, "supplier"))
    store.reindex()
    return _engine.where(store.table(), lambda m: m.name.contains("01")).select("id")


@query("SELECT 'supplier' AS model, count(*) AS rows, count(*) AS indexed FROM supplier UNION ALL SELECT 'customer_gaps', count(*), count(*) FILTER (c_custkey % 7 <> 0 OR c_custkey % 5 <> 0) FROM customer")
def prepare_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = []
    for name in ("supplier", "customer_gaps"):
        stores.append(_new_store(spark, name))
        stores[-1].insert(plain_rows(spark, sf_dir, name))
    receipts = prepare_all(stores)
    return spark.createDataFrame([(r.model, r.rows, r.indexed) for r in receipts], "model string, rows long, indexed long")


# Functions ----------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({N('text')}) AS sha FROM documents")
def norm_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(normalize_col(F.col("text")), 256).alias("sha"))


@query(f"SELECT doc_id, sha256({N('text', KEEP_SPACES)}) AS sha FROM documents")
def norm_keep_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(normalize_col(F.col("text"), KEEP_SPACES), 256).alias("sha"))


@query(f"SELECT c_custkey, {N(PHONE_SQL, DIGITS)} AS phone FROM customer")
def norm_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{_PHONE} as p").select("c_custkey", normalize_col(F.col("p"), DIGITS).alias("phone"))


@query()
def token_false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the candidate tokens of a term let through, and those that the proof confirms."""
    table = sealed_table(spark, sf_dir, "part")
    p = table.registration.profile("name", "substring")
    from .plans.predicate import Compiler, Leaf, pick_tokens

    leaf = Leaf("name", "contains", "gear")
    tokens = pick_tokens(Compiler(table.registration, _engine.ring, "_").tokens(leaf))
    passed = F.lit(True)
    for t in tokens:
        passed = passed & F.array_contains(f"tokens_{p.tag}", F.lit(t))
    proved = _engine.condition(table.registration, lambda m: m.name.contains("gear"))
    return table.companion.agg(F.count_if(passed).alias("candidates"), F.count_if(proved).alias("proved"))
