"""Headline timings: one JSON line.  Medians of RUNS after WARM warm-ups; every run must equal the plain query.

$BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
WARM, RUNS = 2, 7


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from hushlake import queries as q
    from hushlake.functions.normalize import normalize_col

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine, timings = q._engine, {}

    def timed(name: str, run, want) -> None:
        took = []
        for i in range(WARM + RUNS):
            began = time.perf_counter()
            got = run()
            if i >= WARM:
                took.append(time.perf_counter() - began)
            assert got == want, (name, got, want)
        timings[name] = round(median(took), 4)

    began = time.perf_counter()
    tables = {m: q.sealed_table(spark, sf, m) for m in ("customer", "customer_hard", "orders", "part")}
    rows = {m: t.parent.count() for m, t in tables.items()}
    seal_s = time.perf_counter() - began
    orders = spark.read.parquet(f"{sf}/orders.parquet").cache()
    customer = spark.read.parquet(f"{sf}/customer.parquet").cache()
    p, c = normalize_col(F.col("o_orderpriority")), normalize_col(F.col("c_name"))

    def count(model: str, match):
        return lambda: engine.count(tables[model], match)

    urgent = lambda m: m.priority.contains("urg")
    timed("count_eq", count("orders", lambda m: m.priority.eq("5-LOW")), orders.where(p == "5-low").count())
    timed("count_contains", count("orders", urgent), orders.where(p.contains("urg")).count())
    timed("count_contains_long", count("orders", lambda m: m.priority.contains("specified")), orders.where(p.contains("specified")).count())
    timed("count_starts_with", count("orders", lambda m: m.priority.starts_with("1-")), orders.where(p.startswith("1-")).count())
    timed("count_ends_with", count("orders", lambda m: m.priority.ends_with("ium")), orders.where(p.endswith("ium")).count())
    timed("count_like", count("orders", lambda m: m.priority.like("%me%um")), orders.where(p.like("%me%um")).count())
    timed("count_or", count("orders", lambda m: m.or_(m.priority.contains("low"), m.priority.starts_with("1-u"))), orders.where(p.contains("low") | p.startswith("1-u")).count())
    timed("count_rare", count("customer", lambda m: m.name.contains("01234")), customer.where(c.contains("01234")).count())
    timed("count_hardened", count("customer_hard", lambda m: m.name.contains("#0000012")), customer.where(c.contains("#0000012")).count())
    total = orders.where(p.contains("urg")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)"))).first()[0]
    timed("sum_contains", lambda: engine.where(tables["orders"], urgent).agg(F.sum("total")).first()[0], total)
    pairs = orders.join(customer.where(c.contains("11")), F.col("o_custkey") == F.col("c_custkey")).count()
    timed("join_count", lambda: engine.where(tables["customer"], lambda m: m.name.contains("11")).select("id").join(tables["orders"].parent.select(F.col("customer").cast("string").alias("id")), "id").count(), pairs)
    first = [r[0] for r in customer.where(c.contains("11")).orderBy(F.col("c_custkey").cast("string")).limit(20).select("c_name").collect()]
    timed("list_20", lambda: [i["name"] for i in engine.find_many(tables["customer"], lambda m: m.name.contains("11"), columns=["name"], limit=20).items], first)
    timed("list_eq", lambda: [i["name"] for i in engine.find_many(tables["customer"], lambda m: m.name.eq("customer#000000042"), limit=20).items], ["Customer#000000042"])
    print(json.dumps({"metric": "sum of query medians", "value": round(sum(timings.values()), 4), "unit": "sec", "queries": timings, "sf": sf, "sealed_rows": rows, "seal_rows_per_sec": round(sum(rows.values()) / seal_s, 1)}))


if __name__ == "__main__":
    main()
