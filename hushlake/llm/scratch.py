"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where nothing is set and all runs on one machine."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hushlake-"))
    return sc.getCheckpointDir().rstrip("/")


_folders: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; removed when the driver's program ends."""
    folder = f"{shared_dir(spark)}/hushlake-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the program
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *, free: bool = False) -> DataFrame:
    """Write the rows to the shared folder and return them as a new scan: survives lost executors, ends the lineage.

    With `free`, the files of the shuffles behind them go once the rows are written, and not when the driver's JVM next collects.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that make() describes, written; every table that was written on the way goes."""
    before = len(_made)
    out = cut(make())
    for path in _made[before:-1]:
        _remove(out.sparkSession, path)
    del _made[before:-1]
    return out


def drop(df: DataFrame) -> None:
    """Remove the files behind a table made by cut(), once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/hushlake-" in name}:
        _remove(df.sparkSession, folder)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the batches that go to Python by bytes, for the session: texts can be long, and rows alone say nothing about memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of the table has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
