"""Small files through the file system that Spark uses, wherever the path points."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession

from ..errors import SealError


def _of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create(spark: SparkSession, path: str, text: str) -> None:
    """Make a file appear whole under a name that is free; a name that is taken is someone else's commit.

    The text is written under another name first, so a reader never sees part of it
    and a crash leaves only a file that nobody reads.
    """
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/writing-{uuid.uuid4().hex}-{name}"
    fs, source = _of(spark, aside)
    try:
        out = fs.create(source, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = fs.makeQualified(_of(spark, path)[1])
        if fs.getUri().getScheme() == "file":
            # renaming would replace a file that is there; a second link to it cannot
            os.link(fs.makeQualified(source).toUri().getPath(), target.toUri().getPath())
        else:
            context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(fs.makeQualified(source), target, none)
    except Exception as e:
        raise SealError("TRANSACTION_CONFLICT" if fs.exists(_of(spark, path)[1]) else "DATABASE_ERROR") from e
    finally:
        fs.delete(source, False)


def read(spark: SparkSession, path: str) -> str:
    fs, p = _of(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Seconds since each file or folder was last changed."""
    fs, p = _of(spark, path)
    return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _of(spark, path)
    fs.delete(p, True)
