"""Tables in the shared folder and dense numbers, for several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share, which goes with the application.

    Only a local master gets a folder of its own where none is set, as in tests; machines of a cluster would not
    see each other's.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _part(root or _own(), context.applicationId)


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spark-")


@cache
def _part(root: str, application: str) -> str:
    part = f"{root.rstrip('/')}/lorekeep-{application}"
    fs, at = _store(SparkSession.active(), part)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return part


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _store(spark, path)
    fs.delete(at, True)


_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside, in this thread, are removed at its end; so read what depends on them inside."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        for path in _SCOPE.get():
            remove(spark, path)
        _SCOPE.reset(token)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe from lost executors. It goes with the scratch it is in, or with the application."""
    path = new_folder(df.sparkSession)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with 1-based places in `order`, within equal values of the columns `by` if there are any.

    Places are found per range partition and shifted by the sizes of the ranges before it, so no task sorts all
    rows. The rows are written before, so that sampling them for the ranges computes nothing twice, and after, as
    ranges that are found twice may differ.
    """
    ranged = written(written(df).repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_p", *by).agg(F.count("*").alias("_n")).select("_p", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return ranged.withColumn(name, F.row_number().over(w)).join(F.broadcast(sizes), ["_p", *by]).withColumn(name, (F.col(name) + F.col("_b")).cast("long")).drop("_p", "_b")


def small_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", order: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """rows joined with few, which is counted first: up to `most` rows of it are broadcast, more are joined by key.

    With order, the rows of a partition keep the order they have, or are sorted by those columns.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), keys, how)
    joined = rows.join(few, keys, how)
    return joined.sortWithinPartitions(*order) if order else joined
