"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import new_folder, remove, shared_dir
from ..operators.common import written as materialise

__all__ = ["WORD", "bound", "components", "join_spread", "materialise", "new_folder", "packed", "remove", "shared_dir", "table", "unpacked", "words"]

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_spread(rows: DataFrame, given: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with given, which has one row a key and in column n (dropped) how many of rows have that key.

    A key of more than its share of rows is dealt to as many salts as it has shares, a share being 1/P of all rows;
    so no task gets more than a share of one key. The list of such keys is broadcast: there are fewer than P. Rows without a key are spread too.
    given is read several times: pass a written table. The salt depends on the row and its partition, so it is the same when a task is
    run again, and rows that are repeated are spread as well.
    """
    p = max(256, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = given.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(given.where(F.col(n) * p > total).select(*keys, F.ceil(F.col(n) * p / F.lit(float(max(total, 1)))).cast("int").alias("_salts")))
    nowhere = F.lit(False)
    for k in keys:
        nowhere = nowhere | F.col(k).isNull()
    salts = F.when(nowhere, F.lit(p)).otherwise(F.coalesce("_salts", F.lit(1)))
    held = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    salted = rows.withColumn("_salt", F.xxhash64(F.spark_partition_id(), *held)).join(hot, keys, "left").withColumn("_salt", F.pmod("_salt", salts).cast("int")).drop("_salts")
    copies = given.drop(n).join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def packed(docs: DataFrame, **more) -> DataFrame:
    """The columns of docs in one struct `_row`, so that no name of theirs can clash, beside the given ones."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def unpacked(docs: DataFrame) -> list:
    """The columns of docs, out of `_row`."""
    return [F.col("_row").getField(c).alias(c) for c in docs.columns]


def words(text):
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bound(array, body):
    """body(array) with the array computed once, however often a lambda of body refers to it."""
    return F.transform(F.array(array), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, component) for each node
    of an edge, component being the smallest node reachable.

    Alternates large-star and small-star steps, as grouped minima and joins. A node of many edges is joined in many
    tasks (join_spread); each step's result is written to the shared folder.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = materialise(join_spread(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_spread(large, low, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
