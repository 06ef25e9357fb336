"""Catalogue operators: statistics, timeline, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(items: DataFrame) -> DataFrame:
    """One row over (id, created_at string, provider, n_messages)."""
    day = F.substring("created_at", 1, 10)
    return items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("n_messages"), F.lit(0)).cast("long").alias("n_messages"), F.coalesce(F.min(day), F.lit("")).alias("first_day"), F.coalesce(F.max(day), F.lit("")).alias("last_day"), F.count_distinct("provider").alias("n_providers"))


def timeline(items: DataFrame) -> DataFrame:
    """(month, cluster, n), dates that do not parse dropped; cluster -1 is the month's total."""
    month = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM")
    return items.withColumn("month", month).where("month is not null").rollup("month", "cluster").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3").select("month", F.when(F.col("g") == 0, F.col("cluster")).otherwise(-1).cast("long").alias("cluster"), "n")


def listing(items: DataFrame, sort: str = "date", offset: int = 0, limit: int = 20, provider: str | None = None) -> DataFrame:
    """A page of items (id, created_at, name, n_messages, provider, pos); ties keep the order of pos."""
    keys = {"date": F.desc("created_at"), "title": F.asc(F.lower("name")), "message_count": F.desc("n_messages")}
    if provider is not None:
        items = items.where(F.col("provider") == provider)
    return items.orderBy(keys.get(sort, keys["date"]), "pos").offset(max(0, offset)).limit(min(50, max(1, limit)))


def recent(items: DataFrame, n: int = 10, before: str | None = None, after: str | None = None, provider: str | None = None) -> DataFrame:
    """The n latest items; bounds compare strictly as strings, so '' passes `before` and fails `after`."""
    if before is not None:
        items = items.where(F.col("created_at") < before)
    if after is not None:
        items = items.where(F.col("created_at") > after)
    return listing(items, "date", 0, n, provider)


def graph_stats(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, percentile: int = 95) -> DataFrame:
    """One row over nodes (id, created_at, n_messages), edges and clusters; dates that do not parse are left out."""
    day = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM-dd")
    own = nodes.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("n_messages"), F.lit(0)).cast("long").alias("n_messages"), F.coalesce(F.min(day), F.lit("")).alias("first_day"), F.coalesce(F.max(day), F.lit("")).alias("last_day"))
    counts = edges.agg(F.count("*").alias("n_edges")).crossJoin(clusters.agg(F.count("*").alias("n_clusters")))
    return own.crossJoin(F.broadcast(counts)).withColumn("edge_percentile", F.lit(percentile))


def fingerprint(items: DataFrame) -> DataFrame:
    """One row (n_messages, last_day): two corpora that differ in it are not the same."""
    return corpus_stats(items).select("n_messages", "last_day")


def same_corpus(a: DataFrame, b: DataFrame) -> str:
    """"match" or "DIVERGED"."""
    return "match" if fingerprint(a).first() == fingerprint(b).first() else "DIVERGED"


def plan_summary(parsed: DataFrame, fresh: DataFrame) -> DataFrame:
    """(source, n_parsed, n_new, first, last) of parsed (id, source, created_at) and the fresh rows of them; '-' without a date."""
    dated = F.nullif("created_at", F.lit(""))
    new = fresh.groupBy("source").agg(F.count("*").alias("n_new"), F.min(dated).alias("first"), F.max(dated).alias("last"))
    both = parsed.groupBy("source").agg(F.count("*").alias("n_parsed")).join(new, "source", "left")
    return both.select("source", "n_parsed", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("first", F.lit("-")).alias("first"), F.coalesce("last", F.lit("-")).alias("last"))
