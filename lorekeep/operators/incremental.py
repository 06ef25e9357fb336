"""Incremental ingest: deltas, manifests, upserts, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_ids(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of parsed whose id is not known, the first (by pos) of each id."""
    w = Window.partitionBy("id").orderBy("pos")
    return parsed.join(known.select("id"), "id", "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def classify(found: DataFrame, manifest: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """found (id, sha, and columns to carry) with status new, changed or unchanged."""
    old = manifest.select("id", F.col("sha").alias("old"))
    return found.join(old, "id", "left").select("id", "sha", *(carry or []), F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha"), "changed").otherwise("unchanged").alias("status"))


def absent(known: DataFrame, parsed: DataFrame) -> DataFrame:
    """Known rows whose id is not parsed any more: to be recorded, not dropped."""
    return known.join(parsed.select("id"), "id", "left_anti")


def last_shard(rows: DataFrame) -> DataFrame:
    """The row of the last shard of each id, within it the last by pos."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("shard", "pos")).alias("r")).select("r.*")


def after(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows with created_at beyond the cutoff, compared as strings."""
    return rows.where(F.col("created_at") > cutoff)


def with_users(conversations: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Conversations with at least so many user messages, and the trivial others."""
    n = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return conversations.where(n >= least), conversations.where(n < least)


def next_manifest(manifest: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """The manifest (id, sha, last_seen) after a run that found (id, sha), those skipped as trivial too."""
    seen = found.select("id", "sha").withColumn("last_seen", F.lit(at))
    return manifest.select("id", "sha", "last_seen").join(seen.select("id"), "id", "left_anti").unionByName(seen)


def upsert(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return existing.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def freshest(items: DataFrame) -> DataFrame:
    """The row of latest mtime of each id, ties to the first source_rank."""
    w = Window.partitionBy("id").orderBy(F.desc("mtime"), "source_rank")
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_notes(preserved: DataFrame, current: DataFrame) -> DataFrame:
    """Notes of both, distinct on conversation, note and text, preserved ones first."""
    both = preserved.withColumn("src", F.lit(0)).unionByName(current.withColumn("src", F.lit(1)))
    w = Window.partitionBy("conv_id", "note_id", "text").orderBy("src", "seq")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
