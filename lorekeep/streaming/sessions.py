"""Sessions: a gap over 30 minutes starts a new one; a batch form and a streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import written


def sessionise(events: DataFrame, minutes: int = 30) -> DataFrame:
    """events (user_id, ts, event_id, ...) with the 1-based session of the user.

    Events are dealt in ranges of user and time, so a user of very many events is in several tasks; sessions are counted
    within a range, and what a range adds is carried over to the user's next ranges. Only users of several ranges need that:
    at most two a range, so their list is broadcast.
    """
    order = ["user_id", "ts", "event_id"]
    ranged = written(events.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    at = lambda c: c.cast("timestamp").cast("double")
    w = Window.partitionBy("_p", "user_id").orderBy("ts", "event_id")
    own = ranged.withColumn("_new", F.coalesce((at(F.col("ts")) - at(F.lag("ts").over(w)) > minutes * 60).cast("int"), F.lit(0)))
    parts = own.groupBy("user_id", "_p").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("_new").alias("n"))
    by = Window.partitionBy("user_id").orderBy("_p")
    begins = F.coalesce((at(F.col("first")) - at(F.lag("last").over(by)) > minutes * 60).cast("int"), F.lit(1))
    parts = parts.withColumn("begins", begins).withColumn("_before", F.sum(F.col("begins") + F.col("n")).over(by) - F.col("n"))
    later = parts.where("_before > 1 or begins = 0").select(F.col("user_id").alias("_u"), F.col("_p").alias("_q"), "_before")
    counted = own.withColumn("_inside", F.sum("_new").over(w)).join(F.broadcast(later), F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("_p") == F.col("_q")), "left")
    return counted.withColumn("session", F.col("_inside") + F.coalesce("_before", F.lit(1))).select(*events.columns, "session")


def headers(sessions: DataFrame) -> DataFrame:
    """First event, length and bounds of each session."""
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return sessions.groupBy("user_id", "session").agg(first.alias("first_event"), F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def stream_sessions(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """The same sessions of a stream; one is emitted when the watermark passes its end."""
    window = F.session_window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("session_window")
