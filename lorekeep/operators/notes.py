"""Notes on conversations: an append-only table of additions and deletions."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists, files, text_of

NOTE = "conv_id string, note_id string, text string, created_at string"
_SIDECAR = "map<string, array<struct<note_id: string, text: string, created_at: string>>>"


class Notes:
    """Notes under a folder. Each change is one appended file, so a failed write leaves the notes as they were."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _log(self) -> DataFrame:
        schema = f"{NOTE}, op string"
        if not exists(self.spark, f"{self.folder}/log"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/log")

    def _append(self, rows: DataFrame, op: str) -> None:
        rows.select(*(F.col(c.split()[0]) for c in NOTE.split(", ")), F.lit(op).alias("op")).write.mode("append").parquet(f"{self.folder}/log")

    def table(self) -> DataFrame:
        """(conv_id, note_id, text, created_at) of notes that stand."""
        log = self._log()
        return log.where("op = 'add'").drop("op").join(log.where("op = 'delete'").select("conv_id", "note_id"), ["conv_id", "note_id"], "left_anti").select("conv_id", "note_id", "text", "created_at")

    def fingerprint(self) -> str:
        """A digest of the log that does not depend on the order of its rows."""
        row = self._log().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("conv_id", "note_id", "text", "created_at", "op").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return f"{row.n}-{row.h}"

    def of(self, conv_id: str) -> DataFrame:
        return self.table().where(F.col("conv_id") == conv_id).orderBy("created_at", "note_id")

    def counts(self) -> DataFrame:
        return self.table().groupBy("conv_id").agg(F.count("*").alias("notes_count"))

    def add(self, conv_id: str, text: str) -> dict:
        note = {"conv_id": conv_id, "note_id": uuid.uuid4().hex[:8], "text": text, "created_at": datetime.now(timezone.utc).isoformat()}
        self._append(self.spark.createDataFrame([note], NOTE), "add")
        return note

    def delete(self, conv_id: str, note_id: str) -> bool:
        """Whether there was such a note."""
        found = self.of(conv_id).where(F.col("note_id") == note_id)
        if found.isEmpty():
            return False
        self._append(self.spark.createDataFrame([(conv_id, note_id, None, None)], NOTE), "delete")
        return True

    def restore(self, notes: DataFrame) -> None:
        """Adds notes that do not stand yet, as after a rebuild; a note is its conversation, id and text."""
        self._append(notes.dropDuplicates(["conv_id", "note_id", "text"]).join(self.table(), ["conv_id", "note_id", "text"], "left_anti"), "add")

    def backup(self) -> str:
        """Writes the notes that stand beside the log; only the newest `keep` backups stay."""
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S.%f")
        path = f"{self.folder}/backups/at={stamp}"
        self.table().write.parquet(path)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/backups")
        store = top.getFileSystem(conf)
        for old in sorted((s.getPath() for s in store.listStatus(top)), key=lambda p: p.getName())[: -self.keep]:
            store.delete(old, True)
        return path


def read_sidecar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, corrupt): notes of JSON files {conversation: [notes]}, and the paths of files that do not parse, left as they are.

    A missing path gives no notes.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], NOTE), spark.createDataFrame([], "path string")
    raw = files(spark, path).select("path", text_of(F.col("content")).alias("t")).withColumn("v", F.try_parse_json("t"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    notes = raw.where(good).select(F.explode(F.from_json("t", _SIDECAR)).alias("conv_id", "ns")).select("conv_id", F.inline("ns"))
    return notes.select("conv_id", "note_id", "text", "created_at"), raw.where(~good).select("path")


def legacy_notes(conversations: DataFrame) -> DataFrame:
    """Notes that older records carry in an array `notes` of (note_id, text, created_at)."""
    return conversations.select(F.col("id").alias("conv_id"), F.inline("notes")).select("conv_id", "note_id", "text", "created_at")
