"""Ingest of a folder of exports as a stream of its files: each file once, also if the job is killed anywhere and run again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..engine import MemoryEngine
from ..sources import exports
from ..sources.files import FILE


def stream_ingest(engine: MemoryEngine, provider: str, path: str, checkpoint: str, k: int | None = None, glob: str | None = None, files_a_batch: int = 1000, once: bool = True):
    """Starts a query that ingests the files of a folder, those that are there and, unless once, those that come; returns it.

    The checkpoint remembers which files a batch has; a batch is a version of the engine's tables, whose pointer row carries the batch's token. A batch that
    was killed before that row is written again as a whole, and one killed after it, before the checkpoint knew, finds its token and does
    nothing. Batches of files without conversations, or with known ones only, make no version.
    """
    spark, name = engine.spark, hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    options = {"recursiveFileLookup": True, "maxFilesPerTrigger": files_a_batch} | ({"pathGlobFilter": glob} if glob else {})
    found = spark.readStream.format("binaryFile").schema(FILE).options(**options).load(path).select("path")

    def ingest(batch: DataFrame, number: int) -> None:
        token = f"{name}-{number}"
        if engine.store.of_token(token) is None:
            paths = [r.path for r in batch.collect()]  # at most files_a_batch
            if paths:
                engine.ingest(exports.read(spark, provider, paths), k=k, token=token)

    writer = found.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
