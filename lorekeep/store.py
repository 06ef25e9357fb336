"""Versions of tables under a folder. Rows of bucketed tables lie in `data`, by a hash of their id; a version lists the folders of its buckets, so
versions share those that did not change. A version counts once its pointer row is written, after all else, so readers see whole versions
and a failed write changes nothing; what nothing points to goes with `vacuum`."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators.common import remove
from .sources.files import exists, names

#: Buckets of a table; a stored one keeps its own number.
BUCKETS = 16
POINTER = "version string, at string, token string"
PARTS = "name string, bucket int, buckets int, folder string, schema string"


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def bucket_of(id_, buckets: int):
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def pointers(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).parquet(f"{self.root}/{name}")

    def pointed(self, name: str) -> str | None:
        """Where the latest pointer row of a name points."""
        row = self.pointers(name).orderBy(F.desc("at")).first()
        return row.version if row else None

    def point(self, name: str, version: str, token: str | None = None) -> None:
        self.spark.createDataFrame([(version, now(), token)], POINTER).write.mode("append").parquet(f"{self.root}/{name}")

    def of_token(self, token: str) -> str | None:
        """The version that a write with this token made, if it came to its end."""
        row = self.pointers("current").where(F.col("token") == token).first()
        return row.version if row else None

    def parts(self, version: str) -> list[Row]:
        """The folders of a version's bucketed tables: at most tables times buckets."""
        return self.spark.read.schema(PARTS).parquet(f"{self.root}/{version}/parts").collect()

    def read(self, parts: list[Row]) -> DataFrame:
        """The rows of parts of one table."""
        schema = StructType.fromJson(json.loads(parts[0].schema))
        folders = [p.folder for p in parts if p.folder]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def buckets_of(self, ids: list[str], buckets: int) -> set[int]:
        return {r.b for r in self.spark.createDataFrame([(i,) for i in ids], "id string").select(bucket_of("id", buckets).alias("b")).collect()}

    def read_ids(self, parts: list[Row], ids: list[str], numbers: set[int]) -> DataFrame:
        """The rows of some ids, of which there are few, from their buckets."""
        return self.read([p for p in parts if p.bucket in numbers] or parts[:1]).where(F.col("id").isin(ids))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes versions but the newest `keep` that were pointed to, unfinished ones, and data of which no version is left; returns the names of what
        it removed. Nothing may be read from an older version, or written, meanwhile."""
        last = self.pointers("current").groupBy("version").agg(F.max("at").alias("at")).orderBy(F.desc("at")).limit(keep).collect()
        kept = {r.version for r in last}
        used = {p.folder.split("/data/", 1)[1].split("/", 1)[0] for v in kept for p in self.parts(v) if p.folder}
        gone = [f"{self.root}/{n}" for n in names(self.spark, self.root) if n.startswith("v-") and n not in kept]
        gone += [f"{self.root}/data/{n}" for n in names(self.spark, f"{self.root}/data") if n not in used]
        manifest = self.pointed("manifest")
        gone += [f"{self.root}/manifests/{n}" for n in names(self.spark, f"{self.root}/manifests") if n != manifest]
        for path in gone:
            remove(self.spark, path)
        return gone


class Draft:
    """A version that is being written. base are the parts of the version it comes from, [] for none."""

    def __init__(self, store: Store, base: list[Row], progress=None):
        self.store, self.name, self.progress = store, f"v-{uuid.uuid4().hex}", progress or (lambda name: None)
        self.parts: dict[str, list[Row]] = {}
        for p in base:
            self.parts.setdefault(p.name, []).append(p)

    def table(self, name: str) -> DataFrame:
        return self.store.read(self.parts[name])

    def _folders(self, name: str, df: DataFrame, buckets: int, found: list[str], path: str) -> list[Row]:
        schema = df.drop("_bucket").schema.json()
        part = Row("name", "bucket", "buckets", "folder", "schema")
        rows = [part(name, int(f.split("=")[1]), buckets, f"{path}/{f}", schema) for f in found if f.startswith("_bucket=")]
        return rows or [part(name, -1, buckets, "", schema)]

    def put(self, name: str, rows: DataFrame, stale: DataFrame | None = None, key: str = "id") -> DataFrame:
        """Rows in place of those of the base whose key is in stale (id); only the buckets of stale keys are written again. Returns the new rows.

        The keys of rows are among the stale ones.
        """
        old = self.parts.get(name, [])
        n = old[0].buckets if old else self.store.buckets
        touched = {r.b for r in stale.select(bucket_of("id", n).alias("b")).distinct().collect()} if old and stale is not None else set()
        own = [p for p in old if p.bucket in touched]
        path = f"{self.store.root}/data/{uuid.uuid4().hex}"
        whole = rows if not own else self.store.read(own).join(stale.select(F.col("id").alias(key)), key, "left_anti").unionByName(rows)
        whole.withColumn("_bucket", bucket_of(key, n)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        new = self._folders(name, rows, n, names(self.store.spark, path), path)
        rest = [p for p in old if p.bucket not in touched and p.folder]
        self.parts[name] = ([p for p in new if p.folder] + rest) or new
        self.progress(name)
        return self.table(name)

    def add(self, name: str, write, schema: str = "") -> str:
        """One more part of a table whose parts are folders of any form, which write(folder) makes."""
        folder = f"{self.store.root}/data/{uuid.uuid4().hex}"
        write(folder)
        held = self.parts.setdefault(name, [])
        number = max((p.bucket for p in held), default=-1) + 1
        held.append(Row("name", "bucket", "buckets", "folder", "schema")(name, number, 0, folder, schema))
        self.progress(name)
        return folder

    def derive(self, name: str, df: DataFrame) -> DataFrame:
        """A table of this version alone."""
        path = f"{self.store.root}/{self.name}/{name}"
        df.write.parquet(path)
        self.progress(name)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def finish(self, token: str | None = None) -> str:
        rows = [tuple(p) for held in self.parts.values() for p in held]
        self.store.spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{self.store.root}/{self.name}/parts")
        self.store.point("current", self.name, token)
        return self.name
