"""Sharding: best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups are packed by decreasing size, each into the shard with the tightest remaining capacity that
still holds it, found in a balanced tree of capacities. What fits nowhere opens a new shard, or, if the
number of shards is fixed, goes to the emptiest one.

It takes two levels, each by the same packing, so that no task and no driver holds all groups:

1. Groups of under 1/`grain` of a shard are dealt by hash to lanes of about `LANE` groups, and each lane packs its own by
   size into packets of 1/`grain` of a shard, in parallel.
2. Packets and larger groups are packed into shards. With a fixed number of shards the driver does it: there are at most
   about 2 * `grain` of them a shard, and `grain` falls as shards rise, so that they stay under about `MOST`. With a given capacity
   they are dealt by hash to stretches of about `STRETCH` shards, which are packed in parallel and numbered on.

Edge cases. A null text counts as no bytes, like an empty one: size 1, crc 0, one group with empty texts.
Repeated rows each get a slot. One group larger than the capacity fills a shard alone, as far as the
others allow. An empty table gives an empty result. The rows of a very common text are joined in many tasks. Columns
other than doc_id and text are carried through by `shard`, but for those it adds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, materialise

SHARDS = 16
#: Packets of a shard; groups of a lane; items that the driver packs; shards of a stretch.
GRAIN, LANE, MOST, STRETCH = 4096, 50_000, 1 << 17, 64


class _Tree:
    """A treap of (capacity, shard): the smallest entry not below a size, in a logarithm of the shards."""

    def __init__(self):
        self.root, self.state = None, 88172645463325252

    def _priority(self) -> int:
        for a, b in ((13, 7), (17, 0)):
            self.state ^= (self.state << a) & (2**64 - 1)
            self.state ^= self.state >> b if b else 0
        return self.state

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[2], right = self._split(t[2], key)
            return t, right
        left, t[1] = self._split(t[1], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take(self, least):
        """Removes and returns the smallest key >= least, or None."""
        left, right = self._split(self.root, least)
        if right is None:
            self.root = left
            return None
        t, above = right, None
        while t[1] is not None:
            above, t = t, t[1]
        if above is None:
            right = t[2]
        else:
            above[1] = t[2]
        self.root = self._merge(left, right)
        return t[0]

    def largest(self):
        t = self.root
        while t is not None and t[2] is not None:
            t = t[2]
        return t and t[0]


def best_fit_decreasing(sizes: list[int], capacity: int, n_shards: int | None = None) -> list[int]:
    """The shard of each item. Without n_shards as many shards are opened as are needed."""
    tree, opened, out = _Tree(), 0, [0] * len(sizes)
    if n_shards:
        for opened in range(n_shards):
            tree.add((capacity, opened))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take((sizes[i], -1))
        if found is None and n_shards:
            found = tree.take(tree.largest())
        elif found is None:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def _pack(batches, capacity: int):
    """(key, lane, bin) of rows (lane, key, bytes) sorted by lane, then decreasing bytes; each lane opens bins as it needs them."""

    def packed(lane, keys, sizes):
        bins = best_fit_decreasing(sizes, capacity)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([lane] * len(keys), pa.int64()), pa.array(bins, pa.int64())], ["key", "lane", "bin"])

    lane, keys, sizes = None, [], []
    for b in batches:
        for at, key, size in zip(*(b.column(c).to_pylist() for c in ("lane", "key", "bytes")), strict=True):
            if keys and at != lane:
                yield packed(lane, keys, sizes)
                keys, sizes = [], []
            lane = at
            keys.append(key)
            sizes.append(size)
    if keys:
        yield packed(lane, keys, sizes)


def _in_lanes(items: DataFrame, lanes: int, capacity: int) -> DataFrame:
    """(key, lane, bin) of (key, bytes), dealt by hash to so many lanes."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes)))
    dealt = dealt.repartition(min(lanes, parts), "lane").sortWithinPartitions("lane", F.desc("bytes"), "key").select("lane", "key", "bytes")
    return dealt.mapInArrow(lambda batches: _pack(batches, capacity), "key string, lane long, bin long")


def placed_groups(groups: DataFrame, n_shards: int | None, capacity: int | None, grain: int = GRAIN, lane: int = LANE, stretch: int = STRETCH) -> DataFrame:
    """groups (key, bytes, n) with their shard."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    capacity = capacity or max(1, math.ceil(total / n_shards))
    if n_shards:
        grain = max(1, min(grain, MOST // n_shards))
    small = F.col("bytes") * grain < capacity
    n_small = groups.where(small).count()
    lanes = max(1, math.ceil(n_small / lane))
    if n_shards:
        lanes = min(lanes, grain * n_shards)
    packets = _in_lanes(groups.where(small).select("key", "bytes"), lanes, max(1, capacity // grain))
    packets = packets.select("key", F.concat(F.col("lane").cast("string"), F.lit("."), F.col("bin").cast("string")).alias("item"))
    member = materialise(groups.where(small).join(packets, "key").unionByName(groups.where(~small).withColumn("item", F.col("key"))))
    items = member.groupBy(F.col("item").alias("key")).agg(F.sum("bytes").alias("bytes"))
    if n_shards:
        rows = items.orderBy("key").collect()  # at most about MOST
        shards = best_fit_decreasing([r["bytes"] for r in rows], capacity, n_shards)
        plan = spark.createDataFrame([(r["key"], s) for r, s in zip(rows, shards, strict=True)], "item string, shard int")
        return member.join(F.broadcast(plan), "item").drop("item")
    found = materialise(_in_lanes(items, max(1, total // (stretch * capacity)), capacity))
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    starts = found.groupBy("lane").agg((F.max("bin") + 1).alias("k")).select("lane", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    plan = found.join(starts, "lane").select(F.col("key").alias("item"), (F.col("first") + F.col("bin")).cast("int").alias("shard"))
    return member.join(plan, "item").drop("item")


def shard(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None, **sizes) -> DataFrame:
    """docs with size, text_crc32, shard and slot, without text; give the number of shards or their capacity in bytes."""
    text = F.coalesce("text", F.lit(""))
    added = ("text", "size", "text_crc32", "shard", "slot")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    slim = materialise(docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.sha2(text, 256).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    groups = materialise(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    where = materialise(placed_groups(groups, n_shards, capacity, **sizes).select("key", "n", "shard"))
    order = [F.col("shard"), F.col("key"), F.col("_id")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = join_spread(slim, where, ["key"]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = materialise(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("key", "_id"))
    runs = sorted_.groupBy("shard", "_part").agg(F.count("*").alias("k"), F.min("_at").alias("low"))  # as many as shards and partitions
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "_part", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("low")).alias("_shift"))
    out = sorted_.join(F.broadcast(starts), ["shard", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift"))
    return out.select("_row.*", *added[1:])


def op2(docs: DataFrame) -> DataFrame:
    out = shard(docs.select("doc_id", "text"), n_shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, capacity: int) -> None:
    """Writes docs as one folder a shard of at most capacity bytes (a larger group has its own); docs with a column `shard` go into struct `_doc`."""
    out = shard(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "text"), capacity=capacity)
    out.select("shard", "_doc.*" if "shard" not in docs.columns else F.col("_doc")).write.partitionBy("shard").parquet(path)
