"""Exact top-k search by pivot-table elimination: integer inner products of whole tables of vectors.

The components x of all vectors become floor(scale * x). Up to `PIVOTS` vectors, each far from the others, are chosen from a sample of `SAMPLE` rows
(the sample decides how sharp bounds are, never what is found), and the origin is a pivot too. The distances of every vector to the
pivots are computed once and written, in ranges of (nearest pivot, distance to it), so that a range is a thin shell. For a query q and a
vector c, the largest |d(q, p) - d(c, p)| over the pivots p is a lower bound of d(q, c), so (|q|^2 + |c|^2 - bound^2) / 2 is an upper
bound of their product. Whole chunks are left out by the intervals of their distances; the candidates of the others are evaluated in
the order of their bounds until the next bound is under the k-th score. That score starts at the k-th of the query's products
with the pivots, which are rows of the table. Queries come in blocks of at most about `QUERIES`, each a pass over the written table, so no pair of them is shuffled, and
tasks return k rows a query at most.

Edge cases. Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths do not meet. A
query's own rows are those of its id; ids that are null are candidates only, and last among equal scores. Every row is a candidate of its own, so
repeated rows fill several ranks; repeated queries (equal id and vector) are one. Vectors without components score 0. Columns other
than the two are not carried. Products are exact while they fit 64 bits. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of the sample, pivots, queries of a block, components of a chunk, queries whose bounds are computed at a time, products computed at first.
SAMPLE, PIVOTS, QUERIES, CHUNK, STRIP, FIRST = 2048, 64, 1 << 13, 1 << 19, 32, 64


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, v) of (id, embedding): the integer components, as doubles."""
    e = F.col("embedding")
    finite = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select("id", F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows; differences, not products, are squared, so that near rows lose no digits."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in y], 1) if len(y) else np.zeros((len(x), 0))


def _by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (rows) of each length in an Arrow column of lists."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        out[dim] = at, np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    return out


def pivots(sample: pa.Table, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Places in the sample of up to `most` vectors of each length, each the farthest from those before it."""
    out = {}
    for dim, (at, x) in _by_length(sample.column("v").combine_chunks()).items():
        far, chosen = np.sqrt((x**2).sum(1)), []  # distance to the nearest pivot, of which the origin is the first
        while len(chosen) < most and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _apart(x, x[chosen[-1:]])[:, 0])
        out[dim] = at[chosen]
    return out


def pivot_table(rows: DataFrame, held: dict[int, np.ndarray]) -> DataFrame:
    """(id, v, d) of (id, v): distances to the origin and to the pivots of the vector's length (held), in ranges of the nearest pivot."""

    def run(batches):
        for b in batches:
            for dim, (at, x) in _by_length(b.column("v")).items():
                d = np.c_[np.sqrt((x**2).sum(1)), _apart(x, held.get(dim, np.zeros((0, dim))))]
                own = d[:, 1:] if d.shape[1] > 1 else d
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                near = own.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at)), lists, pa.array(near), pa.array(own.min(1))], ["id", "v", "d", "cell", "near"])

    kind = rows.schema["id"].dataType.simpleString()
    found = materialise(rows.mapInArrow(run, f"id {kind}, v array<double>, d array<double>, cell int, near double"))
    return materialise(found.repartitionByRange(F.size("v"), "cell", "near", F.xxhash64("id", "v")).select("id", "v", "d"))


class Block:
    """Queries of one length with their distances to the pivots and the scores that k rows are known to reach."""

    def __init__(self, ids: list, x: np.ndarray, pivot_ids: list, pivot: np.ndarray, k: int):
        self.ids, self.x = ids, x
        self.d = np.c_[np.sqrt((x**2).sum(1)), _apart(x, pivot)]
        self.floor = np.full(len(ids), -math.inf)
        for q, own in enumerate(ids):
            scores = sorted(products(pivot, x[q])[[p != own for p in pivot_ids]].tolist()) if pivot_ids else []
            if len(scores) >= k:
                self.floor[q] = scores[-k]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of rows of x with q, by doubles where they hold them exactly."""
    if not len(x) or np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < 2**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def scan(block: Block, ids: pa.Array, x: np.ndarray, d: np.ndarray, floor: np.ndarray, best: list[list], k: int) -> int:
    """Brings best, lists of (score, id), up to date with the rows (ids, x, d); returns how many products it took."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    names, taken = ids.to_pylist(), 0
    square = d[:, 0] ** 2
    slack = 1e-9 * (block.d[:, 0] ** 2 + square.max()) + 1
    gap = np.maximum(np.maximum(d.min(0) - block.d, block.d - d.max(0)), 0).max(1)
    live = np.flatnonzero((block.d[:, 0] ** 2 + square.max() - gap**2) / 2 + slack >= floor)
    for at in range(0, len(live), STRIP):
        qs = live[at : at + STRIP]
        low = np.zeros((len(qs), len(x)))
        for p in range(d.shape[1]):
            np.maximum(low, np.abs(block.d[qs, p][:, None] - d[None, :, p]), out=low)
        bound = (block.d[qs, 0][:, None] ** 2 + square - low**2) / 2 + slack[qs][:, None]
        for row, q in enumerate(qs.tolist()):
            can = np.flatnonzero(bound[row] >= floor[q])
            can = can[np.argsort(-bound[row, can], kind="stable")]
            own, done, step = block.ids[q], 0, FIRST
            while done < len(can) and bound[row, can[done]] >= floor[q]:
                part = can[done : done + step]
                done, step, taken = done + len(part), min(step * 2, 4096), taken + len(part)
                scores = products(x[part], block.x[q])
                hit = np.flatnonzero(scores >= floor[q])
                hit = hit[np.lexsort((place[part[hit]], -scores[hit]))][: k + sum(1 for i in part if names[i] == own)]
                new = [(int(scores[i]), names[part[i]]) for i in hit if names[part[i]] != own]
                if new:
                    best[q] = sorted(best[q] + new, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], best[q][-1][0])
    return taken


def search(vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): for each row of (id, embedding) where `asked` holds, the k rows of the highest products."""
    spark, kind = vectors.sparkSession, vectors.schema["id"].dataType.simpleString()
    rows = usable(vectors.select("id", "embedding"), scale)
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()
    chosen = pivots(sample)
    names = {dim: sample.column("id").take(pa.array(at)).to_pylist() for dim, at in chosen.items()}
    held = {dim: sample.column("v").combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim) for dim, at in chosen.items()}
    table = pivot_table(rows, held)
    queries = materialise(table.where(asked).groupBy("id", "v").agg(F.lit(1).alias("one")).select("id", "v"))
    blocks = math.ceil(queries.count() / QUERIES)
    found = []
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == number).toArrow()
        if own.num_rows:
            block = {dim: Block(own.column("id").take(pa.array(at)).to_pylist(), x, names.get(dim, []), held.get(dim, np.zeros((0, dim))), k) for dim, (at, x) in _by_length(own.column("v").combine_chunks()).items()}
            found.append(materialise(_ranked(_scanned(table, block, k, kind), k)))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _scanned(table: DataFrame, block: dict[int, Block], k: int, kind: str) -> DataFrame:
    """(dim, q, id, score): the best rows of each task for the queries of a block, by length and place."""

    def run(batches):
        floor = {dim: b.floor.copy() for dim, b in block.items()}
        best: dict[int, list[list]] = {dim: [[] for _ in b.ids] for dim, b in block.items()}
        kept = None
        for batch in batches:
            kept = batch.schema.field("id").type
            for dim, (at, x) in _by_length(batch.column("v")).items():
                if dim in block:
                    d = batch.column("d").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    ids, rows = batch.column("id").take(pa.array(at)), max(1, CHUNK // max(1, dim))
                    for start in range(0, len(at), rows):
                        part = slice(start, start + rows)
                        scan(block[dim], ids[part], x[part], d[part], floor[dim], best[dim], k)
        for dim, lists in best.items():
            out = [(q, name, score) for q, held in enumerate(lists) for score, name in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], kept), pa.array([r[2] for r in out], pa.int64())], ["dim", "q", "id", "score"])

    spark = table.sparkSession
    ids = spark.createDataFrame([(dim, q, name) for dim, b in block.items() for q, name in enumerate(b.ids)], f"dim int, q int, query_id {kind}")
    return table.mapInArrow(run, f"dim int, q int, id {kind}, score long").join(ids, ["dim", "q"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("dim", "q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op13(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return search(rows, F.col("id") % 100 == 0, 10, 1024).withColumnRenamed("id", "vec_id")


OP13_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from (select distinct * from v where vec_id % 100 = 0) q join v c on c.vec_id is distinct from q.vec_id and len(c.e) = len(q.e)
), placed as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from placed where rank <= 10
"""
