"""Similarity graph: pairs, thresholds, thinning; similarity.py holds the capped graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalise
from . import cosines
from .common import numbered, written

#: Vectors of a block, bins of a histogram, values that are sorted at last, how far about a block's percentile that of all is looked for first.
BLOCK, BINS, FEW, ABOUT = 2048, 1 << 14, 1 << 19, 0.02
#: Bins of weights, and edges that one task numbers unless a bin has more.
WEIGHTS, RANGE = 1 << 14, 1 << 20


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """All pairs of blocks of (id, vector), each pair once: numbers, ids and flat unit vectors of both (i, x, vx, j, y, vy, same). Rows without a
    vector are left out; the others have equal lengths. Only the blocks are written, not their pairs."""
    unit = written(vectors.where("vector is not null").select("id", normalise(F.col("vector")).alias("v")))
    k = max(6, math.ceil(unit.count() / block))  # six blocks at least, so that all cores have some of their 21 pairs
    dealt = unit.groupBy(F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("i")).agg(F.collect_list("id").alias("x"), F.flatten(F.collect_list("v")).alias("vx"))
    dealt = written(dealt.repartition(k, "i"))
    other = dealt.select(F.col("i").alias("j"), F.col("x").alias("y"), F.col("vx").alias("vy"))
    return cosines.met(dealt, other, F.col("i") <= F.col("j")).withColumn("same", F.col("i") == F.col("j"))


def _rows(batches):
    """(numbers of the blocks, ids of both, x, y, same) of each row of _blocks."""
    for b in batches:
        for r in range(b.num_rows):
            ids = [b.column(c)[r].values for c in ("x", "y")]
            x, y = (b.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(len(n), -1) for c, n in zip(("vx", "vy"), ids, strict=True))
            yield (b.column("i")[r].as_py(), b.column("j")[r].as_py()), ids, x, y, b.column("same")[r].as_py()


def _pairs(blocks: DataFrame, over: float = -math.inf, top: int = 0) -> DataFrame:
    """(a, b, w) with w > over. With top, what is not among the `top` heaviest (then by a, b) of either end in its task may be left out."""
    kind = blocks.schema["x"].dataType.elementType.simpleString()

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for numbers, ids, x, y, same in _rows(batches):
            both = pa.concat_arrays(ids)
            place = np.empty(len(both), np.int64)
            place[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
            for i, j, w in [_heaviest(best, numbers, place, x, y, same, over, top)] if top else cosines.between(x, y, same, over):
                j = j + len(x)
                first = place[i] < place[j]
                yield pa.RecordBatch.from_arrays([both.take(pa.array(np.where(first, i, j))), both.take(pa.array(np.where(first, j, i))), pa.array(w)], ["a", "b", "w"])

    return blocks.mapInArrow(run, f"a {kind}, b {kind}, w double")


def _heaviest(best: dict[int, np.ndarray], numbers: tuple[int, int], place: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, over: float, k: int):
    """(i, j, w) of the pairs with w > over that are among the first k of one of their ends, here and by weight in what the task has seen: best has
    the k heaviest weights of each row of the blocks by their numbers."""
    for number, rows in zip(numbers, (x, y), strict=True):
        best.setdefault(number, np.full((len(rows), k), -np.inf))
    low = [np.maximum(best[number][:, -1], over) - cosines.OFF for number in numbers]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at, s in cosines.strips(x, y, same):
        i, j = np.nonzero((s >= low[0][at : at + len(s), None]) | (s >= low[1][None, :]))
        w = cosines.rounded(x, y, i + at, j, s[i, j])
        ok = w > over
        found.append((i[ok] + at, j[ok], w[ok]))
    i, j, w = (np.concatenate(v) for v in zip(*found, strict=True))
    p, q = place[i], place[j + len(x)]
    order = np.lexsort((np.maximum(p, q), np.minimum(p, q), -w))
    keep = np.zeros(len(w), bool)
    for number, end in zip(numbers, (i, j), strict=True):
        at = order[np.argsort(end[order], kind="stable")]
        new = np.r_[True, end[at[1:]] != end[at[:-1]]][: len(at)]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
        at, rank = at[rank < k], rank[rank < k]
        keep[at] |= w[at] >= best[number][end[at], -1]
        here = np.full(best[number].shape, -np.inf)
        here[end[at], rank] = w[at]
        best[number] = -np.sort(-np.hstack([best[number], here]), axis=1)[:, :k]
    return i[keep], j[keep], w[keep]


def _cut(blocks: DataFrame, p: float) -> float | None:
    """The interpolated percentile of all cosines, None if there are none; it is first looked for about that of one block."""

    def run(use, kind):
        return blocks.mapInArrow(lambda batches: use((x, y, same) for _, _, x, y, same in _rows(batches)), kind)

    guess = cosines.ALL
    if some := blocks.where("same").select("i", "j", "x", "vx", "y", "vy", "same").limit(1).toArrow().to_batches():
        _, _, x, y, _ = next(_rows(some))
        if len(x) > 1:
            at = float(np.quantile((x @ y.T)[np.triu_indices(len(x), 1)], p))
            guess = (at - ABOUT, at + ABOUT)
    return cosines.percentile(run, p, *guess, cosines.counted(run, *guess, BINS), BINS, FEW)


def _over(vectors: DataFrame, p: float, block: int) -> tuple[DataFrame, float]:
    blocks = _blocks(vectors, block)
    cut = _cut(blocks, p)
    return blocks, math.inf if cut is None else cut


def over_percentile(vectors: DataFrame, p: float = 0.95, block: int = BLOCK, nodes: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, w) of (id, vector) strictly over the interpolated percentile of the cosines of all pairs; with nodes (id), those both of whose
    ends are in it.

    All pairs are multiplied, a block with a block, once for each histogram and once for the result, of the nodes only; only the result leaves its task.
    """
    blocks, cut = _over(vectors, p, block)
    return _pairs(blocks if nodes is None else _blocks(vectors.join(nodes.select("id"), "id", "left_semi"), block), cut)


def top_over_percentile(vectors: DataFrame, k: int, p: float = 0.95, block: int = BLOCK) -> DataFrame:
    """The edges of over_percentile that are among the k heaviest of either end; a task hands on some k a node at most as it goes, not all its edges."""
    return top_edges(_pairs(*_over(vectors, p, block), k), k)


def summary_over_percentile(vectors: DataFrame, p: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row (n, low, high) of the edges of over_percentile, which are counted where they are made."""
    blocks, cut = _over(vectors, p, block)

    def run(batches):
        n, low, high = 0, math.inf, -math.inf
        for _, _, x, y, same in _rows(batches):
            for _, _, w in cosines.between(x, y, same, cut):
                if len(w):
                    n, low, high = n + len(w), min(low, w.min()), max(high, w.max())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low if n else None], pa.float64()), pa.array([high if n else None], pa.float64())], ["n", "low", "high"])

    return blocks.mapInArrow(run, "n long, low double, high double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def at_percentile(edges: DataFrame, p: float) -> DataFrame:
    """Edges (a, b, w) of at least the weight at place floor(n * p / 100) in ascending order, not interpolated; past the last
    place the bound is 0."""
    placed = numbered(edges, [F.col("w"), F.col("a"), F.col("b")], "_at")
    n = placed.agg(F.count("*").alias("n"))
    bound = placed.crossJoin(F.broadcast(n)).where(F.col("_at") == F.floor(F.col("n") * p / 100) + 1).agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("_cut"))
    return placed.crossJoin(F.broadcast(bound)).where("w >= _cut").select("a", "b", "w")


def by_weight(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w) with `place`, from 1, by weight descending (then a, b).

    A pass finds the ends of the weights and one counts them in bins, so the place each range of bins begins at is known before edges are dealt to
    ranges. They are shuffled once and written nowhere else, but computed three times: write them before if that is dear.
    """
    edges = edges.select("a", "b", "w")
    ends = edges.agg(F.min("w").alias("low"), F.max("w").alias("high")).first()
    if ends.low is None:
        return edges.select("*", F.lit(0).cast("long").alias("place")).limit(0)
    width = (ends.high - ends.low) / WEIGHTS or 1.0
    bin_ = F.least(F.lit(WEIGHTS), F.floor((F.lit(ends.high) - F.col("w")) / F.lit(width))).cast("int")
    counts = np.zeros(WEIGHTS + 1, np.int64)
    for r in edges.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect():  # at most WEIGHTS + 1
        counts[r.bin] = r.n
    before = np.cumsum(counts) - counts
    ranges = np.maximum.accumulate(before // RANGE)
    first = [int(before[ranges == r].min()) for r in np.unique(ranges)]
    ranges = np.unique(ranges, return_inverse=True)[1]
    range_ = F.lit(ranges.tolist())[bin_]
    w = Window.partitionBy("_r").orderBy(F.desc("w"), "a", "b")
    dealt = edges.repartition(len(first), range_).withColumn("_r", range_)
    return dealt.withColumn("place", F.row_number().over(w) + F.lit(first)[F.col("_r")]).select("a", "b", "w", "place")


def misplaced(assigned: DataFrame, dim: int) -> DataFrame:
    """Rows of (id, vector, cluster) that are nearer to another cluster's centre than to their own: none, if a fit has converged."""
    near = nearest(assigned, centroids(assigned, dim)).select("id", F.col("cluster").alias("best"))
    return assigned.join(near, "id").where("best <> cluster").select("id", "cluster", "best")


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k heaviest of either end."""
    sides = edges.select("a", "b", "w", F.explode(F.array("a", "b")).alias("node"))
    w = Window.partitionBy("node").orderBy(F.desc("w"), "a", "b")
    return sides.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "b", "w").distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges, the heaviest of parallel ones."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w")).where("a <> b")


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "w")


def pooled(chunks: DataFrame) -> DataFrame:
    """(id, vector): unit mean of the vectors of (id, vector), per id; a zero mean stays zero. Null vectors do not count; the others have equal
    lengths and no null components. One partial mean an id and task is shuffled, so an id of very many vectors is in many tasks."""
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
    return chunks.where("vector is not null").groupBy("id").agg(vector_to_array(mean).alias("m")).select("id", normalise(F.col("m")).alias("vector"))


def centroids(vectors: DataFrame, dim: int) -> DataFrame:
    """(cluster, centre): unit mean of the unit vectors of (id, vector, cluster)."""
    unit = vectors.select("cluster", normalise(F.col("vector")).alias("v"))
    mean = unit.groupBy("cluster").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("m"))
    return mean.select("cluster", normalise(F.col("m")).alias("centre"))


def _against(vectors: DataFrame, centres: DataFrame, columns: list[str], sim):
    """vectors with `_s`: sim(unit vector, centre) of each row of centres, which are few and come as one array in one row."""
    all_ = centres.agg(F.array_sort(F.collect_list(F.struct(*centres.columns))).alias("_c"))
    unit = vectors.select(*columns, normalise(F.col("vector")).alias("_v"))
    return unit.crossJoin(F.broadcast(all_)).select(*columns, F.transform("_c", lambda c: sim(F.col("_v"), c)).alias("_s"))


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, sim): the most similar centre, ties to the lowest cluster; centres (cluster, centre) are few."""
    scored = _against(vectors, centres, ["id"], lambda v, c: F.struct(dot(v, c["centre"]).alias("sim"), (-c["cluster"]).alias("c")))
    best = F.array_max("_s")
    return scored.select("id", best.alias("b")).select("id", (-F.col("b.c")).alias("cluster"), F.col("b.sim").alias("sim"))


def silhouette(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, s): simplified silhouette; mean cosine distances are distances to the clusters' mean vectors."""
    unit = vectors.select("cluster", normalise(F.col("vector")).alias("v"))
    means = unit.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("m"))
    scored = _against(vectors, means, ["id", "cluster"], lambda v, c: F.struct(c["cluster"].alias("other"), c["n"].alias("n"), (1 - dot(v, c["m"])).alias("d")))
    own = F.filter("_s", lambda s: s["other"] == F.col("cluster"))[0]
    others = F.array_min(F.transform(F.filter("_s", lambda s: s["other"] != F.col("cluster")), lambda s: s["d"]))
    ab = scored.select("id", F.when(own["n"] == 1, 0.0).otherwise(own["d"]).alias("a"), others.alias("b"))
    top = F.greatest("a", "b")
    return ab.select("id", F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0).alias("s"))


def inertia(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """One row: the sum of squared distances of unit vectors (id, vector, cluster) to their centres (cluster, centre)."""
    near = vectors.select("cluster", normalise(F.col("vector")).alias("v")).join(F.broadcast(centres), "cluster")
    apart = F.zip_with("v", "centre", lambda x, y: (x - y) * (x - y))
    return near.agg(F.coalesce(F.sum(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0)).alias("inertia"))
