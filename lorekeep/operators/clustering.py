"""Spherical k-means, its sweep over k, cluster labels, and layouts of the similarity graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.vectors import dot, norm, normalise
from .common import written
from .graph import centroids, nearest
from .lexical import top_terms

#: Colours of clusters, by cluster modulo their number.
PALETTE = (
    "#7957d9", "#57b4d9", "#d9a857", "#57d98b", "#d957a8", "#d97957", "#57d9d9", "#a857d9", "#d9d957", "#5779d9", "#d95757", "#57d957", "#d957d9",
    "#8b8bd9", "#d98b57", "#57d9a8", "#d95779", "#79d957", "#5757d9", "#d9a8a8",
)


def dimension(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vector").alias("n")).first()
    return first.n if first else 0


def kmeans(vectors: DataFrame, k: int, seeds=range(42, 52), rounds: int = 300) -> DataFrame:
    """(id, vector, cluster) of (id, vector) by cosine k-means; the seed of the least cost wins, the first of equal ones.

    Zero vectors, which have no direction, take part in no fit and join cluster 0. Clusters are numbered from 0 as found;
    fewer than k come out if there are fewer directions. Seeds are compared after `rounds` rounds at most; the one that wins goes on until no vector
    is nearer to another centre than to its own.
    """
    if k < 2:
        return vectors.select("id", "vector", F.lit(0).cast("int").alias("cluster"))
    blocks, rows = _unit_blocks(vectors), _sample(vectors)
    best = _best(lloyd(blocks, rows, [(k, seed) for seed in seeds], rounds))
    if best:
        _settle(blocks, rows, best[k])
    return _assigned(vectors, best[k].centres) if best else vectors.select("id", "vector", F.lit(0).cast("int").alias("cluster"))


def sweep(vectors: DataFrame, low: int = 5, high: int = 20, seeds=range(42, 52), rounds: int = 300) -> tuple[int, DataFrame]:
    """(k, (id, vector, cluster)) of the k with the highest mean simplified silhouette, the first of equal ones.

    k runs from low to high, but no higher than a third of the rows; fewer than four rows are one cluster. All k and seeds are fitted at
    once, so the sweep takes the passes of its longest fit and one more.
    """
    vectors = written(vectors.select("id", "vector"))
    n = vectors.count()
    one = vectors.withColumn("cluster", F.lit(0).cast("int"))
    if n < 4:
        return 1, one
    high = min(high, max(2, n // 3))
    blocks = _unit_blocks(vectors)
    best = _best(lloyd(blocks, _sample(vectors), [(k, seed) for k in range(max(2, min(low, high)), high + 1) for seed in seeds], rounds))
    if not best:
        return max(2, min(low, high)), one
    zeros = n - blocks.agg(F.sum("n")).first()[0]
    scores = _silhouettes(blocks, [best[k] for k in sorted(best)], zeros)
    k = max(sorted(best), key=lambda k: scores[sorted(best).index(k)])
    return k, _assigned(vectors, best[k].centres)


#: Unit vectors of a block, rows that starts are drawn from, partitions whose sums the driver adds up itself.
ROWS, STARTS, FEW_PARTS = 2048, 4096, 16


def _directed(vectors: DataFrame) -> DataFrame:
    """(v): unit vectors of rows that have a direction."""
    return vectors.where("vector is not null").select(norm(F.col("vector")).alias("n"), normalise(F.col("vector")).alias("v")).where("n > 0").select("v")


def _sample(vectors: DataFrame) -> np.ndarray:
    """At most STARTS unit vectors, the same ones however the rows lie."""
    found = _directed(vectors).orderBy(F.xxhash64("v")).limit(STARTS).toArrow().column("v").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1 if len(found) else 0)


def _unit_blocks(vectors: DataFrame) -> DataFrame:
    """(n, x): the unit vectors of rows that have a direction, as matrices of up to ROWS rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for at in range(0, len(flat), ROWS):
                    part = flat[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["n", "x"])

    return written(_directed(vectors).mapInArrow(run, "n long, x binary"))


def _matrices(batches):
    for b in batches:
        for n, x in zip(b.column("n").to_pylist(), b.column("x"), strict=True):
            yield np.frombuffer(x.as_py()).reshape(n, -1)


class Fit:
    """A run of k-means: its centres (rows), and, of the last pass, sizes, sums of members and cost; with the centres before, the vectors that are not
    where those put them."""

    def __init__(self, k: int, seed: int, centres: np.ndarray):
        self.k, self.seed, self.centres, self.done = k, seed, centres, False
        self.sizes = self.sums = self.before = None
        self.cost, self.moved = math.inf, 0

    def means(self, rows: np.ndarray, step: int) -> np.ndarray:
        """The unit means of the members; an empty cluster begins anew at one of rows."""
        r = np.random.default_rng([self.seed, step])
        length = np.sqrt((self.sums**2).sum(1, keepdims=True))
        moved = np.where(length > 0, self.sums / np.where(length > 0, length, 1), self.centres)
        empty = self.sizes == 0
        moved[empty] = rows[r.integers(len(rows), size=int(empty.sum()))]
        return moved


def _starts(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows, each drawn by its squared distance to those before it; fewer if there are fewer different ones."""
    r = np.random.default_rng(seed)
    chosen = [int(r.integers(len(rows)))]
    near = 2 - 2 * rows @ rows[chosen[0]]
    while len(chosen) < k:
        weight = np.where(near > 1e-12, near, 0.0)
        if not weight.any():
            break
        chosen.append(int(r.choice(len(rows), p=weight / weight.sum())))
        near = np.minimum(near, 2 - 2 * rows @ rows[chosen[-1]])
    return rows[chosen].copy()


def _pass(blocks: DataFrame, fits: list[Fit]) -> None:
    """Brings sizes, sums and costs of all fits up to date in one pass; partial sums are added up per fit before they come to the driver."""
    centres = np.concatenate([f.centres for f in fits])
    ends = np.cumsum([len(f.centres) for f in fits])
    starts = ends - [len(f.centres) for f in fits]
    before = [f.before for f in fits]

    def run(batches):
        moved = np.zeros(len(starts), np.int64)
        total, seen = np.zeros((len(centres), centres.shape[1] + 1)), False
        cost = np.zeros(len(starts))
        for x in _matrices(batches):
            seen = True
            near, whole = x @ centres.T, np.c_[x, np.ones(len(x))]
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                own = near[:, a:b].argmax(1)
                member = np.zeros((b - a, len(x)))
                member[own, np.arange(len(x))] = 1
                total[a:b] += member @ whole
                cost[i] += (2 - 2 * near[np.arange(len(x)), a + own]).sum()
                if before[i] is not None:
                    moved[i] += np.count_nonzero((x @ before[i].T).argmax(1) != own)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array(cost), pa.array(moved), pa.array([total[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["fit", "cost", "moved", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return pa.table({"fit": table.column("fit").slice(0, 1), "cost": pa.array([sum(table.column("cost").to_pylist())]), "moved": pa.array([sum(table.column("moved").to_pylist())]), "sums": pa.array([sums.tobytes()], pa.binary())})

    kind = "fit int, cost double, moved long, sums binary"
    parts = blocks.mapInArrow(run, kind)
    if blocks.rdd.getNumPartitions() > FEW_PARTS:
        parts = parts.groupBy("fit").applyInArrow(add, kind)
    found = parts.toArrow()
    for i, f in enumerate(fits):
        own = found.filter(pc.equal(found.column("fit"), i))
        sums = sum(np.frombuffer(s.as_py()) for s in own.column("sums")).reshape(len(f.centres), -1)
        f.sums, f.sizes, f.cost, f.moved = sums[:, :-1], sums[:, -1], sum(own.column("cost").to_pylist()), sum(own.column("moved").to_pylist())


def lloyd(blocks: DataFrame, rows: np.ndarray, runs: list[tuple[int, int]], rounds: int = 300, tol: float = 1e-6) -> list[Fit]:
    """Fits of (k, seed), all of whose rounds share passes over blocks: a pass assigns every vector in every fit that still moves.

    Starts are drawn from rows, a sample; the fits take all. An empty cluster begins anew at one of those. The driver holds
    the centres only: their number and dimension do not grow with the vectors.
    """
    if not len(rows):
        return []
    fits = [Fit(k, seed, _starts(rows, k, seed)) for k, seed in runs]
    for step in range(rounds):
        active = [f for f in fits if not f.done]
        if not active:
            break
        _pass(blocks, active)
        for f in active:
            moved = f.means(rows, step)
            f.done = np.abs(moved - f.centres).max() <= tol
            f.centres = moved
    last = [f for f in fits if not f.done] or []
    if last:  # stopped by the number of rounds: costs of the last centres
        _pass(blocks, last)
    return fits


def _settle(blocks: DataFrame, rows: np.ndarray, fit: Fit) -> None:
    """Moves the fit's centres on until a pass leaves every vector where the centres before had it. A fit's cost falls with each move, so this ends;
    if it were to come to the same members again, by rounding, it ends there."""
    seen: set[bytes] = set()
    while True:
        _pass(blocks, [fit])
        state = fit.sizes.tobytes() + np.round(fit.sums, 9).tobytes()
        if fit.before is not None and not fit.moved or state in seen and fit.sizes.all():
            return
        seen.add(state)
        fit.before, fit.centres = fit.centres, fit.means(rows, len(seen))


def _best(fits: list[Fit]) -> dict[int, Fit]:
    """The fit of the least cost for each k, the first of equal ones."""
    best: dict[int, Fit] = {}
    for f in fits:
        if f.k not in best or f.cost < best[f.k].cost:
            best[f.k] = f
    return best


def _silhouettes(blocks: DataFrame, fits: list[Fit], zeros: int) -> list[float]:
    """Mean simplified silhouettes of several fits in two passes: mean cosine distances are distances to the clusters' mean vectors. Zero vectors, in
    cluster 0, are at distance 1 from every mean."""
    _pass(blocks, fits)
    held = []
    for f in fits:
        sizes = f.sizes.copy()
        sizes[0] += zeros
        some = np.flatnonzero(sizes > 0)
        held.append((f.centres, some, f.sums[some] / sizes[some][:, None], sizes[some]))

    def run(batches):
        total = np.zeros(len(held))
        for x in _matrices(batches):
            for i, (centres, some, means, sizes) in enumerate(held):
                if len(some) < 2:
                    continue
                own = np.searchsorted(some, (x @ centres.T).argmax(1))
                far, at = 1 - x @ means.T, np.arange(len(x))
                a = np.where(sizes[own] == 1, 0.0, far[at, own])
                far[at, own] = np.inf
                b = far.min(1)
                top = np.maximum(a, b)
                total[i] += np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(total)], ["fit", "s"])

    sums = {r.fit: r.s for r in blocks.mapInArrow(run, "fit int, s double").groupBy("fit").agg(F.sum("s").alias("s")).collect()}
    n = fits[0].sizes.sum() + zeros
    return [-1.0 if len(h[1]) < 2 else sums.get(i, 0.0) / n for i, h in enumerate(held)]


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vector, cluster): the nearest centre, ties to the lowest, 0 for vectors without a direction."""

    @F.pandas_udf("int")
    def own(v: pd.Series) -> pd.Series:
        some = [i for i, x in enumerate(v) if x is not None]
        out = np.zeros(len(v), np.int32)
        if some:
            x = np.asarray(np.stack([v.iloc[i] for i in some]), np.float64)
            length = np.sqrt((x * x).sum(1))
            out[some] = np.where(length > 0, (x @ centres.T).argmax(1), 0)
        return pd.Series(out)

    return vectors.select("id", "vector", own("vector").alias("cluster"))


def labels(members: DataFrame, docs: DataFrame, dim: int, near: int = 5, terms: int = 3) -> DataFrame:
    """(cluster, label, color, n): the top terms of the names and first messages of the members nearest to each centre.

    members are (id, vector, cluster), docs (id, name, first_message); clusters without terms are "Cluster <i>".
    """
    own = nearest_members(members, dim, near)
    words = own.join(docs, "id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "name", snippet(F.col("first_message"))).alias("t")))).alias("ts"))
    found = top_terms(words.select(F.col("cluster").alias("doc_id"), F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("text")), terms)
    named = found.groupBy(F.col("doc_id").alias("cluster")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ").alias("label"))
    colours = F.array(*map(F.lit, PALETTE))
    return members.groupBy("cluster").agg(F.count("*").alias("n")).join(F.broadcast(named), "cluster", "left").select("cluster", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster"))).alias("label"), F.get(colours, F.col("cluster") % len(PALETTE)).alias("color"), "n")


def nearest_members(members: DataFrame, dim: int, near: int = 5) -> DataFrame:
    """(cluster, rank, id): the members most similar to their cluster's centre, ties to the highest id."""
    sims = members.join(F.broadcast(centroids(members, dim)), "cluster").select("cluster", "id", dot(normalise(F.col("vector")), F.col("centre")).alias("sim"))
    w = Window.partitionBy("cluster").orderBy(F.desc("sim"), F.desc("id"))
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= near).select("cluster", "rank", "id")


def assign(vectors: DataFrame, members: DataFrame, dim: int) -> DataFrame:
    """(id, cluster, sim) of new vectors by the centres of members, without a new fit."""
    return nearest(vectors, centroids(members, dim))


def components(vectors: DataFrame, n: int = 3) -> DataFrame:
    """(id, p): the first n principal components of (id, vector), centred.

    A component's sign makes its largest loading positive; missing components are zeros, as all are of fewer than two rows. The fit gathers a matrix of
    dimension by dimension, whatever the number of rows.
    """
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    dim = dimension(vectors)
    if dim == 0 or len(vectors.take(2)) < 2:
        return vectors.select("id", F.array(*[F.lit(0.0)] * n).alias("p"))
    model = PCA(k=min(n, dim), inputCol="features", outputCol="pc").fit(rows)
    loading = model.pc.toArray()
    signs = [1.0 if loading[abs(loading[:, j]).argmax(), j] > 0 else -1.0 for j in range(loading.shape[1])]
    raw = model.transform(rows).select("id", vector_to_array("pc").alias("p"))
    mean = raw.agg(*(F.avg(F.col("p")[j]).alias(f"m{j}") for j in range(len(signs))))
    return raw.crossJoin(F.broadcast(mean)).select("id", F.array(*((F.col("p")[j] - F.col(f"m{j}")) * s for j, s in enumerate(signs)), *[F.lit(0.0)] * (n - len(signs))).alias("p"))


def scaled(points: DataFrame, size: float = 100.0) -> DataFrame:
    """(id, p) with the largest absolute value at `size`; points that are all alike become zeros."""
    top = points.agg(F.max(F.array_max(F.transform("p", F.abs))).alias("top"))
    return points.crossJoin(F.broadcast(top)).select("id", F.transform("p", lambda x: F.when(F.col("top") > 1e-8, x * size / F.col("top")).otherwise(0.0)).alias("p"))


def time_axis(items: DataFrame, size: float = 200.0) -> DataFrame:
    """(id, tx): the date of (id, created_at) between -size/2 and size/2; dates that do not parse count as 1970."""
    at = F.coalesce(F.try_to_timestamp("created_at").cast("double"), F.lit(0.0))
    timed = items.select("id", at.alias("t"))
    ends = timed.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    part = F.when(F.col("high") > F.col("low"), (F.col("t") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return timed.crossJoin(F.broadcast(ends)).select("id", (part * size - size / 2).alias("tx"))


def layout(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """(id, x, y, z, tx, ty, tz): principal components, and time beside the first two of them."""
    found = components(vectors)
    p, q = scaled(found), scaled(found.select("id", F.slice("p", 1, 2).alias("p")), 80.0)
    flat = p.select("id", *(F.col("p")[k].alias(c) for k, c in enumerate("xyz"))).join(q.select("id", F.col("p")[0].alias("ty"), F.col("p")[1].alias("tz")), "id")
    return flat.join(time_axis(items), "id").select("id", "x", "y", "z", "tx", "ty", "tz")


def ring(clusters: DataFrame) -> DataFrame:
    """(cluster, x, y, z) of (cluster): centres spread over a sphere around the n nodes of clusters (cluster, n)."""
    total = clusters.agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    phi, theta = 2 * F.pi() * F.col("cluster") / F.col("k"), F.pi() / 2 + (F.col("cluster") % 3 - 1) * 0.4
    r = F.greatest(F.lit(120.0), 5 * F.sqrt("total"))
    return clusters.crossJoin(F.broadcast(total)).select("cluster", (r * F.sin(theta) * F.cos(phi)).alias("x"), (r * F.cos(theta)).alias("y"), (r * F.sin(theta) * F.sin(phi)).alias("z"))
