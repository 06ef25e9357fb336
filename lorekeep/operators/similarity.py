"""A similarity graph that grows: cosines of all pairs as a mergeable histogram, and the heaviest edges with at most `cap` at a node.

The graph keeps pairs over the percentile of all cosines, and of those the ones a scan by weight descending accepts while both ends have room. A
build multiplies tiles of vectors once for the histogram, once for the cosines in the bin of the percentile, which make it exact, and once more for
each band of descending weight; a band takes only vectors with room left, and leaves out pairs of tiles whose centres and radii bound them under it.
New vectors multiply new x all for the histogram, which is additive: removed pairs are subtracted and new ones added; all x all for the bin of the
percentile; and the scan goes down the same bands, of old edges and the pairs of nodes that changed, and takes up a band again until no other node
loses an edge in it. Repaired and rebuilt graphs are equal.

Cosines have twelve decimals. Vectors are of equal length; null vectors take no part, a zero vector has the cosine 0 to all. Tiles meet where they lie
(cosines.py), so no pairs of tiles are written, and of the edges only those of the band at hand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalise
from . import cosines
from .common import written

#: Vectors of a tile, bins of cosines, directions that order vectors, vectors for one of them at least, and rows they are taken from.
TILE, BINS, DIRECTIONS, PER_WAY, SAMPLE = 8192, 1 << 20, 64, 512, 2048
#: Edges of the first band as a multiple of all room there is; each band has so many times the edges of the one before.
FIRST, NEXT = 4, 4
#: Edges that one task scans.
SCAN = 1 << 20
COUNTS = "bin int, n long"


def tiles(vectors: DataFrame, least: int = 6) -> DataFrame:
    """(tile, ids, x, centre, radius) of (id, vector): vectors of like direction in one tile, as a matrix of unit vectors; radius is the largest angle to the centre."""
    unit = written(vectors.where("vector is not null").select("id", normalise(F.col("vector")).alias("v")))
    n = unit.count()
    sample = unit.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    rows = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1 if len(sample) else 0)
    chosen, near = [], np.zeros(len(rows)) + 2.0
    while len(chosen) < min(DIRECTIONS, max(1, n // PER_WAY)) and len(rows) and near.max() > 1e-9:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - rows @ rows[chosen[-1]])
    ways = rows[chosen]

    def cells(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = x @ ways.T
                own = s.argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(s[np.arange(len(s)), own])], ["id", "v", "cell", "near"])

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(held) if held else None
        for number, cell in enumerate(sorted(set(whole.column("cell").to_pylist())) if held else []):
            table = whole.filter(pc.equal(whole.column("cell"), cell))
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            centre = x.mean(0)
            length = np.sqrt(centre @ centre)
            centre = centre / length if length > 0 else centre
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) if length > 0 else math.pi
            ids = table.column("id").combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            tile = TaskContext.get().partitionId() * (DIRECTIONS + 1) + number
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), lists, pa.array([x.tobytes()], pa.binary()), pa.array([centre.tolist()]), pa.array([radius])], ["tile", "ids", "x", "centre", "radius"])

    kind = unit.schema["id"].dataType.simpleString()
    ordered = unit.mapInArrow(cells, f"id {kind}, v array<double>, cell int, near double")
    parts = max(1, min(least, n), math.ceil(n / TILE))
    ranged = ordered.repartitionByRange(parts, "cell", "near", F.xxhash64("id")).select("id", "v", "cell")
    return written(ranged.mapInArrow(run, f"tile int, ids array<{kind}>, x binary, centre array<double>, radius double"))


def _listed(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """(i, j, same, bound): pairs of tiles of left with those of right, or of left with itself each once; bound is the highest cosine a pair can have."""
    head = lambda t, k: t.select(F.col("tile").alias(k), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}"))
    numbers = F.array_sort(F.collect_list("tile"))
    all_ = (left if right is None else right).agg(numbers.alias("js"))
    pairs = left.select(F.col("tile").alias("i")).crossJoin(F.broadcast(all_)).select("i", F.explode("js").alias("j"))
    if right is None:
        pairs = pairs.where("i <= j")
    whole = pairs.join(head(left, "i"), "i").join(head(left if right is None else right, "j"), "j")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("ci"), F.col("cj")))))
    bound = F.cos(F.greatest(F.lit(0.0), apart - F.col("ri") - F.col("rj") - 1e-9)) + 1e-9
    return whole.select("i", "j", ((F.col("i") == F.col("j")) & F.lit(right is None)).alias("same"), F.greatest(bound, F.lit(1e-12)).alias("bound"))


def _multiplied(left: DataFrame, right: DataFrame | None, pairs: DataFrame, use, kind: str) -> DataFrame:
    """use((ids, ids, x, y, same), ...) in each task, of pairs of tiles (i, j), which yields record batches of `kind`."""

    def run(batches):
        def rows():
            for t in batches:
                for r in range(t.num_rows):
                    a, b = t.column("a")[r].values, t.column("b")[r].values
                    x, y = (np.frombuffer(t.column(k)[r].as_py()).reshape(len(ids), -1) for k, ids in (("x", a), ("y", b)))
                    yield a, b, x, y, t.column("same")[r].as_py()

        yield from use(rows())

    wanted = pairs.groupBy(F.col("i").alias("tile")).agg(F.collect_list("j").alias("js"))
    mine = left.join(F.broadcast(wanted), "tile").select(F.col("tile").alias("i"), F.col("ids").alias("a"), "x", "js")
    yours = (left if right is None else right).select(F.col("tile").alias("j"), F.col("ids").alias("b"), F.col("x").alias("y"))
    rows = cosines.met(mine, yours, F.array_contains("js", F.col("j")))
    return rows.select("a", "b", "x", "y", ((F.col("i") == F.col("j")) & F.lit(right is None)).alias("same")).mapInArrow(run, kind)


def _bin(w: np.ndarray) -> np.ndarray:
    return np.clip(((w + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def histogram(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """COUNTS of the cosines of all pairs of tiles of left with those of right, or of left with itself."""

    def use(rows):
        counts = np.zeros(BINS, np.int64)
        for _, _, x, y, same in rows:
            for _, w in cosines.strips(x, y, same):
                counts += np.bincount(_bin(w[w == w] if same else w.ravel()), minlength=BINS)
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[k])], ["bin", "n"])

    return _multiplied(left, right, _listed(left, right), use, COUNTS).groupBy("bin").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """All bins of a histogram, on the driver: their number does not grow with the vectors."""

    n: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Counts:
        found = counts.toArrow()
        n = np.zeros(BINS, np.int64)
        np.add.at(n, found.column("bin").to_numpy(), found.column("n").to_numpy())
        return cls(n)

    def percentile(self, p: float, whole: DataFrame) -> float:
        """The interpolated percentile of the cosines of all pairs of tiles, whose counts these are; infinity if there are no pairs."""
        pairs = written(_listed(whole, None))

        def run(use, kind):
            return _multiplied(whole, None, pairs, lambda rows: use((x, y, same) for _, _, x, y, same in rows), kind)

        cut = cosines.percentile(run, p, -1.0, 1.0, (0, self.n, 0))
        return math.inf if cut is None else cut

    def bands(self, first: int, cut: float) -> list[float]:
        """Descending lower ends of bands of about first, NEXT * first, ... pairs, the last the cut."""
        above, total, size, out = np.cumsum(self.n[::-1]), int(self.n.sum()), first, []
        want = first
        while want < total:
            low = (BINS - int(np.searchsorted(above, want)) - 1) * 2 / BINS - 1
            if low <= cut:
                break
            if not out or low < out[-1]:
                out.append(low)
            size *= NEXT
            want += size
        return [*out, cut]

    def frame(self, spark) -> DataFrame:
        k = np.flatnonzero(self.n)
        return spark.createDataFrame(pa.table({"bin": pa.array(k.astype(np.int32)), "n": pa.array(self.n[k])}))


def between(left: DataFrame, right: DataFrame | None, low: float, high: float) -> tuple[DataFrame, int, int]:
    """((a, b, w) with low < w <= high, pairs of tiles, pairs that were left out by their bounds)."""
    kind = left.schema["ids"].dataType.elementType.simpleString()

    def use(rows):
        for a, b, x, y, same in rows:
            both = pa.concat_arrays([a, b])
            place = np.empty(len(both), np.int64)
            place[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
            for i, j, w in cosines.between(x, y, same, low, high):
                j = j + len(a)
                first = place[i] < place[j]
                yield pa.RecordBatch.from_arrays([both.take(pa.array(np.where(first, i, j))), both.take(pa.array(np.where(first, j, i))), pa.array(w)], ["a", "b", "w"])

    pairs = written(_listed(left, right))
    some = pairs.where(F.col("bound") > low)
    total, kept = pairs.count(), some.count()
    return _multiplied(left, right, some, use, f"a {kind}, b {kind}, w double"), total, total - kept


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("used"))


def accepted(edges: DataFrame, cap: int, used: DataFrame | None = None, few: int = SCAN) -> DataFrame:
    """Edges (a, b, w) that a scan by w descending (then a, b) accepts while both ends have fewer than cap; used (id, used) have some already.

    Up to `few` edges, which are counted, are scanned by one task. More take rounds: a round accepts each edge that is among the first of the room
    left at both ends. Of a node only the first cap edges are ranked, and before they are shuffled those of each task, so a node of very many edges is
    in many tasks; accepted edges are written once and not again.
    """
    place = Window.partitionBy("id").orderBy(F.desc("w"), "a", "b")
    open_, parts = written(edges.select("a", "b", "w")), []
    taken = used
    while (n := open_.count()) > few:
        sides = open_.select("a", "b", "w", F.explode(F.array("a", "b")).alias("id")).withColumn("r", F.row_number().over(place)).where(F.col("r") <= cap)
        if taken is not None:
            sides = sides.join(taken, "id", "left").where(F.col("r") + F.coalesce("used", F.lit(0)) <= cap)
        new = written(sides.groupBy("a", "b", "w").agg(F.count("*").alias("n")).where("n = 2").select("a", "b", "w"))
        parts.append(new)
        more = _degrees(new)
        taken = written(more if taken is None else taken.unionByName(more).groupBy("id").agg(F.sum("used").cast("int").alias("used")))
        full = taken.where(F.col("used") >= cap).select("id")
        rest = open_.join(new.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(full.withColumnRenamed("id", end), end, "left_anti")
        open_ = written(rest.select("a", "b", "w"))
    if n:
        parts.append(_scanned(open_, cap, taken))
    out = edges.select("a", "b", "w").limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def _scanned(edges: DataFrame, cap: int, used: DataFrame | None) -> DataFrame:
    """`accepted` of few edges, in one task."""
    rows = edges.withColumns({"ra": F.lit(cap), "rb": F.lit(cap)})
    for end in ("a", "b") if used is not None else ():
        rows = rows.join(used.select(F.col("id").alias(end), (cap - F.col("used")).alias("_r")), end, "left").withColumn(f"r{end}", F.coalesce("_r", F.lit(cap))).drop("_r")

    def scan(batches):
        room: dict = {}
        for t in batches:
            keep = []
            for a, b, x, y in zip(*(t.column(c).to_pylist() for c in ("a", "b", "ra", "rb")), strict=True):
                x, y = room.setdefault(a, x), room.setdefault(b, y)
                keep.append(x > 0 and y > 0)
                if keep[-1]:
                    room[a], room[b] = x - 1, y - 1
            yield t.select(["a", "b", "w"]).filter(pa.array(keep, pa.bool_()))

    kind = ", ".join(f"{c} {t}" for c, t in edges.select("a", "b", "w").dtypes)
    return written(rows.select("a", "b", "w", "ra", "rb").repartition(1).sortWithinPartitions(F.desc("w"), "a", "b").mapInArrow(scan, kind))


@dataclass
class Graph:
    """Edges (a, b, w), the counts of all cosines, the cut of the percentile, and what was multiplied: pairs of tiles, those left out, and nodes repaired."""

    edges: DataFrame
    counts: DataFrame
    cut: float
    work: dict


def build(vectors: DataFrame, p: float = 0.95, cap: int = 15) -> Graph:
    """The graph of (id, vector)."""
    spark = vectors.sparkSession
    whole = tiles(vectors)
    counts = Counts.of(histogram(whole))
    cut, n = counts.percentile(p, whole), whole.select(F.sum(F.size("ids"))).first()[0] or 0
    edges, used, high, work = None, None, math.inf, {"tile_pairs": 0, "skipped": 0, "bands": 0}
    if n > 1:
        for low in counts.bands(FIRST * n * cap // 2, cut):
            some = whole if used is None else tiles(vectors.join(used.where(F.col("used") >= cap), "id", "left_anti"))
            found, pairs, skipped = between(some, None, low, high)
            new = written(accepted(found, cap, used))
            edges = new if edges is None else written(edges.unionByName(new))
            used, high = written(_degrees(edges)), low
            work = {"tile_pairs": work["tile_pairs"] + pairs, "skipped": work["skipped"] + skipped, "bands": work["bands"] + 1}
            if n - used.where(F.col("used") >= cap).count() < 2:  # no two nodes have room
                break
    if edges is None:
        kind = vectors.schema["id"].dataType.simpleString()
        edges = spark.createDataFrame([], f"a {kind}, b {kind}, w double")
    return Graph(edges, counts.frame(spark), cut, work)


def extend(graph: Graph, before: DataFrame, after: DataFrame, stale: DataFrame, p: float = 0.95, cap: int = 15) -> Graph:
    """The graph of `after` (id, vector), from that of `before`; stale (id) are the ids whose rows differ, are new or are gone.

    A band takes the old edges in it and its pairs with an end in dirty: the stale nodes and all that had an edge with one. Another node keeps its
    edges or, if a scan takes one of them, is dirty from there on. What it refused for want of room it refuses again as long as it keeps them.
    """
    spark = before.sparkSession
    stale = written(stale.select("id").distinct())
    rest = tiles(after.join(stale, "id", "left_anti"))

    def counted(rows: DataFrame) -> np.ndarray:
        own = tiles(rows)
        return Counts.of(histogram(own)).n + Counts.of(histogram(own, rest)).n

    counts = Counts(Counts.of(graph.counts).n - counted(before.join(stale, "id", "left_semi")) + counted(after.join(stale, "id", "left_semi")))
    whole = tiles(after)
    cut, n = counts.percentile(p, whole), whole.select(F.sum(F.size("ids"))).first()[0] or 0
    ends = lambda edges: edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    without = lambda edges, ids: edges.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "w")
    old = written(without(graph.edges, stale))
    dirty = stale.unionByName(ends(graph.edges.join(old.select("a", "b"), ["a", "b"], "left_anti")))
    if cut < graph.cut:  # nodes with room may take pairs between the cuts
        full = _degrees(graph.edges).where(F.col("used") >= cap).select("id")
        dirty = dirty.unionByName(after.where("vector is not null").select("id").join(full, "id", "left_anti"))
    dirty, edges, used, high, rounds = written(dirty.distinct()), None, None, math.inf, 0
    for low in counts.bands(FIRST * n * cap // 2, cut) if n > 1 else []:
        open_ = after if used is None else after.join(used.where(F.col("used") >= cap), "id", "left_anti")
        kept = old.where((F.col("w") > low) & (F.col("w") <= high))
        while True:
            rounds += 1
            own, others = tiles(open_.join(dirty, "id", "left_semi")), tiles(open_.join(dirty, "id", "left_anti"))
            found = without(kept, dirty).unionByName(between(own, None, low, high)[0]).unionByName(between(own, others, low, high)[0])
            new = written(accepted(found, cap, used))
            fresh = written(ends(kept.join(new, ["a", "b"], "left_anti")).join(dirty, "id", "left_anti"))
            if fresh.isEmpty():
                break
            dirty = written(dirty.unionByName(fresh))
        edges = new if edges is None else written(edges.unionByName(new))
        used, high = written(_degrees(edges)), low
        if n - used.where(F.col("used") >= cap).count() < 2:  # no two nodes have room
            break
    return Graph(edges if edges is not None else old.limit(0), counts.frame(spark), cut, {"stale": stale.count(), "repaired": dirty.count(), "rounds": rounds})
