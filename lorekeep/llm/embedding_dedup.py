"""Embedding near-dedup: a PCA-ordered tiled comparison, exact in double precision.

Vectors are compared within a label only. Equal vectors of a label are merged first. The axes are turned
into principal components, fitted on all usable vectors, and vectors are laid in cells by their first three
components, each cell as wide as the largest distance two linked unit vectors can have; so links join
only equal or adjacent cells. Cells are cut into tiles of `TILE` vectors. In a pair of tiles, blocks of
vectors ordered by the first component accumulate products over leading components; the norms of the
suffixes bound what is left, and a block stops when no pair can reach the threshold. Pairs that may are
computed in double precision from the vectors as given. Of the links of a tile pair the counts for each vector and a
few pairs that keep their components are emitted, never all links. Each cell is cut into as many tiles as its own number asks
for; pairs of tiles are listed by their keys alone, and vectors join existing pairs only.

Edge cases. Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing and are components of their own. Vectors of different length never link.
Repeated rows are other vectors to each other and link, if usable. A null vec_id is never the
smallest unless all are null, and its row is not kept. Columns other than the three are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_spread, materialise
from .simhash_dedup import stars, tile_pairs

THRESHOLD = 0.98
TILE = 1024
BLOCK = 256
#: Leading components after which the bound is looked at.
STEPS = (8, 16, 32)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(groups: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, largest first) of the unit vectors of this length."""

    def partial(batches):
        total, s, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("v").flatten().to_numpy(zero_copy_only=False), dim)
                total, s, n = total + x.T @ x, s + x.sum(0), n + len(x)
        if n:
            for i in range(dim):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i].tolist()]), pa.array([s[i]]), pa.array([n])], ["i", "row", "s", "n"])

    parts = groups.where(F.size("v") == dim).select("v").mapInArrow(partial, "i long, row array<double>, s double, n long")
    rows = parts.groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(f"r{j}") for j in range(dim)), F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n = rows[0]["n"]
    mean = np.array([r["s"] for r in rows]) / n
    cov = np.array([[r[f"r{j}"] for j in range(dim)] for r in rows]) / n - np.outer(mean, mean)
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1].copy()


def matching(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float):
    """Pairs of places (i, j) with cosine(x[i], y[j]) >= threshold; x and y are unit vectors, rows."""
    px, py = x @ turn, y @ turn
    ox, oy = np.argsort(px[:, 0], kind="stable"), np.argsort(py[:, 0], kind="stable")
    px, py, dim = px[ox], py[oy], x.shape[1]
    reach, low = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9, threshold - 1e-9
    cuts = [c for c in STEPS if c < dim] + [dim]
    rest = lambda p: [np.sqrt(np.maximum(0.0, (p[:, c:] ** 2).sum(1))) for c in cuts]
    rx, ry = rest(px), rest(py)
    out_i, out_j = [], []
    for at in range(0, len(px), BLOCK):
        a = slice(at, at + BLOCK)
        lo = np.searchsorted(py[:, 0], px[at, 0] - reach)
        hi = np.searchsorted(py[:, 0], px[min(at + BLOCK, len(px)) - 1, 0] + reach, side="right")
        for bt in range(lo, hi, BLOCK):
            b = slice(bt, min(bt + BLOCK, hi))
            dots, start, dense = 0.0, 0, True
            for k, c in enumerate(cuts):
                dots = dots + px[a, start:c] @ py[b, start:c].T
                start = c
                can = dots + np.outer(rx[k][a], ry[k][b]) >= low
                n = np.count_nonzero(can)
                if n < can.size // 16:
                    dense = False
                    break
            if dense or n:
                i, j = np.nonzero(can)
                i, j = ox[i + at], oy[j + bt]
                for part in range(0, len(i), 1 << 16):
                    p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                    ok = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
                    out_i.append(p[ok])
                    out_j.append(q[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def near(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    usable = F.coalesce(usable & F.col("label").isNotNull(), F.lit(False))
    key = F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit(1), "embedding", "label")))
    rows = vectors.select("vec_id", "label", "embedding", F.when(usable, key).alias("g"))
    groups = materialise(
        rows.where("g is not null").groupBy("g").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("embedding").alias("v"))
    )
    dims = [r[0] for r in groups.select(F.size("v").alias("d")).distinct().collect()]
    found = [_compare(groups, dim, threshold, tile) for dim in dims]
    out = rows.select("vec_id", "g")
    if not found:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = materialise(links)
    counts = links.groupBy("a").agg(F.sum("n").alias("more"))
    classes = components(links.where("b is not null").select("a", "b"))
    g = groups.select("g", "low", "n").join(classes, groups["g"] == classes["node"], "left").join(counts, F.col("g") == F.col("a"), "left")
    g = materialise(g.select("g", F.coalesce("component", "g").alias("class"), "low", F.col("n").alias("rows"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    ids = materialise(g.groupBy("class").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
    g = materialise(join_spread(g, ids, ["class"]).select("g", "n_links", "component_id", F.col("rows").alias("n")))
    out = join_spread(out, g, ["g"], how="left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("g").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _compare(groups: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, n): vector a has n rows linked in some tile pair; where b is not null, a and b are connected."""
    own = groups.where(F.size("v") == dim)
    turn = axes(own, dim)
    width = math.sqrt(max(1e-12, 2 - 2 * threshold)) + 1e-9
    m = min(3, dim)
    lead = turn[:, :m]

    def cells(batches):
        for b in batches:
            if b.num_rows:
                c = np.floor((_unit(b.column("v").flatten().to_numpy(zero_copy_only=False), dim) @ lead) / width).astype(np.int64) + (1 << 19)
                code = c[:, 0]
                for k in range(1, m):
                    code = (code << 20) | c[:, k]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("g", "n", "label", "v")), pa.array(code)], ["g", "n", "label", "v", "cell"])

    types = dict(groups.dtypes)
    laid = materialise(own.select("g", "n", "label", "v").mapInArrow(cells, f"g string, n long, label {types['label']}, v {types['v']}, cell long"))
    keys, steps = ["label", "cell"], [0]
    for _ in range(m):
        steps = [(s << 20) + d for s in steps for d in (-1, 0, 1)]

    def near(cells_):
        """The cell itself and half of its neighbours, so that each pair comes once."""
        met = cells_.withColumn("step", F.explode(F.array(*(F.lit(s).cast("long") for s in steps if s >= 0))))
        return met.select(*cells_.columns, F.col("o_label").alias("label"), (F.col("o_cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("same"))

    chunked, pairs = tile_pairs(laid.groupBy(*keys).agg(F.count("*").alias("n")), keys, tile, near)
    dealt = join_spread(laid.withColumnRenamed("n", "rows"), chunked, keys).withColumn("c", F.pmod(F.xxhash64("g"), "chunks").cast("int"))
    tiles = dealt.groupBy(*keys, "c").agg(F.collect_list(F.struct("g", "rows", "v")).alias("x"))
    tiles = materialise(tiles.select(*keys, "c", F.col("x.g").alias("g"), F.col("x.rows").alias("n"), F.flatten("x.v").alias("v")))
    others = tiles.select(F.col("label").alias("o_label"), F.col("cell").alias("o_cell"), F.col("c").alias("o_c"), F.col("g").alias("g1"), F.col("n").alias("n1"), F.col("v").alias("v1"))
    same = ((F.col("cell") == F.col("o_cell")) & (F.col("c") == F.col("o_c"))).alias("same")
    pairs = pairs.join(tiles, [*keys, "c"]).join(others, ["o_label", "o_cell", "o_c"]).select("g1", "n1", "v1", "g", "n", "v", same)

    def compare(batches):
        for batch in batches:
            a, b, n = [], [], []
            for r in range(batch.num_rows):
                g1, n1, v1, g, n2, v = (batch.column(i)[r].values for i in range(6))
                same = batch.column(6)[r].as_py()
                x = _unit(v1.to_numpy(zero_copy_only=False), dim)
                y = x if same else _unit(v.to_numpy(zero_copy_only=False), dim)
                i, j = matching(x, y, turn, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                n1, n2 = n1.to_numpy(), n2.to_numpy()
                left_n = np.bincount(i, n2[j], len(x)).astype(np.int64)
                right_n = np.bincount(j, n1[i], len(y)).astype(np.int64)
                node, low = stars(i, j if same else j + len(x), len(x) if same else len(x) + len(y))
                both = g1 if same else pa.concat_arrays([g1, g])
                for names, total in ((g1, left_n), (g, right_n)):
                    at = np.flatnonzero(total)
                    a += names.take(pa.array(at)).to_pylist()
                    b += [None] * len(at)
                    n += total[at].tolist()
                a += both.take(pa.array(node)).to_pylist()
                b += both.take(pa.array(low)).to_pylist()
                n += [0] * len(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return pairs.mapInArrow(compare, "a string, b string, n long")


def op5(embeddings: DataFrame) -> DataFrame:
    return near(embeddings.select("vec_id", "embedding", "label"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
