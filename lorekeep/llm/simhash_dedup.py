"""SimHash near-dedup: fingerprints of whole texts and an exact tiled comparison.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes (XXH64, seed 42) of the
text's 3-word shingles. Distinct fingerprints are laid in tiles by the population counts of their four
16-bit quarters. Two fingerprints within the radius have quarter counts that differ by no more than the
radius in sum, so only such tile pairs are compared, each whole, with numpy's exclusive-or and bit
counts. Of the links in a tile pair a spanning forest is emitted, which keeps their components.

Edge cases. A null, empty or blank text has fingerprint zero, linked like any other; a text of one or two
words has one shingle, all its words. Equal texts and repeated rows share a fingerprint and so a
component; a null doc_id is never the smallest id unless all of the component are null. Each tile is cut in
chunks of about `TILE` fingerprints, as many as its own number asks for; pairs of chunks are listed by their keys alone, and
fingerprints join existing pairs only. Very long texts are read whole; a very common text is joined in many tasks.
Other columns are carried through by `near_dedup`.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, join_spread, materialise, packed, unpacked

RADIUS = 3
SHINGLE = 3
TILE = 4096
BLOCK = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest as h64

    w = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(w) - k + 1)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + k - 1] if len(w) >= k else w
        grams = zip(*(part[i:] for i in range(k)), strict=False) if len(w) >= k else [w]
        h = np.array([h64(b" ".join(g), 42) for g in grams], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, name: str) -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts):
        return texts.map(fingerprint, na_action=None).astype("int64")

    return docs.withColumn(name, fp("text"))


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for the nodes 0 to n - 1 that the links a-b join to a lesser one: as connected as the links, but few."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for end in (least[a], least[b], a, b):
            np.minimum.at(new, end, low)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if (new == least).all():
            node = np.flatnonzero(least != np.arange(n))
            return node, least[node]
        least = new


def tile_pairs(cells: DataFrame, keys: list[str], tile: int, near) -> tuple[DataFrame, DataFrame]:
    """Chunks of cells and the pairs of tiles to compare, both without payload.

    cells (keys..., n) are cut into chunks of about `tile` of their n members: (keys..., n, chunks). near(df) gives cells
    (with keys and `same`) of which each is compared with the cell it came from, in columns `o_<key>` and `o_chunks`; a pair
    is (keys..., c, o_keys..., o_c), c being the chunk.
    """
    chunked = materialise(cells.select(*keys, "n", F.ceil(F.col("n") / tile).cast("int").alias("chunks")))
    other = chunked.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("chunks").alias("o_chunks"))
    met = near(other).join(chunked.select(*keys, "chunks"), keys)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = met.withColumn("c", upto("chunks")).withColumn("o_c", upto("o_chunks")).where("not same or o_c >= c")
    return chunked, materialise(pairs.select(*keys, "c", *(f"o_{k}" for k in keys), "o_c"))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) that connect the distinct fingerprints in column fp as links within the radius do; each
    pair of tiles gives no more pairs than it has fingerprints."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)).cast("int")
    code = sum((quarter(i) * 32**i for i in range(1, 4)), quarter(0))
    prints = materialise(prints.select("fp", code.alias("q")))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]

    def near(cells):
        """Cells whose quarter counts differ by no more than the radius in sum, each pair once."""
        counts = [F.shiftrightunsigned("o_q", 5 * i).bitwiseAND(31) for i in range(4)]
        step = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in steps))
        met = cells.withColumn("d", F.explode(step)).where(reduce(Column.__and__, [(counts[i] + F.col(f"d.d{i}")).between(0, 16) for i in range(4)]))
        moved = sum((F.col(f"d.d{i}") * 32**i for i in range(4)), F.col("o_q"))
        return met.withColumn("q", moved.cast("int")).withColumn("same", F.col("q") == F.col("o_q")).drop("d")

    chunked, pairs = tile_pairs(prints.groupBy("q").agg(F.count("*").alias("n")), ["q"], tile, near)
    laid = join_spread(prints, chunked, ["q"]).select("q", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("c"), "fp")
    tiles = materialise(laid.groupBy("q", "c").agg(F.collect_list("fp").alias("fps")))
    others = tiles.select(F.col("q").alias("o_q"), F.col("c").alias("o_c"), F.col("fps").alias("others"))
    both = pairs.join(tiles, ["q", "c"]).join(others, ["o_q", "o_c"]).select("others", "fps")

    def compare(batches):
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column("others"), batch.column("fps"), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                names = np.concatenate([x, y]).view(np.int64)
                for at in range(0, len(x), 256):
                    part = x[at : at + 256]
                    i, j = np.nonzero(np.bitwise_count(part[:, None] ^ y[None, :]) <= radius)
                    ok = part[i] != y[j]
                    if ok.any():
                        used, ends = np.unique(np.concatenate([i[ok] + at, j[ok] + len(x)]), return_inverse=True)
                        node, low = stars(*np.split(ends, 2), len(used))
                        out_a.append(names[used[node]])
                        out_b.append(names[used[low]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row (_id, _t, fp, class, component_id) for each row of docs; _t is the hash of its text, class a
    fingerprint that stands for the component."""
    rows = materialise(with_fingerprints(docs.select(F.col("doc_id").alias("_id"), "text"), "fp").select("_id", F.xxhash64("text").alias("_t"), "fp"))
    prints = materialise(rows.groupBy("fp").agg(F.min("_id").alias("low"), F.count("*").alias("n")))
    found = components(links(prints.select("fp"), radius))
    classes = materialise(prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"), "low", F.col("n").alias("rows")))
    ids = materialise(classes.groupBy("class").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
    classes = materialise(join_spread(classes, ids, ["class"]).select("fp", "class", "component_id", F.col("rows").alias("n")))
    return join_spread(rows, classes, ["fp"])


def op8(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, then the smallest text hash.

    Of repeated rows (equal doc_id and text) one stays.
    """
    place = F.struct(F.col("_id").isNull(), "_id", "_t")
    rows = near_groups(docs, radius).groupBy("class", "_id", "_t").agg(F.count("*").alias("n"))
    pick = rows.groupBy("class").agg(F.min_by(F.struct("_id", "_t", "n"), place).alias("k")).select("k.*")
    kept = packed(docs, _di=F.col("doc_id"), _h=F.xxhash64("text")).join(pick, F.col("_di").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")))
    once, more = kept.where("n = 1").select(*unpacked(docs)), kept.where("n > 1").select(*unpacked(docs))
    return once.union(more.dropDuplicates(["doc_id", "text"]))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays."""
    return near_dedup(docs)
