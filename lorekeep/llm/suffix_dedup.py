"""Suffix-array dedup: bytes covered by a string of `LENGTH` bytes that starts anywhere else are removed.

Column-wise multi-document construction of the collection's sorted suffixes and common prefixes, a symbol
of each document a round, is done not on whole texts but on the pieces that can hold a repeat, so that the
rounds are bounded and Spark can deal the pieces out:

1. Equal texts are merged (a text of `LENGTH` bytes or more found twice is removed whole); the distinct ones
   are written once, bucketed by their digest.
2. Each window of `LENGTH` bytes selects the smallest hash of the `GRAM`-byte strings in it. Windows with
   equal bytes select alike, so a repeat shares a selected string, and only pieces about selected strings
   found twice can hold one. Such a piece is all windows that selected the string.
3. Equal pieces are counted by 128-bit digests, and found twice they are repeats as they stand. Of each different
   piece one is kept; if a string has two different pieces or more, their bytes are gathered, aligned at the string. The
   windows of two pieces that are equal start in the same column, so suffixes need comparing within a column only.
4. From the last column to the first each round puts one symbol before the suffixes of each piece and
   updates their order (the column of the Burrows-Wheeler transform) and the common prefixes of
   neighbours, whole batches of groups at a time. Neighbours with `LENGTH` bytes in common are repeats.
5. A string of more than `CAP` different pieces is not gathered. Its pieces are cut in halves, by how far before the
   string a window starts, and a half is keyed by the bytes that all its windows have in common; steps 3 and 4 are taken with
   these smaller groups, and so on with quarters, down to single windows, whose groups are all equal. So a group never
   has more than `CAP` pieces, however common a string is, and each of them goes through the same construction.

The transform is held in arrays of a batch of bounded size, not in external files: executors share none.

Edge cases. A null text is empty. Texts under `LENGTH` bytes lose nothing. Repeated rows are copies of each
other and lose all, if long enough. Overlapping repeats within a text count. An empty table gives an empty result. Very
long texts are hashed in blocks. Strings, pieces and texts of very many places are joined in many tasks.
Columns other than doc_id and text are carried through by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialise, packed, shared_dir, unpacked

LENGTH, GRAM = 200, 32
#: Most different pieces of a group; windows of a block; pieces of a batch.
CAP, BLOCK, BATCH = 20000, 1 << 20, 20000
#: Windows of a piece, of its halves, quarters and so on.
WIDTHS = (LENGTH - GRAM + 1, 85, 43, 22, 11, 6, 3, 2, 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOW = 22  # bits of a place within a block, under the leading bits of its hash


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POW = _powers(BLOCK + 2 * LENGTH)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-byte windows of at most BLOCK + 2 * LENGTH bytes."""
    up, down = _POW
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[: len(b)], out=total[1:])
    n = len(b) - k + 1
    return _mix((total[k:] - total[:n]) * up[:n])


def selected(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(hash, place of the selected string, first window, number of windows) of each run of windows
    of the text that select the same string."""
    w = length - gram + 1
    out = [np.zeros((0, 4), np.int64)]
    for at in range(0, len(text) - length + 1, BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK + length - 1, len(text) - at), at)
        h = window_hashes(b, gram)
        key = ((h >> np.uint64(LOW)) << np.uint64(LOW)) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - w + 1
        size = math.ceil(len(key) / w) * w
        full = np.full(size, np.uint64(2**64 - 1))
        full[: len(key)] = key
        rows = full.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        place = (least & np.uint64((1 << LOW) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(first, append=n)
        out.append(np.stack([h[place[first]].view(np.int64), place[first] + at, first + at, count], axis=1))
    return np.concatenate(out)


def _places(batches):
    """(tk, h, loc) of the selected strings of texts; loc: first window, its distance to the string, windows."""
    for b in batches:
        tks, hs, locs = [], [], []
        for tk, t in zip(b.column("tk"), b.column("text"), strict=True):
            raw = t.as_py().encode()
            if len(raw) >= LENGTH:
                s = selected(raw)
                tks += [tk.as_py()] * len(s)
                hs.append(s[:, 0])
                locs.append((s[:, 2] << 16) | ((s[:, 1] - s[:, 2]) << 8) | s[:, 3])
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(tks, pa.binary()), pa.array(np.concatenate(hs)), pa.array(np.concatenate(locs))], ["tk", "h", "loc"])


CUT = "tk binary, h long, loc long, d binary, span_end long"


def _rows(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _cut(batches, width: int):
    """Pieces (tk, h, loc, d: digest) of at most width windows about the found strings of texts, each with its group h; equal
    ones that are read together are merged on the spot and give spans (tk, loc: start, span_end)."""
    seen: dict = {}
    rows: list = []
    names, types = ["tk", "h", "loc", "d", "span_end"], [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    whole = width == WIDTHS[0]
    for b in batches:
        for tk, t, found in zip(b.column("tk").to_pylist(), b.column("text"), b.column("found"), strict=True):
            raw = t.as_py().encode()
            for x in found.as_py():
                h, first, off, n = x["h"], x["loc"] >> 16, (x["loc"] >> 8) & 255, x["loc"] & 255
                place, last = first + off, off - n + 1
                for part in range(last // width, off // width + 1):  # windows that start part * width ... bytes before the string
                    far, near = min(off, part * width + width - 1), max(last, part * width)
                    start, size = place - far, far - near + LENGTH
                    key = h
                    if not whole:
                        common = raw[place - part * width : place + LENGTH - min(part * width + width - 1, WIDTHS[0] - 1)]
                        key = int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=b"%d.%d" % (width, part)).digest(), "little", signed=True)
                    d = hashlib.md5(b"%d." % far + raw[start : start + size]).digest()
                    before = seen.get((key, d), 0)
                    if before == 0:
                        seen[key, d] = (tk, start)
                        rows.append((tk, key, (start << 16) | (far << 8) | (far - near + 1), d, None))
                        continue
                    rows.append((tk, None, start, None, start + size))
                    if before:
                        rows.append((before[0], None, before[1], None, before[1] + size))
                        seen[key, d] = None
            if len(rows) > 8192:
                yield _rows(rows, names, types)
                rows.clear()
            if len(seen) > 100_000:
                seen.clear()
    if rows:
        yield _rows(rows, names, types)


def _bytes(batches):
    """The bytes of the found pieces of texts."""
    for b in batches:
        rows = []
        for tk, t, found in zip(b.column("tk").to_pylist(), b.column("text"), b.column("found"), strict=True):
            raw = t.as_py().encode()
            for x in found.as_py():
                first, n = x["loc"] >> 16, x["loc"] & 255
                rows.append((tk, x["h"], x["loc"], raw[first : first + n - 1 + LENGTH]))
            if len(rows) > 8192:
                yield _rows(rows, ["tk", "h", "loc", "piece"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])
                rows = []
        if rows:
            yield _rows(rows, ["tk", "h", "loc", "piece"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])


def repeated_starts(group: np.ndarray, off: np.ndarray, n: np.ndarray, pieces: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each piece, which of its windows equal a window of another piece of its group, aligned at the string.

    group: dense ints in ascending order; off: distance from the first window to the string; n: windows.
    """
    m, left = len(pieces), int(off.max())
    sizes = np.array([len(p) for p in pieces])
    width = int((left - off + sizes).max())
    table = np.full((width, m), -1, np.int16)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(m), sizes)
    table[(np.arange(len(flat)) - starts[which]) + (left - off)[which], which] = flat
    order = np.arange(m)  # suffixes of the column, by group and bytes
    common = np.zeros(m, np.int32)  # prefix in common with the neighbour before, in that order
    out = np.zeros((m, int(n.max())), bool)
    base = group.astype(np.int64) << 9
    for col in range(width - 1, -1, -1):
        sym = table[col].astype(np.int64)
        key = base[order] + sym[order] + 1
        by = np.argsort(key, kind="stable")
        new, key = order[by], key[by]
        same = np.zeros(m, bool)
        same[1:] = (key[1:] == key[:-1]) & (sym[new[1:]] >= 0)
        at = np.flatnonzero(same)
        grown = np.zeros(m, np.int32)
        if len(at):
            lo, hi = by[at - 1] + 1, by[at] + 1  # places in the former order: the least of common[lo:hi]
            if (hi - lo == 1).all():
                least = common[lo]
            else:
                pad = np.append(common, 0)
                least = np.minimum.reduceat(pad, np.stack([lo, hi], 1).ravel())[::2]
            grown[at] = np.minimum(least + 1, length)
        order, common = new, grown
        long = np.flatnonzero(common >= length)
        if len(long):
            hit = np.unique(np.concatenate([order[long], order[long - 1]]))
            k = col - (left - off[hit])
            ok = (k >= 0) & (k < n[hit])
            out[hit[ok], k[ok]] = True
    return out


def _spans(batches):
    """Spans (tk, lo, hi) of repeats among different pieces sorted by h; complete groups are compared in batches."""

    def compare(rows):
        h = np.array([r[1] for r in rows])
        group = np.cumsum(np.diff(h, prepend=h[0]) != 0)
        loc = np.array([r[2] for r in rows])
        first, off, n = loc >> 16, (loc >> 8) & 255, loc & 255
        hit = repeated_starts(group, off, n, [r[3] for r in rows])
        i, k = np.nonzero(hit)
        if not len(i):
            return
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(i)) - 1
        yield pa.RecordBatch.from_arrays([pa.array([rows[x][0] for x in i[a]], pa.binary()), pa.array(first[i[a]] + k[a]), pa.array(first[i[a]] + k[b] + LENGTH)], ["tk", "lo", "hi"])

    held = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= BATCH and held[-1][1] != r[1]:
                yield from compare(held)
                held = []
            held.append(r)
    if held:
        yield from compare(held)


def repeats(texts: DataFrame, cap: int = CAP) -> DataFrame:
    """Spans (tk, lo, hi) of the repeats in distinct texts (tk, text, n)."""
    by_text = lambda df: df.groupBy("tk").agg(F.collect_list(F.struct("h", "loc")).alias("found"))
    with_texts = lambda found, f, schema: texts.select("tk", "text").join(found, "tk").select("tk", "text", "found").mapInArrow(f, schema)
    places = texts.select("tk", "text").mapInArrow(_places, "tk binary, h long, loc long")
    shared = materialise(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    todo, spans, groups = by_text(join_spread(places, shared, ["h"])), [], []
    end = F.shiftright("loc", 16) + F.col("loc").bitwiseAND(255) - 1 + LENGTH
    for width in WIDTHS:
        cut = materialise(with_texts(todo, partial(_cut, width=width), CUT))
        spans.append(cut.where("span_end is not null").select("tk", F.col("loc").alias("lo"), F.col("span_end").alias("hi")))
        pieces = cut.where("span_end is null").select("tk", "h", "loc", "d")
        kinds = materialise(pieces.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("tk", "loc")).alias("one")))
        twice = join_spread(pieces, kinds.where("n > 1").select("h", "d", "n"), ["h", "d"])
        spans.append(twice.select("tk", F.shiftright("loc", 16).alias("lo"), end.alias("hi")))
        sizes = materialise(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        ones = kinds.select("h", "one.tk", "one.loc")
        groups.append(join_spread(ones, sizes.where(F.col("n") <= cap), ["h"]))
        if sizes.where(F.col("n") > cap).isEmpty():
            break
        todo = by_text(join_spread(ones, sizes.where(F.col("n") > cap), ["h"]))
    pieces = with_texts(by_text(reduce(DataFrame.union, groups)), _bytes, "tk binary, h long, loc long, piece binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "h").sortWithinPartitions("h")
    return reduce(DataFrame.union, [*spans, dealt.mapInArrow(_spans, "tk binary, lo long, hi long")])


def _result(batches, with_rest=False):
    for b in batches:
        rows = []
        for tk, t, n, spans in zip(*(b.column(c).to_pylist() for c in ("tk", "text", "n", "spans")), strict=True):
            raw = t.encode()
            merged = []
            if n > 1 and len(raw) >= LENGTH:
                merged = [[0, len(raw)]]
            else:
                for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
            ends = [0, *(x for s in merged for x in s), len(raw)]
            rest = b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
            rows.append((tk, n, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if with_rest else None))
        if rows:
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["tk", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


RESULT = "tk binary, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest binary"


def deduped(docs: DataFrame, cap: int = CAP, with_rest: bool = False) -> DataFrame:
    """tk (digest of the text), n (its rows), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, rest (the bytes left) of each
    distinct text."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    distinct = docs.select(F.unhex(F.md5(text)).alias("tk"), text.alias("text")).groupBy("tk").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    name, parts = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(parts, "tk").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay: buckets can only be written by way of the catalogue
    spans = repeats(texts, cap).groupBy("tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return materialise(texts.join(spans, "tk", "left").select("tk", "text", "n", "spans").mapInArrow(partial(_result, with_rest=with_rest), RESULT))


def remove_repeats(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """docs with the bytes left in binary column `rest` (cuts may fall inside a character) and their counts."""
    out = join_spread(packed(docs, tk=F.unhex(F.md5(F.coalesce("text", F.lit("")))), _id=F.xxhash64("doc_id")), deduped(docs, cap, with_rest=True), ["tk"])
    return out.select(*unpacked(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest")


def op9(docs: DataFrame, cap: int = CAP) -> DataFrame:
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return join_spread(docs.select("doc_id", key.alias("tk")), deduped(docs, cap), ["tk"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, p, md5_number(b[p + 1:p + {LENGTH}]) AS k FROM (SELECT r, b, unnest(range(0, n - {LENGTH} + 1)) AS p FROM d WHERE n >= {LENGTH})),
m AS (SELECT r, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM s),
x AS (SELECT r, min(p) AS lo, max(p) + {LENGTH} AS hi FROM g GROUP BY r, g),
y AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM x),
k AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1:lo]), '' ORDER BY lo) || hex(any_value(b)[max(hi) + 1:]) AS kept
  FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
