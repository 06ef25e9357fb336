"""Phrase collocation mining: candidates from a sketch's upper bounds, counted by automata, scored exactly.

Texts become shards of at most about `SHARD` bytes of one language: words between single spaces, pieces on lines of their own. A
sketch of one row of cells, twice as many as there are words, counts phrases of every length by hash; it is itself divided by ranges of cells among
tasks, and each shard sends only the cells it has, so the work grows with the texts. The bound of a phrase is the least of the cells of
all phrases inside it, so it is never under the count. Each shard compiles its own phrases whose bound reaches the least
count, with a delimiter on either side, into an automaton (pyahocorasick), and scans its texts for overlapping matches. The counts of all shards are
sent in compressed buckets of phrases and summed, and thresholds, scores and the rule of longer phrases are joins of those sums. Nothing is bounded by a number of phrases, and a
task holds one shard or one range of cells.

Edge cases. Null texts are empty, null languages are `und`. Rows are counted as they come, so repeated rows count again. A text longer than
a shard is divided between pieces, which no phrase crosses; a single piece is never divided. Words may be of any length. Ties of score
and count go by the bytes of the phrase. Columns other than text and lang are not carried. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, materialise

#: Bytes of a shard, of a part of it (a row), and of all open shards of a task; cells of a range of the sketch.
SHARD, PART, OPEN, RANGE = 16 << 20, 1 << 20, 48 << 20, 1 << 22
#: Words of the texts for a bucket of phrases; phrases that are dealt to buckets at once.
BUCKET, LINES = 1 << 22, 1 << 16

#: A-Z in lower case, tabs as spaces, and the marks and breaks between pieces as line feeds.
_FOLD = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r" + bytes(range(65, 91)), b" " + b"\n" * 9 + bytes(range(97, 123)))
_ODD = 0x9E3779B97F4A7C15


def pieces(text: bytes):
    """The pieces of a text that have words, each as its words with single spaces before, between and after them."""
    for piece in text.translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            yield b" " + b" ".join(words) + b" "


def shards(docs: DataFrame) -> DataFrame:
    """(shard, part, lang, text, words) of (lang, text): parts of shards, pieces on lines of their own, compressed."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        small = zstandard.ZstdCompressor(3)

        open_: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def close(lang):
            nonlocal number
            held, start, size, part = open_.pop(lang), 0, 0, 0
            for end, piece in enumerate(held, 1):
                size += len(piece) + 1
                if size >= PART or end == len(held):
                    text = b"\n".join(held[start:end])
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.int32()), pa.array([lang]), pa.array([small.compress(text)], pa.binary()), pa.array([text.count(b" ") - (end - start)])], ["shard", "part", "lang", "text", "words"])
                    start, size, part = end, 0, part + 1
            number += 1
            del sizes[lang]

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for piece in pieces(text.as_py()):
                    open_.setdefault(lang, []).append(piece)
                    sizes[lang] = sizes.get(lang, 0) + len(piece) + 1
                    if sizes[lang] >= SHARD:
                        yield from close(lang)
                while sum(sizes.values()) > OPEN:
                    yield from close(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield from close(lang)

    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "shard long, part int, lang string, text binary, words long")


def plain(part: bytes) -> bytes:
    """The text of a part."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(part)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a part of a shard: where they start and end, how many follow in the same piece, and hashes of phrases."""

    def __init__(self, text: bytes, lang: str):
        raw = np.frombuffer(text, np.uint8)
        gap = np.r_[True, (raw == 32) | (raw == 10), True]
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:])[:]
        self.end = np.flatnonzero(~gap[:-1] & gap[1:])
        self.start, self.end = self.start.astype(np.int64), self.end.astype(np.int64)
        self.next = np.r_[self.start[1:] - self.end[:-1] == 1, False]  # the next word is in the same piece
        powers = np.multiply.accumulate(np.full(len(raw) + 1, _ODD, np.uint64))
        back = np.multiply.accumulate(np.full(len(raw) + 1, pow(_ODD, -1, 1 << 64), np.uint64))
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])]
        seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self.word = _mixed((total[self.end] - total[self.start]) * back[self.start] ^ seed)

    def phrases(self, most: int):
        """For lengths from 1 on: (places of phrases' first words, hashes)."""
        at, h = np.arange(len(self.word)), self.word
        yield at, h
        for n in range(1, most):
            ok = self.next[at + n - 1]
            at, h = at[ok], h[ok]
            h = _mixed(h * np.uint64(_ODD) + self.word[at + n] + np.uint64(n))
            yield at, h


def _small(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(x) if x else b""


def _plain(b: bytes) -> bytes:
    return plain(b) if b else b""


def _planes(x: np.ndarray) -> bytes:
    """Numbers under 2^32, the bytes of equal worth together, so that codecs find the zeros; compressed."""
    return _small(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _encoded(x: np.ndarray) -> bytes:
    """Ascending numbers as gaps; none as no bytes."""
    return _planes(np.diff(x, prepend=0))


def _decoded(b: bytes) -> np.ndarray:
    return np.cumsum(_numbers(b), dtype=np.int64)


def sketched(parts: DataFrame, most: int, bits: int, least: int) -> DataFrame:
    """(shard, segment, cells): cells of the sketch (2^bits of them) that a shard has and that all shards together bring to `least`."""
    shift = np.uint64(64 - bits)
    width = min(RANGE, 1 << bits)

    def send(batches):
        shard, held, size = None, [], 0

        def out():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, least).astype(np.uint8)
            ends = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, width, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            rows = [(int(s), _encoded(cells[ends[s] : ends[s + 1]].astype(np.int64) - int(s) * width), _small(n[ends[s] : ends[s + 1]].tobytes())) for s in some]
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part])], ["shard", "segment", "cells", "n"])

        for b in batches:
            for r in range(b.num_rows):
                own, text = b.column("shard")[r].as_py(), plain(b.column("text")[r].as_py())
                if own != shard or size > 2 * SHARD:
                    if held:
                        yield from out()
                    shard, held, size = own, [], 0
                size += len(text)
                held.extend(h >> shift for _, h in Words(text, b.column("lang")[r].as_py()).phrases(most))
        if held:
            yield from out()

    def reach(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for cells, n in zip(table.column("cells"), table.column("n"), strict=True):
            total[_decoded(cells.as_py())] += np.frombuffer(_plain(n.as_py()), np.uint8)
        good, out = total >= least, []
        for cells in table.column("cells"):
            x = _decoded(cells.as_py())
            out.append(_encoded(x[good[x]]))
        return pa.table({"shard": table.column("shard"), "segment": table.column("segment"), "cells": pa.array(out, pa.binary())})

    sent = parts.select("shard", "lang", "text").mapInArrow(send, "shard long, segment long, cells binary, n binary")
    return sent.groupBy("segment").applyInArrow(reach, "shard long, segment long, cells binary").where(F.length("cells") > 0)


def _held(cells: np.ndarray, good: np.ndarray) -> np.ndarray:
    at = np.searchsorted(good, cells)
    return good[np.minimum(at, len(good) - 1)] == cells if len(good) else np.zeros(len(cells), bool)


def _candidates(texts: list[bytes], lang: str, good: np.ndarray, most: int, shift, apart: bool = True) -> tuple[list[str], np.ndarray]:
    """A shard's phrases, with their delimiters, whose cells, and those of all phrases inside them, are good; and how often phrases of each length occur.

    With apart, phrases of equal hashes count as equal, which is faster; the occurrences tell if that lost any.
    """
    found: set[bytes] = set()
    times = np.zeros(most, np.int64)
    for text in texts:
        words, ok = Words(text, lang), None
        for n, (at, h) in enumerate(words.phrases(most)):
            if ok is not None:  # both phrases of one word less are good
                some = ok[at] & ok[at + 1]
                at, h = at[some], h[some]
            some = _held(h >> shift, good)
            at, h = at[some], h[some]
            ok = np.zeros(len(words.start) + 1, bool)
            ok[at] = True
            times[n] += len(at)
            if apart:
                at = at[np.unique(h, return_index=True)[1]]
            found.update(map(text.__getitem__, map(slice, (words.start[at] - 1).tolist(), (words.end[at + n] + 1).tolist())))
    return [p.decode() for p in sorted(found)], times


def _scanned(texts: list[bytes], phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs in the texts, overlaps included."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    n = np.zeros(len(phrases), np.int64)
    for text in texts:
        n += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text.decode())), np.int64), minlength=len(phrases))
    return n


def _buckets(text: bytes, lang: str, buckets: int) -> np.ndarray:
    """Buckets of the phrases on the lines of a text, delimiters on either side: of equal first two words in four buckets at most, so that a bucket's phrases share words."""
    words = Words(text, lang)
    first = np.flatnonzero(~np.r_[False, words.next[:-1]])
    second = np.minimum(first + 1, len(words.word) - 1)
    third = np.minimum(first + 2, len(words.word) - 1)
    two = words.next[first]
    three = two & words.next[second]
    head = words.word[first] * np.uint64(_ODD) + np.where(two, words.word[second], np.uint64(0))
    return ((_mixed(head) + np.where(three, words.word[third] & np.uint64(3), np.uint64(0))) % np.uint64(buckets)).astype(np.int64)


def counted(parts: DataFrame, good: DataFrame, most: int, bits: int, buckets: int = 16, least: int = 1) -> DataFrame:
    """(lang, phrase, n): counts of the candidates of all shards, by an automaton over each shard's parts, that reach `least`.

    A shard sends its phrases, sorted and compressed, in a row a bucket of phrases; buckets are summed.
    """
    shift = np.uint64(64 - bits)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"lang": pa.array([], pa.string()), "bucket": pa.array([], pa.int64()), "phrases": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return empty
        texts, lang = [plain(t.as_py()) for t in left.column("text")], left.column("lang")[0].as_py()
        base = right.column("segment").to_numpy() * min(RANGE, 1 << bits)
        cells = np.unique(np.concatenate([_decoded(c.as_py()) + b for c, b in zip(right.column("cells"), base.tolist(), strict=True)])).astype(np.uint64)
        phrases, times = _candidates(texts, lang, cells, most, shift)
        if not phrases:
            return empty
        n = _scanned(texts, phrases)
        if n.sum() != times.sum():  # different phrases had equal hashes
            phrases, _ = _candidates(texts, lang, cells, most, shift, apart=False)
            n = _scanned(texts, phrases)
        lines = [p.encode() for p in phrases]
        bucket = np.concatenate([_buckets(b"\n".join(lines[i : i + LINES]), lang, buckets) for i in range(0, len(lines), LINES)])
        by = np.argsort(bucket, kind="stable")
        some, first = np.unique(bucket[by], return_index=True)
        runs = np.split(by, first[1:])
        held = [_small(b"\n".join([lines[i][1:-1] for i in run.tolist()])) for run in runs]
        return pa.table({"lang": pa.array([lang] * len(runs)), "bucket": pa.array(some), "phrases": pa.array(held, pa.binary()), "n": pa.array([_planes(n[run]) for run in runs], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        lists = [pa.array(plain(b.as_py()).decode().split("\n"), pa.string()) for b in table.column("phrases")]
        n = np.concatenate([_numbers(b.as_py()) for b in table.column("n")]).astype(np.int64)
        sums = pa.table({"phrase": pa.chunked_array(lists), "n": pa.array(n)}).group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * sums.num_rows, pa.string()), "phrase": sums.column("phrase"), "n": sums.column("n_sum")})

    both = parts.select("shard", "lang", "text").groupBy("shard").cogroup(good.groupBy("shard"))
    sent = both.applyInArrow(scan, "lang string, bucket long, phrases binary, n binary")
    return sent.groupBy("lang", "bucket").applyInArrow(add, "lang string, phrase string, n long")


def mine(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `most` words that occur `least` times or more.

    a is the phrase's count, l and r those of its two parts where it is cut at the lowest score floor(10^6 a^2 / (l r)), n all words of the
    language. A phrase inside a longer candidate that has at least `share` percent of its count is dropped.
    """
    parts = materialise(shards(docs.select("lang", "text")))
    size = parts.agg(F.sum("words")).first()[0] or 0
    bits = max(16, math.ceil(math.log2(2 * size + 1)))
    good = sketched(parts, most, bits, least)
    held = materialise(counted(parts, good, most, bits, max(16, size // BUCKET), least).withColumnRenamed("n", "a").withColumn("words", F.size(F.split("phrase", " "))))
    words, k = F.split("phrase", " "), F.col("k")
    made = held.where("words >= 2").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    piece = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    cuts = materialise(made.select("lang", "phrase", "a", "k", piece(F.lit(1), k).alias("head"), piece(k + 1, F.col("words") - k).alias("tail")))
    for part, count in (("head", "l"), ("tail", "r")):
        times = cuts.groupBy("lang", F.col(part)).agg(F.count("*").alias("n"))
        given = materialise(times.join(held.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), ["lang", part]))
        cuts = join_spread(cuts, given, ["lang", part])
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).alias("up"), (exact("l") * exact("r")).alias("down"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: piece(at, F.lit(n)))
    inside = [held.where(F.col("words") > n).select("lang", F.explode(spans(n)).alias("phrase"), "a") for n in range(2, most)]
    if inside:
        longer = inside[0]
        for more in inside[1:]:
            longer = longer.union(more)
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        low = low.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    total = parts.groupBy("lang").agg(F.sum("words").alias("n"))
    rows = low.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = rows
    for shares in (256, 16):  # first within shares of a language, so no task ranks it whole
        near = near.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(documents: DataFrame) -> DataFrame:
    return mine(documents)


OP12_SQL = r"""
with pieces as (
  select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
  )
), places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from pieces),
grams as (
  select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase, count(*) as f from places, (select unnest([1, 2, 3]) as m) where i + m - 1 <= len(ws) group by all
), total as (select lang, sum(f)::bigint as n from grams where m = 1 group by lang),
made as (select lang, m, phrase, f as a from grams where m >= 2 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, ((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f))::bigint as score
  from (select *, unnest(range(1, m)) as k from made) c
  join grams l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : c.k], ' ')
  join grams r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1 :], ' ')
), low as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from low where not exists (
    select 1 from made x where x.lang = low.lang and x.m = 3 and len(string_split(low.phrase, ' ')) = 2 and 100 * x.a >= 50 * low.a
    and low.phrase in (array_to_string(string_split(x.phrase, ' ')[1:2], ' '), array_to_string(string_split(x.phrase, ' ')[2:3], ' '))
  )
), placed as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from kept)
select lang, rank, phrase, a, l, r, n, score from placed join total using (lang) where rank <= 2000
"""
