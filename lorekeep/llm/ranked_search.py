"""Ranked lexical search: impact-ordered postings, scored an impact at a time, with exact stopping.

Items (queries) are taken in blocks of at most some `VOCABULARY` different terms. One pass over the documents keeps, for each, its
length and its counts of the block's terms; corpus counts (documents, terms, document frequencies) come of all documents. Documents
are then scored where they lie: a task builds, for every `SHARD` postings, an index in which the postings of a term are grouped by exact
impact, and processes an item's groups from the highest contribution down. It stops when the sum of what each term can still add
proves that no document but the contenders can be among the k best (a shard that cannot reach the k best of the shards before it
is not begun), and then completes the contenders' scores from the shard's documents. Tasks return k rows an item; their k best are
merged. So no posting is shuffled, and memory is bounded by a shard and a block.

Edge cases. Null texts, and texts without a term, are no documents and no queries. Every row is a document of its own: a repeated row
fills several ranks. Equal scores go by ascending doc_id, null doc_ids last. Rows of items that are equal in id and text are one item;
different texts under one id are answered each, so ranks of that id repeat. Long texts are read whole, one at a time. Columns
other than id and text are not carried, so their names do not matter. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Terms of a block of items, postings of a shard, postings between two looks at the bounds, contenders (times k) whose scores are completed.
VOCABULARY, SHARD, STEP, CONTENDERS = 1 << 19, 1 << 22, 1 << 12, 8

#: ASCII letters in lower case and digits stay, other ASCII bytes become spaces; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _lists(rows: list[list], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for row in rows for x in row], kind))


def asked(items: DataFrame) -> DataFrame:
    """(id, terms, counts) of (id, text): the different terms of each item that has any."""

    def run(batches):
        for b in batches:
            found = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists([list(c) for c in found], pa.binary()), _lists([list(c.values()) for c in found], pa.int64())], ["id", "terms", "counts"])

    kind = items.schema["id"].dataType.simpleString()
    texts = items.where("text is not null").distinct().select("id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, terms array<binary>, counts array<long>").where(F.size("terms") > 0)


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of (id, text): the number of all terms, and numbers and counts of those in the vocabulary; texts without terms are left out."""

    def run(batches):
        for b in batches:
            keep, sizes, ids, tfs = [], [], [], []
            for i, text in enumerate(b.column("text")):
                held = terms(text.as_py())
                if held:
                    count = Counter(held)
                    hits = sorted((vocabulary[t], count[t]) for t in vocabulary.keys() & count.keys())
                    keep.append(i)
                    sizes.append(len(held))
                    ids.append([t for t, _ in hits])
                    tfs.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), _lists(ids, pa.int32()), _lists(tfs, pa.int32())], ["id", "n", "terms", "tfs"])

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.where("text is not null").select("id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """The postings of some documents: by document, and by term and exact impact."""

    def __init__(self, batches: list[pa.RecordBatch], documents: int, all_terms: int, width: int):
        table = pa.Table.from_batches(batches)
        self.ids = table.column("id").combine_chunks()
        self.place = np.empty(len(self.ids), np.int64)  # of a document in the order of ids
        self.place[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(self.ids))
        n = table.column("n").to_numpy()
        self.size = np.concatenate([pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False) for b in batches]).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.term = np.concatenate([b.column("terms").flatten().to_numpy() for b in batches])
        tf = np.concatenate([b.column("tfs").flatten().to_numpy() for b in batches]).astype(np.int64)
        m = 75 + (25 * n * documents) // all_terms
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, self.size))
        order = np.lexsort((-self.impact, self.term))
        self.doc = np.repeat(np.arange(len(n)), self.size)[order]
        term, impact = self.term[order], self.impact[order]
        self.group = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.group_size = np.diff(np.r_[self.group, len(term)])
        self.group_impact = impact[self.group]
        self.first = np.searchsorted(term[self.group], np.arange(width + 1))  # of a term's groups

    def complete(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, each of which has a term; weights are by term."""
        at = _ranges(self.start[docs], self.size[docs])
        ends = np.cumsum(self.size[docs])
        return np.add.reduceat(weights[self.term[at]] * self.impact[at], ends - self.size[docs])

    def best(self, numbers: np.ndarray, weights: np.ndarray, by_term: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the k best of an item's terms (numbers and their weights, all over 0); k documents are known to reach floor."""
        spans = [(self.first[t], self.first[t + 1], w) for t, w in zip(numbers.tolist(), weights.tolist(), strict=True) if self.first[t] < self.first[t + 1]]
        lists = [w * self.group_impact[a:b] for a, b, w in spans]  # contributions of a term, descending
        none = np.zeros(0, np.int64)
        if not lists or sum(int(x[0]) for x in lists) < floor:
            return none, none
        value, group = np.concatenate(lists), np.concatenate([np.arange(a, b) for a, b, _ in spans])
        order = np.argsort(-value, kind="stable")
        falling, group = -value[order], group[order]
        total = np.cumsum(self.group_size[group])
        scores, at = np.zeros(len(self.ids), np.int64), 0
        while True:
            to = min(int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP)), len(group) - 1)
            to = int(np.searchsorted(falling, falling[to], side="right"))  # an impact is processed whole
            step = group[at:to]
            np.add.at(scores, self.doc[_ranges(self.group[step], self.group_size[step])], np.repeat(-falling[at:to], self.group_size[step]))
            at = to
            left = 0  # the most that any document can still gain
            if at < len(group):
                for x in lists:
                    rest = int(np.searchsorted(-x, falling[at - 1], side="right"))
                    left += int(x[rest]) if rest < len(x) else 0
            reached = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            need = max(floor, reached, 1)
            if left < need:
                contenders = np.flatnonzero(scores + left >= need)
                if left == 0 or len(contenders) <= CONTENDERS * k:
                    break
        if not len(contenders):
            return none, none
        exact = self.complete(contenders, by_term)
        keep = np.lexsort((self.place[contenders], -exact))[:k]
        keep = keep[exact[keep] >= need]
        return contenders[keep], exact[keep]


def ranked(postings: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], documents: int, all_terms: int, width: int, k: int) -> DataFrame:
    """(q, doc, score): for each query (numbers and weights of terms) the k best rows of each task of postings (of `forward`)."""

    def run(batches):
        best: list[list] = [[] for _ in queries]
        key = lambda x: (-x[0], x[1] is None, x[1])
        kind = None

        def scan(held):
            shard, by_term = Shard(held, documents, all_terms, width), np.zeros(width, np.int64)
            for q, (numbers, weights) in enumerate(queries):
                by_term[numbers] = weights
                docs, scores = shard.best(numbers, weights, by_term, k, best[q][-1][0] if len(best[q]) == k else 0)
                by_term[numbers] = 0
                if len(docs):
                    best[q] = sorted(best[q] + list(zip(scores.tolist(), shard.ids.take(pa.array(docs)).to_pylist(), strict=True)), key=key)[:k]

        held, n = [], 0
        for b in batches:
            kind = b.schema.field("id").type
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                held.append(part)
                n += pc.sum(pc.list_value_length(part.column("terms"))).as_py()
                if n >= SHARD:
                    scan(held)
                    held, n = [], 0
        if held:
            scan(held)
        for at in range(0, len(queries), 1024):
            rows = [(q, d, s) for q in range(at, min(at + 1024, len(queries))) for s, d in best[q]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["q", "doc", "score"])

    kind = postings.schema["id"].dataType.simpleString()
    return postings.where(F.size("terms") > 0).mapInArrow(run, f"q int, doc {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) for each item (item_id, text) by exact scores over 0."""
    docs, items = docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text")
    spark, queries = docs.sparkSession, materialise(asked(items))
    kinds = f"q int, item_id {items.schema['id'].dataType.simpleString()}"
    blocks = math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / VOCABULARY)
    found = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == block).collect()
        numbers: dict[bytes, int] = {}
        for r in own:
            for t in r.terms:
                numbers.setdefault(bytes(t), len(numbers))
        postings = materialise(forward(docs, numbers))
        size = postings.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not own or not size.documents:
            continue
        held = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row a term of the block
        weight = np.zeros(len(numbers), np.int64)
        for r in held:
            weight[r.t] = math.floor(1000 * math.log((2 * size.documents + 2) / (2 * r.df + 1)))
        told = []
        for r in own:
            number, count = np.array([numbers[bytes(t)] for t in r.terms], np.int64), np.array(r.counts, np.int64)
            some = weight[number] > 0
            told.append((number[some], (count * weight[number])[some]))
        part = ranked(postings, told, size.documents, size.terms, len(numbers), k)
        place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = part.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.id) for q, r in enumerate(own)], kinds)
        found.append(materialise(top.join(names, "q").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")))
    if not found:
        return spark.createDataFrame([], f"{kinds.split(', ')[1]}, rank int, doc_id {docs.schema['id'].dataType.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def op11(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(documents, benchmark, 20)


OP11_SQL = r"""
with words as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents where text is not null
), docs as (select doc_id, d, ws, len(ws) as n from words where len(ws) > 0),
corpus as (select count(*) as documents, sum(n)::bigint as terms from docs),
tf as (select d, w, count(*) as tf from (select d, unnest(ws) as w from docs) group by d, w),
weight as (select w, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from tf, corpus group by w, documents),
asked as (
  select item_id, w, count(*) as c from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark where text is not null
  ) group by item_id, w
), scored as (
  select item_id, d, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // terms))))::bigint as score
  from asked join weight using (w) join tf using (w) join docs using (d), corpus group by item_id, d, doc_id
), placed as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 20
"""
