"""Hybrid search: vector, best-chunk and keyword rankings fused by reciprocal rank."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .common import numbered

RRF_K = 60


KINDS = ("conversation", "chunk", "lexical")


def fuse(semantic: DataFrame, chunk: DataFrame, lexical: DataFrame) -> DataFrame:
    """(doc_id, rrf, conversation_score, chunk_score, lexical_score, chunk_id) of (doc_id, score, and chunk_id in chunk, if there).

    Semantic ranks count always, those of the other rankings where the score is over 0. Ranks are by score descending, then
    doc_id descending. The three rankings are numbered as one table, which is computed once.
    """

    def one(i, d):
        held = F.col("chunk_id").cast("long") if "chunk_id" in d.columns else F.lit(None).cast("long")
        return d.select(F.lit(i).alias("kind"), "doc_id", F.col("score").cast("double").alias("score"), held.alias("chunk_id"))

    ranked = numbered(one(0, semantic).union(one(1, chunk)).union(one(2, lexical)), [F.desc("score"), F.desc("doc_id")], "rank", ("kind",))
    part = F.when((F.col("score") > 0) | (F.col("kind") == 0), 1 / (RRF_K + F.col("rank")))
    scores = [F.max(F.when(F.col("kind") == i, F.col("score"))).alias(f"{k}_score") for i, k in enumerate(KINDS)]
    return ranked.groupBy("doc_id").agg(F.sum(part).alias("rrf"), *scores, F.max("chunk_id").alias("chunk_id"))


class Hit(NamedTuple):
    doc_id: object
    rrf: float
    conversation_score: float | None
    chunk_score: float | None
    lexical_score: float | None
    chunk_id: int | None


#: Rows of a ranking that are read at first, and as a multiple when they prove nothing; documents whose ranks are counted exactly.
DEPTH, DEEPER, CONTENDERS = 1024, 8, 256


def top_fused(semantic: DataFrame, chunks: DataFrame, lexical: DataFrame, k: int, depth: int = DEPTH) -> tuple[list[Hit], dict]:
    """The first k of `fuse` without its ranks of all rows, and how many rows came to the driver: a threshold algorithm.

    semantic and lexical are (doc_id, score), chunks (doc_id, chunk_id, score), of which the best of a document counts, ties to the lowest. Of each
    ranking the first rows are read, as many as bound the fused score of all documents that are not among them under the k-th found. What
    ranks the contenders have in rankings where they come later is counted in one pass of each; nothing is sorted whole, shuffled whole or written.
    """
    lists = [semantic.select("doc_id", F.col("score").cast("double").alias("score"), F.lit(None).cast("long").alias("chunk_id")), chunks.select("doc_id", F.col("score").cast("double").alias("score"), F.col("chunk_id").cast("long").alias("chunk_id")), lexical.select("doc_id", F.col("score").cast("double").alias("score"), F.lit(None).cast("long").alias("chunk_id"))]
    lists[1:] = [x.where("score > 0") for x in lists[1:]]
    held: list[dict] = [{}, {}, {}]
    more, read = [True] * 3, 0
    part = lambda rank: 1 / (RRF_K + rank)
    while True:
        for i, x in enumerate(lists):
            if more[i]:
                rows = x.orderBy(F.desc("score"), F.desc("doc_id"), "chunk_id").limit(depth).collect()
                more[i], read, held[i] = len(rows) == depth, read + len(rows), {}
                for r in rows:
                    held[i].setdefault(r.doc_id, (len(held[i]) + 1, r.score, r.chunk_id))
        rest = [part(len(h) + 1) if m else 0.0 for h, m in zip(held, more, strict=True)]  # the most that a ranking adds to a document it has not shown
        low = {d: sum(part(h[d][0]) for h in held if d in h) for d in set().union(*held)}
        order = sorted(low, key=lambda d: (low[d], d), reverse=True)
        if not any(more):
            contenders = order[:k]
            break
        least = low[order[k - 1]] if len(order) >= k else 0.0
        contenders = [d for d in order if low[d] + sum(b for h, b in zip(held, rest, strict=True) if d not in h) >= least]
        if sum(rest) < least and len(contenders) <= max(CONTENDERS, 4 * k):
            break
        depth *= DEEPER
    for i, x in enumerate(lists):
        missing = [d for d in contenders if d not in held[i]]
        if missing and more[i]:
            best = F.max(F.struct("score", (-F.col("chunk_id")).alias("c")))
            rows = x.where(F.col("doc_id").isin(missing)).groupBy("doc_id").agg(best.alias("b")).collect()
            keys = sorted((r.b.score, r.doc_id) for r in rows)
            if keys:
                kind = x.schema["doc_id"].dataType
                below = F.size(F.filter(F.array(*(F.struct(F.lit(s).alias("score"), F.lit(d).cast(kind).alias("doc_id")) for s, d in keys)), lambda e: e < F.struct("score", "doc_id")))
                over = x.where(F.col("score") >= keys[0][0]).groupBy("doc_id").agg(F.max("score").alias("score")).groupBy(below.alias("below")).count().collect()
                ranks = {d: 1 + sum(r["count"] for r in over if r.below > at) for at, (_, d) in enumerate(keys)}
                held[i] |= {r.doc_id: (ranks[r.doc_id], r.b.score, None if r.b.c is None else -r.b.c) for r in rows}
                read += len(rows) + len(over)
    score = lambda d: sum(part(h[d][0]) for h in held if d in h)
    said = lambda i, d, at: held[i][d][at] if d in held[i] else None
    hits = [Hit(d, score(d), said(0, d, 1), said(1, d, 1), said(2, d, 1), said(1, d, 2)) for d in contenders]
    return sorted(hits, key=lambda h: (h.rrf, h.doc_id), reverse=True)[:k], {"rows_read": read, "depth": depth, "contenders": len(contenders)}


def best_chunk(chunks: DataFrame, query: Column) -> DataFrame:
    """(doc_id, score, chunk_id): the best chunk of each document, ties to the lowest chunk."""
    scored = chunks.select("doc_id", "chunk_id", cosine(F.col("vector"), query).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("c"))).alias("b"))
    return best.select("doc_id", F.col("b.score").alias("score"), (-F.col("b.c")).alias("chunk_id"))


def post_filter(hits: DataFrame, keep: Column, k: int, wide: int = 3) -> DataFrame:
    """The first k of the first wide*k hits that pass; fewer may pass."""
    order = [F.desc("rrf"), F.desc("doc_id")]
    return hits.orderBy(*order).limit(wide * k).where(keep).orderBy(*order).limit(k)
