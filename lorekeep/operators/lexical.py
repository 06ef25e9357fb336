"""BM25 over documents (doc_id, text): postings, idf, scores."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP, tokens
from .common import written

K1, B = 1.5, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("len"))


def idf(docs: DataFrame) -> DataFrame:
    """(term, df, idf); the corpus size comes as a one-row join."""
    n = docs.agg(F.count("*").alias("n"))
    return postings(docs).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _score(weight, tf, df, n, length, mean, k1: float, b: float):
    idf_ = F.log1p((n - df + 0.5) / (df + 0.5))
    return weight * idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25(docs: DataFrame, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of documents that hold a query token; repeated query tokens count again; doc_ids are distinct.

    A document's counts of the query's terms come out of one pass over its tokens, nothing is shuffled but the sums of
    the corpus, one row.
    """
    weight = Counter(query)
    terms = list(weight)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    toks = tokens(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", F.transform(F.array(toks), lambda ts: F.struct(F.size(ts).cast("long").alias("len"), F.filter(ts, lambda t: t.isin(terms)).alias("hits")))[0].alias("d"))
    times = lambda t: F.size(F.filter("hits", lambda x: x == F.lit(t))).cast("long")
    tf = [times(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counts = written(slim.select("doc_id", "d.len", "d.hits").select("doc_id", "len", *tf))
    corpus = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    parts = [_score(float(weight[t]), F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("len"), F.col("avgdl"), k1, b) for i, t in enumerate(terms)]
    held = reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    return counts.where(held).crossJoin(F.broadcast(corpus)).select("doc_id", sum(parts[1:], parts[0]).alias("score"))


#: Folders of a stored index; a query reads those of its terms.
BUCKETS = 16


def bucket(term):
    return F.pmod(F.crc32(F.col(term)), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The same, on the driver."""
    return crc32(term.encode()) % BUCKETS


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, len, term, tf): postings of docs; a document without words has one row with a null term."""
    sized = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("len"), F.explode_outer("ts").alias("term"))
    return sized.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def write_postings(postings_: DataFrame, folder: str) -> None:
    """Entries as a segment of a stored index: a folder a bucket of terms, in which rows are by term."""
    spread = int(postings_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = postings_.withColumn("bucket", F.coalesce(bucket("term"), F.lit(BUCKETS)))
    held.repartition(spread, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")


def corpus(lengths_: DataFrame) -> DataFrame:
    """The row (n, avgdl) of documents (len)."""
    return lengths_.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def write_index(postings_: DataFrame, folder: str) -> None:
    """Entries as a stored index of one segment, with the row of its corpus."""
    write_postings(postings_, folder)
    corpus(read_index(postings_.sparkSession, folder).groupBy("doc_id").agg(F.max("len").alias("len"))).write.parquet(f"{folder}/corpus")


def read_index(spark, folder: str) -> DataFrame:
    """The entries of a segment, with their bucket."""
    return spark.read.schema("doc_id string, len long, term string, tf long, bucket int").parquet(f"{folder}/postings")


def read_segments(spark, folders: list[str], gone: DataFrame | None = None) -> DataFrame:
    """The entries of segments, the number of each being its place in the list, without those of documents that are gone (doc_id, segment)."""
    parts = [read_index(spark, f).withColumn("segment", F.lit(i)) for i, f in enumerate(folders)]
    out = reduce(DataFrame.unionByName, parts)
    return out if gone is None or gone.isEmpty() else out.join(gone, ["doc_id", "segment"], "left_anti")


def search_segments(spark, entries_: DataFrame, row, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """bm25 (doc_ids are strings) from the entries of a stored index and the row of its corpus: only the folders of the query's terms are read, and of them only those terms' rows."""
    weight = Counter(query)
    if not weight or not row.n:
        return spark.createDataFrame([], "doc_id string, score double")
    places = sorted({bucket_of(t) for t in weight})
    held = entries_.where(F.col("bucket").isin(places) & F.col("term").isin(list(weight)))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*(x for t, c in weight.items() for x in (F.lit(t), F.lit(float(c)))))
    part = _score(times[F.col("term")], F.col("tf"), F.col("df"), F.lit(row.n), F.col("len"), F.lit(row.avgdl), k1, b)
    return held.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(part).alias("score"))


def search_index(spark, folder: str, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """search_segments of an index of one segment."""
    return search_segments(spark, read_index(spark, folder), spark.read.schema("n long, avgdl double").parquet(f"{folder}/corpus").first(), query, k1, b)


def top_terms(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, rank, term, n): most frequent words of three letters or more, ties by first appearance."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    found = docs.select("doc_id", F.posexplode(words).alias("pos", "term")).where(~F.col("term").isin(*STOP))
    counted = found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "pos")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("doc_id", "rank", "term", "n")
