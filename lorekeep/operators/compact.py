"""A compact export of the graph for small devices: thinned edges between node numbers, short keys, rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import numbered, written

#: Short keys of the export and the fields they stand for.
KEYS = {"id": "id", "n": "name", "p": "provider", "d": "date", "c": "cluster", "m": "n_messages", "t": "terms", "s": "snippet", "x": "x", "y": "y", "z": "z", "tx": "tx", "ty": "ty", "tz": "tz"}


def clean(text: Column, cap: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, cap)


def compact(nodes: DataFrame, edges: DataFrame, per_node: int = 8, decimals: int = 2, name_cap: int = 120, snippet_cap: int = 160) -> dict[str, DataFrame]:
    """nodes (idx from 0 in the order of id, then KEYS), edges (src, dst, w) by idx, and counts, a row.

    An edge stays if it is among the heaviest per_node of either end; edges with an unknown end or two equal ends are
    counted as unresolved; parallel edges count once, with their greatest weight. Missing numbers become 0, or -1 for
    a cluster.
    """
    placed = written(numbered(nodes, [F.col("id")], "_at").withColumn("idx", F.col("_at") - 1))
    number = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), decimals)
    made = {"n": clean(F.col("name"), name_cap), "s": clean(F.col("snippet"), snippet_cap), "t": F.transform(F.slice(F.coalesce("terms", F.array().cast("array<string>")), 1, 4), lambda t: clean(t, 24))}
    made |= {"c": F.coalesce("cluster", F.lit(-1)), "m": F.coalesce("n_messages", F.lit(0))} | {c: number(c) for c in ("x", "y", "z", "tx", "ty", "tz")}
    short = placed.select("idx", *(made.get(k, F.coalesce(F.col(v), F.lit(""))).alias(k) for k, v in KEYS.items()))
    ids = placed.select("id", "idx")
    ends = edges.join(ids.select(F.col("id").alias("a"), F.col("idx").alias("ia")), "a", "left").join(ids.select(F.col("id").alias("b"), F.col("idx").alias("ib")), "b", "left")
    ends = written(ends.select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")))
    lost = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))
    kept = graph.top_edges(graph.canonical(ends.where(~lost)), per_node).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("w", 3).alias("w"))
    counts = ends.agg(F.count("*").alias("edges_in"), F.count_if(lost).alias("edges_unresolved"))
    counts = counts.crossJoin(kept.agg(F.count("*").alias("edges_kept"))).crossJoin(short.agg(F.count("*").alias("nodes")))
    return {"nodes": short, "edges": kept, "counts": counts}


def write(bundle: dict[str, DataFrame], folder: str, spot: tuple[str, str] | None = None) -> None:
    """Writes gzipped JSON lines, a folder a part, and reads them again to check them.

    Checked: node and edge counts, that edges name nodes, and, if given, that the node of id spot[0] is named spot[1].
    """
    for name, df in bundle.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{name}")
    spark = bundle["nodes"].sparkSession
    nodes, edges = (spark.read.schema(bundle[k].schema).json(f"{folder}/{k}") for k in ("nodes", "edges"))
    want = bundle["counts"].first()
    n = nodes.count()
    if (n, edges.count()) != (want.nodes, want.edges_kept):
        raise ValueError(f"{folder}: rows read differ from rows written")
    if not edges.where(f"src not between 0 and {n - 1} or dst not between 0 and {n - 1}").isEmpty():
        raise ValueError(f"{folder}: an edge names no node")
    if spot and nodes.where((F.col("id") == spot[0]) & (F.col("n") == spot[1])).isEmpty():
        raise ValueError(f"{folder}: no node {spot[0]!r} of the name given")
