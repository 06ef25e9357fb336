"""What a viewer of the graph shows: filtered nodes and edges, keyword hits, sizes, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import visible


def node_filter(nodes: DataFrame, hidden_clusters=(), hidden_providers=(), months: tuple[str, str] | None = None) -> DataFrame:
    """nodes (id, cluster, provider, date) outside the hidden clusters and providers and, if months are given, with a date
    from the first day of the first month to day 31 of the last, compared as strings. No provider means "claude"."""
    keep = F.lit(True)
    if hidden_clusters:
        keep = keep & ~F.coalesce(F.col("cluster").isin(*hidden_clusters), F.lit(False))
    if hidden_providers:
        keep = keep & ~F.coalesce(F.nullif("provider", F.lit("")), F.lit("claude")).isin(*hidden_providers)
    if months:
        keep = keep & F.col("date").between(f"{months[0]}-01", f"{months[1]}-31")
    return nodes.where(keep)


def filtered(nodes: DataFrame, edges: DataFrame, **hidden) -> tuple[DataFrame, DataFrame]:
    """The nodes of node_filter and the edges with both ends among them."""
    kept = node_filter(nodes, **hidden)
    return kept, visible(edges, kept)


def keyword_hits(nodes: DataFrame, query: str, n: int | None = None) -> DataFrame:
    """Nodes (id, name, terms, snippet, pos) that hold the query in name, a term or the snippet, whatever its case; with n, the
    first so many by pos. Terms are lower case."""
    q = F.lit(query.lower())
    held = [F.contains(F.lower("name"), q), F.exists("terms", lambda t: F.contains(t, q)), F.contains(F.lower("snippet"), q)]
    hits = nodes.where(F.coalesce(held[0], F.lit(False)) | F.coalesce(held[1], F.lit(False)) | F.coalesce(held[2], F.lit(False)))
    return hits if n is None else hits.orderBy("pos").limit(n)


def or_else(hits: DataFrame, fallback) -> DataFrame:
    """hits, or what fallback() gives if there are none."""
    return hits if not hits.isEmpty() else fallback()


def hit_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, date, score) of search hits (id, title, date, score): as the node has them, else as the hit has."""
    n = nodes.select("id", F.col("name").alias("_name"), F.col("date").alias("_date"), F.lit(True).alias("_is"))
    own = lambda a, b: F.when(F.col("_is"), F.col(a)).otherwise(F.col(b))
    return hits.join(n, "id", "left").select("id", own("_name", "title").alias("name"), own("_date", "date").alias("date"), "score")


def node_scalars(n_messages: Column) -> dict[str, Column]:
    """Size and value of a node."""
    grown = F.log(n_messages + F.lit(1.0))
    return {"size": F.greatest(F.lit(2.0), grown * 1.5), "val": grown * 3}


def link_scalars(w: Column) -> dict[str, Column]:
    """Width and particles of a link, and its distance in space, in the plane and in clusters; no weight or 0 counts as one half there."""
    near = 1 - F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(0.5))
    return {"width": w * 2, "particles": F.ceil(w * 4), "distance": near * 100, "distance_flat": near * 150, "distance_cluster": F.lit(40.0)}


def extent(points: DataFrame) -> DataFrame:
    """One row (cx, cy, cz, spread, dist) of points (x, y, z), missing numbers being 0; no row without points."""
    at = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in "xyz"}
    ends = points.agg(*(f(at[c]).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).where("lox is not null")
    spread = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"))
    return ends.select(*(((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"c{c}") for c in "xyz"), spread.alias("spread"), F.greatest(spread * 1.2, F.lit(150.0)).alias("dist"))


def bars(timeline: DataFrame) -> DataFrame:
    """(month, cluster, place, height, bottom) of a timeline (month, cluster, n; cluster -1 is the total): a month is as high as its part
    of the largest month, and its clusters are stacked from the most frequent on, ties by number."""
    months = timeline.where("cluster = -1")
    top = F.broadcast(months.agg(F.max("n").alias("top")))
    part = timeline.where("cluster <> -1").crossJoin(top).withColumn("height", F.col("n") / F.col("top"))
    by = Window.partitionBy("month").orderBy(F.desc("n"), "cluster")
    below = by.rowsBetween(Window.unboundedPreceding, -1)
    return part.select("month", "cluster", F.row_number().over(by).alias("place"), "height", F.coalesce(F.sum("height").over(below), F.lit(0.0)).alias("bottom"))


def page(conversations: DataFrame, shown: int = 10, more: int = 20) -> DataFrame:
    """(id, first, next, left): the first messages, those one click adds, and how many are left then."""
    n = F.size("messages")
    return conversations.select("id", F.slice("messages", 1, shown).alias("first"), F.slice("messages", shown + 1, more).alias("next"), F.greatest(n - shown - more, F.lit(0)).alias("left"))
