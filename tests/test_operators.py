"""Operators against plain versions on odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import catalog, graph, incremental, views
from lorekeep.streaming import sessions


@pytest.mark.parametrize("kind", ["int", "string"])
def test_pairs_and_their_percentile(spark, kind, monkeypatch):
    """Blocks, few bins and few values at last give the pairs, the cut and its ties as a plain matrix does."""
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(45)] + [(90, [0.0] * 4), (91, None)]
    df = spark.createDataFrame(rows, "id int, vector array<double>").withColumn("id", F.col("id").cast(kind)).repartition(3)
    x = np.array([v for _, v in rows if v])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    w = (x / np.where(n == 0, 1, n)) @ (x / np.where(n == 0, 1, n)).T
    key = (lambda i: i) if kind == "int" else str
    ids = [key(i) for i, v in rows if v]
    want = {tuple(sorted((ids[i], ids[j]))): w[i, j] for i in range(len(ids)) for j in range(i)}
    got = {(e.a, e.b): e.w for e in graph._pairs(graph._blocks(df, 8)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    monkeypatch.setattr(graph, "BINS", 16)
    monkeypatch.setattr(graph, "FEW", 10)
    for p in (0.5, 0.95, 1.0):
        cut = np.quantile(list(got.values()), p)
        kept = {(e.a, e.b) for e in graph.over_percentile(df, p, block=8).collect()}
        assert kept ^ {k for k, v in got.items() if v > cut} <= {k for k, v in got.items() if abs(v - cut) < 1e-12}
    assert graph.over_percentile(df.limit(0)).count() == 0 and graph.over_percentile(df.where("id = 1")).count() == 0


def test_sessions_across_ranges(spark):
    """One user with most events and gaps of just 30 minutes; the same as a plain scan, in a stream as in a batch."""
    r = random.Random(4)
    rows, at = [], {u: 1_700_000_000 for u in (1, 2, 3, None)}
    for i in range(600):
        u = 1 if i % 3 else r.choice([2, 3, None])
        at[u] += r.choice([0, 60, 1800, 1801, 4000])
        rows.append((u, at[u], i))
    df = spark.createDataFrame(rows, "user_id int, s long, event_id int").select("user_id", F.col("s").cast("timestamp").alias("ts"), "event_id", F.lit("x").alias("_p_")).repartition(5)
    want, last, n = {}, {}, {}
    for u, s, i in sorted(rows, key=lambda x: (x[1], x[2])):
        n[u] = n.get(u, 0) + (u not in last or s - last[u] > 1800)
        last[u] = s
        want[i] = n[u]
    out = sessions.sessionise(df)
    assert out.columns == [*df.columns, "session"]
    assert {x.event_id: x.session for x in out.collect()} == want
    assert sum(h.n_events for h in sessions.headers(out).collect()) == 600


def test_stream_of_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 600), (1, 3000), (2, 100), (1, 90000), (2, 90000)]
    df = spark.createDataFrame(rows, "user_id int, s long").select("user_id", (F.col("s") + 1_700_000_000).cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = sessions.stream_sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.user_id, r.n_events) for r in spark.table("sessions_out").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_edges_at_a_percentile(spark):
    weights = [0.1, 0.2, 0.2, 0.3, 0.9, 0.9, 0.9, 1.0]
    df = spark.createDataFrame([(i, i + 1, w) for i, w in enumerate(weights)], "a int, b int, w double")
    for p in (0, 30, 50, 99, 100):
        place = int(len(weights) * p / 100)
        bound = sorted(weights)[place] if place < len(weights) else 0
        assert sorted(e.w for e in graph.at_percentile(df, p).collect()) == sorted(w for w in weights if w >= bound)


def test_views_of_nulls(spark):
    nodes = spark.createDataFrame([(1, "Bread", ["rye"], None, 0, None, "2024-01-31", 2), (2, None, None, "SOUP", None, "grok", "2024-02-01", 1), (3, "x", [], "", 1, "", None, 0)], "id int, name string, terms array<string>, snippet string, cluster int, provider string, date string, pos int")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(views.keyword_hits(nodes, "soup")) == [2] and ids(views.keyword_hits(nodes, "R", 10)) == [1] and ids(views.keyword_hits(nodes, "RYE")) == [1]
    assert ids(views.or_else(views.keyword_hits(nodes, "none"), lambda: nodes.where("id = 3"))) == [3]
    assert ids(views.node_filter(nodes, hidden_providers=["claude"])) == [2] and sorted(ids(views.node_filter(nodes, hidden_clusters=[0]))) == [2, 3]
    assert ids(views.node_filter(nodes, months=("2024-01", "2024-01"))) == [1]
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.1)], "a int, b int, w double")
    assert views.filtered(nodes, edges, hidden_clusters=[1])[1].count() == 1
    hits = spark.createDataFrame([(1, "t", "d", 0.5), (9, "t9", "d9", 0.4)], "id int, title string, date string, score double")
    assert sorted(tuple(r) for r in views.hit_nodes(hits, nodes).collect()) == [(1, "Bread", "2024-01-31", 0.5), (9, "t9", "d9", 0.4)]
    assert views.extent(spark.createDataFrame([], "x double, y double, z double")).count() == 0
    assert views.extent(spark.createDataFrame([(1.0, None, 300.0)], "x double, y double, z double")).first().asDict() == {"cx": 1.0, "cy": 0.0, "cz": 300.0, "spread": 0.0, "dist": 150.0}
    marked = spark.createDataFrame([("A.b*c a.B*C of",)], "t string").select(T.highlight(F.col("t"), "a.b*c of \\E[x", "<", ">").alias("m")).first().m
    assert marked == "<A.b*c> <a.B*C> of"


def test_deltas(spark):
    rows = spark.createDataFrame([("a", 0, 0, "x"), ("a", 1, 0, "y"), ("b", 0, 1, "z"), ("b", 0, 0, "w")], "id string, shard int, pos int, v string")
    assert sorted((r.id, r.v) for r in incremental.last_shard(rows).collect()) == [("a", "y"), ("b", "z")]
    manifest = spark.createDataFrame([("a", "1", "t0"), ("gone", "2", "t0")], "id string, sha string, last_seen string")
    found = spark.createDataFrame([("a", "9"), ("n", "3")], "id string, sha string")
    assert sorted(tuple(r) for r in incremental.next_manifest(manifest, found, "t1").collect()) == [("a", "9", "t1"), ("gone", "2", "t0"), ("n", "3", "t1")]
    items = spark.createDataFrame([("a", "2024-01-01", "p", 3)], "id string, created_at string, provider string, n_messages int")
    assert catalog.same_corpus(items, items) == "match" and catalog.same_corpus(items, items.limit(0)) == "DIVERGED"
