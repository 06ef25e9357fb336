"""The capped graph is that of the exact percentile, built or grown."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from lorekeep.operators import similarity

from .test_versions import frame, plain_edges, points


def _edges(graph):
    return {(e.a, e.b) for e in graph.edges.collect()}


def test_cosines_that_share_a_bin(spark):
    """40 nodes whose 780 cosines are within a millionth; a percentile of bins takes all of them or none."""
    rows = []
    for k, angle in enumerate(1 + np.random.default_rng(1).uniform(0, 4e-7, 40)):
        v = np.zeros(41)
        v[0], v[k + 1] = np.cos(angle), np.sin(angle)
        rows.append((k, v.tolist()))
    want, cut = plain_edges(rows, p=0.5, cap=50)
    graph = similarity.build(frame(spark, rows), p=0.5, cap=50)
    assert len(want) == 390 and _edges(graph) == want and abs(graph.cut - cut) < 1e-12
    few = rows[:30]
    grown = similarity.extend(similarity.build(frame(spark, few), p=0.5, cap=50), frame(spark, few), frame(spark, rows), spark.createDataFrame([(k,) for k in range(30, 40)], "id int"), p=0.5, cap=50)
    assert _edges(grown) == want and grown.cut == graph.cut


@pytest.mark.parametrize("seed", [4, 5])
def test_nodes_that_lose_an_edge_to_a_changed_one(spark, seed, monkeypatch):
    """F2, F8: a node beside a changed one has room again when that takes nearer ones, in this band and those below."""
    monkeypatch.setattr(similarity, "FIRST", 1)
    monkeypatch.setattr(similarity, "NEXT", 2)
    r = np.random.default_rng(seed)
    rows = points(r, 160)
    new = [(500 + k, (np.array(rows[k][1]) + r.normal(size=6) * 0.02).tolist()) for k in range(0, 160, 8)]
    after = [x for x in rows if x[0] % 20 != 3] + new
    stale = spark.createDataFrame([(i,) for i, _ in new] + [(i,) for i in range(3, 160, 20)], "id int")
    grown = similarity.extend(similarity.build(frame(spark, rows), cap=2), frame(spark, rows), frame(spark, after), stale, cap=2)
    assert _edges(grown) == plain_edges(after, cap=2)[0]


def test_capped_edges_come_in_bands(spark, monkeypatch):
    """a scan gets the edges of a band, where all over the percentile were written before."""
    from lorekeep.plans import registry

    from .test_queries import SF

    scan, seen = similarity.accepted, []
    monkeypatch.setattr(similarity, "FIRST", 1)
    monkeypatch.setattr(similarity, "accepted", lambda edges, *a: seen.append(edges.count()) or scan(edges, *a))
    got = {tuple(e) for e in registry.queries()["edges_degree_capped"](spark, SF).collect()}
    embeddings = registry._t(spark, SF, "embeddings").toArrow()
    want = duckdb.connect().register("embeddings", embeddings).execute(registry.oracle_sql()["edges_degree_capped"]).fetchall()
    assert got == set(want) and len(seen) > 1 and max(seen) < registry._edges(spark, SF).count()


def test_growing_scans_bands_of_weight(spark, monkeypatch):
    """F8: most nodes have an edge with a changed one; their pairs over the percentile were all written before."""
    monkeypatch.setattr(similarity, "FIRST", 1)
    monkeypatch.setattr(similarity, "NEXT", 2)
    rows = points(np.random.default_rng(9), 150)
    before, stale = rows[:135], spark.createDataFrame([(i,) for i, _ in rows[135:]], "id int")
    graph = similarity.build(frame(spark, before), p=0.5, cap=6)
    scan, seen = similarity.accepted, []
    monkeypatch.setattr(similarity, "accepted", lambda edges, *a: seen.append(edges.count()) or scan(edges, *a))
    grown = similarity.extend(graph, frame(spark, before), frame(spark, rows), stale, p=0.5, cap=6)
    assert _edges(grown) == plain_edges(rows, p=0.5, cap=6)[0]
    assert grown.work["repaired"] > 75 and max(seen) < 150 * 149 // 2 * 0.25
