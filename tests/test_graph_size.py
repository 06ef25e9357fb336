"""Queries over all pairs keep no pairs on disk, and give what a plain version does, ties included."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import cosines, graph
from lorekeep.operators.common import shared_dir


def _held(spark) -> int:
    """Bytes in the application's shared folder."""
    return sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*.parquet"))


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 16)).round(3))]
    rows += [(1000 + i, v) for i, v in rows[:60]]  # copies, so that weights tie
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def edges(vectors):
    """(a, b, w) over the percentile, by a plain matrix; rounded to six decimals, as the SQL sums in another order."""
    rows = sorted((x.id, x.vector) for x in vectors.collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.round(x @ x.T, 12)
    i, j = np.triu_indices(len(x), 1)
    some = w[i, j] > np.quantile(w[i, j], 0.95)
    return [(rows[a][0], rows[b][0], w[a, b]) for a, b in zip(i[some], j[some], strict=True)]


def _six(rows):
    return {(a, b, round(w, 6)) for a, b, w in rows}


def test_pairs_of_blocks_are_not_written(spark, vectors):
    """F1, F4 to F7: of 29 blocks the 435 pairs were written, 29 times the vectors."""
    before = _held(spark)
    blocks = graph._blocks(vectors, 16)
    once = vectors.count() * 16 * 8
    assert blocks.count() >= 29 * 30 // 2 - 29 and _held(spark) - before < 4 * once


def test_places_by_weight(spark, vectors, edges, monkeypatch):
    """places over many ranges, with ties, of edges that are written nowhere."""
    monkeypatch.setattr(graph, "RANGE", 50)
    monkeypatch.setattr(graph, "WEIGHTS", 64)
    found = graph.over_percentile(vectors, block=64)
    before = _held(spark)
    placed = graph.by_weight(found)
    got = sorted((e.place, e.a, e.b) for e in placed.collect())
    assert _held(spark) == before
    want = sorted(((e.w, e.a, e.b) for e in found.collect()), key=lambda e: (-e[0], e[1], e[2]))
    assert got == [(k, a, b) for k, (_, a, b) in enumerate(want, 1)] and _six((a, b, w) for w, a, b in want) == _six(edges)
    one = spark.createDataFrame([(3, 4, 0.5), (1, 2, 0.5)], "a long, b long, w double")
    assert sorted((e.place, e.a) for e in graph.by_weight(one).collect()) == [(1, 1), (2, 3)] and graph.by_weight(one.limit(0)).count() == 0


def test_cosines_as_the_sql_has_them(spark):
    """the twelfth decimal decides the places of near ties."""
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(700, 64)).astype(np.float32))]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {(e.a, e.b): e.w for e in graph.over_percentile(df, 0.5, block=200).collect()}
    c = duckdb.connect()
    table = df.toArrow()  # noqa: F841
    want = c.execute("""WITH u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (SELECT id, vector::DOUBLE[] AS v FROM "table")),
pr AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v), 12) AS w FROM u a JOIN u b ON a.id < b.id) SELECT * FROM pr WHERE w > (SELECT quantile_cont(w, 0.5) FROM pr)""").fetchall()
    assert got == {(a, b): w for a, b, w in want}


@pytest.mark.parametrize("k", [1, 3])
def test_heaviest_edges_leave_the_rest_in_their_tasks(spark, vectors, edges, k, monkeypatch):
    """edges among the k heaviest of an end, ties by a, b; tasks hand on few more, where all edges were sorted by node before."""
    seen, pairs = [], graph._pairs
    monkeypatch.setattr(graph, "_pairs", lambda *a: seen.append(pairs(*a)) or seen[-1])
    got = _six((e.a, e.b, e.w) for e in graph.top_over_percentile(vectors, k, block=64).collect())
    plain, want = sorted(((a, b, round(w, 11)) for a, b, w in edges), key=lambda e: (-e[2], e[0], e[1])), set()
    for node in {x for a, b, _ in edges for x in (a, b)}:
        want |= set([e for e in plain if node in e[:2]][:k])
    assert got == _six(want) and seen[0].count() < len(edges) * 0.9


def test_edges_of_some_nodes(spark, vectors, edges, monkeypatch):
    """only the nodes' pairs are made, where all edges were joined with them before; the percentile is that of all."""
    some = spark.createDataFrame([(i,) for i in range(0, 1100, 3)], "id long")
    found = graph.over_percentile(vectors, block=64, nodes=some)
    assert _six((e.a, e.b, e.w) for e in found.collect()) == _six(e for e in edges if e[0] % 3 == e[1] % 3 == 0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().replace("CartesianProduct", "")


def test_summary_without_edges(spark, vectors, edges):
    """one row, also of no pairs, from tasks that keep no edges."""
    got = graph.summary_over_percentile(vectors, block=64).first()
    w = [x for _, _, x in edges]
    assert got.n == len(w) and abs(got.low - min(w)) < 1e-11 and abs(got.high - max(w)) < 1e-11
    assert tuple(graph.summary_over_percentile(vectors.limit(1)).first()) == (0, None, None)
