"""Versions, streams of files, the growing graph and the threshold search against whole rebuilds."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.engine import EMPTY, MemoryEngine
from lorekeep.operators import search, similarity
from lorekeep.operators.common import scratch, shared_dir, written
from lorekeep.sources import exports
from lorekeep.streaming.ingest import stream_ingest


def left(spark):
    from pathlib import Path

    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def talk(i, word, at="2024-01-01"):
    return {"uuid": f"c{i:03}", "name": f"about {word}", "created_at": at, "chat_messages": [{"sender": "human", "text": f"tell me of {word} number {i}"}, {"sender": "assistant", "text": f"{word} is fine"}]}


WORDS = ["bread", "soup", "boats", "engines", "gliders", "maps"]


def convs(spark, tmp_path, rows):
    path = tmp_path / f"in{random.random()}.json"
    path.write_text(json.dumps(rows))
    return exports.read(spark, "claude", str(path))


def state(engine):
    """All that the engine has of its conversations, whatever files it lies in."""
    pick = {"conversations": ["id", "name", "sha"], "chunks": ["id", "chunk_id", "text"], "vectors": ["id", "vector"], "lengths": ["id", "len"], "edges": ["a", "b", "w"]}
    return {t: sorted(map(repr, engine.table(t).select(*c).collect())) for t, c in pick.items()} | {"found": [(h["id"], round(h["score"], 9), round(h["lexical_score"], 9), h["excerpt"]) for h in engine.search("boats number 7", 4)]}


def test_versions_share_buckets_and_vacuum(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "root"), buckets=8)
    rows = [talk(i, WORDS[i % 6]) for i in range(40)]
    before = left(spark)
    first = engine.ingest(convs(spark, tmp_path, rows), k=3)
    again = convs(spark, tmp_path, rows[:5])
    held = left(spark)
    assert engine.ingest(again, k=3) == first == engine.version()  # nothing new, nothing written
    changed = [talk(3, "gliders", "2024-02-01"), talk(77, "maps")]
    assert engine.ingest(convs(spark, tmp_path, changed), k=3) != first
    folders = lambda v: {p.folder for p in engine.store.parts(v) if p.name == "conversations"}
    assert len(folders(engine.version()) - folders(first)) <= 2 and len(folders(engine.version()) & folders(first)) >= 5
    other = MemoryEngine(spark, str(tmp_path / "other"), buckets=8)
    other.ingest(convs(spark, tmp_path, [*(r for r in rows if r["uuid"] != "c003"), *changed]), k=3)
    engine.search("soup", 2)
    assert state(engine) == state(other)
    old = engine.recluster(2)
    assert folders(old) == folders(engine.version())
    (tmp_path / "root/data/leftover").mkdir()
    gone = engine.vacuum()
    assert any("leftover" in g for g in gone) and any(first in g for g in gone) and state(engine)["vectors"] == state(other)["vectors"]
    assert engine.vacuum() == []
    assert len(left(spark) - held) <= 10 and len(held - before) <= 6  # the exports' records; what writes and searches needed is gone


def test_segments_of_the_index_are_merged(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "root"), buckets=4)
    engine.SEGMENTS = 2
    rows = [talk(i, WORDS[i % 6]) for i in range(6)]
    for i in range(4):
        engine.ingest(convs(spark, tmp_path, [rows[i], talk(0, WORDS[i + 1], f"2024-03-0{i + 1}")]), k=1)
    assert len([p for p in engine.store.parts(engine.version()) if p.name == "index"]) <= 2
    one = MemoryEngine(spark, str(tmp_path / "one"), buckets=4)
    one.ingest(engine.table("conversations"), k=1)
    ask = lambda e: [(h["id"], round(h["lexical_score"], 9)) for h in e.search("gliders number boats", 6)]
    assert ask(engine) == ask(one)


@pytest.mark.parametrize("fault", ["timeline", "pointer"])
def test_killed_streams_end_as_a_batch(spark, tmp_path, fault):
    folder = tmp_path / "exports"
    folder.mkdir()
    rows = [talk(i, WORDS[i % 6]) for i in range(12)]
    for n in range(3):
        (folder / f"{n}.json").write_text(json.dumps(rows[n * 4 : n * 4 + 5]))
    steps = []

    def broken(name, done, total):
        steps.append(name)
        if name == fault and steps.count(name) == 2:
            raise RuntimeError("killed")

    def run(progress):
        engine = MemoryEngine(spark, str(tmp_path / "root"), progress=progress, buckets=4)
        if progress and fault == "pointer":  # killed after the pointer, before the checkpoint knows
            ingest = engine.ingest
            engine.ingest = lambda *a, **k: (ingest(*a, **k), broken("pointer", 0, 0))
        query = stream_ingest(engine, "claude", str(folder), str(tmp_path / "checkpoint"), k=2, files_a_batch=1)
        query.awaitTermination()
        return engine

    with pytest.raises(Exception, match="killed"):
        run(broken)
    versions = MemoryEngine(spark, str(tmp_path / "root")).store.pointers("current").count()
    assert versions == (2 if fault == "pointer" else 1)
    engine = run(None)
    whole = MemoryEngine(spark, str(tmp_path / "whole"), buckets=4)
    whole.ingest(convs(spark, tmp_path, rows), k=2)
    assert state(engine) == state(whole) and engine.store.pointers("current").count() == 3
    assert run(None).store.pointers("current").count() == 3  # no new files


def plain_edges(rows, p=0.95, cap=15):
    ids = [i for i, v in rows if v is not None]
    x = np.array([v for _, v in rows if v is not None]).reshape(len(ids), -1 if ids else 0)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    x = x / np.where(n == 0, 1, n)
    w = np.round(x @ x.T, 12)
    pairs = [(w[i, j], *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i + 1, len(ids))]
    cut = np.quantile([q[0] for q in pairs], p) if pairs else 0
    room, out = dict.fromkeys(ids, cap), set()
    for s, a, b in sorted(pairs, key=lambda q: (-q[0], q[1], q[2])):
        if s > cut and room[a] and room[b]:
            room[a], room[b] = room[a] - 1, room[b] - 1
            out.add((a, b))
    return out, cut


def points(r, n, dim=6):
    centres = r.normal(size=(5, dim))
    return [(i, (centres[r.integers(5)] + r.normal(size=dim) * r.choice([0.05, 1.0])).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, vector array<double>")


def test_graphs_equal_a_scan(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [*points(r, 260), (900, [0.0] * 6), (901, None), (902, [1.0] * 6), (903, [2.0] * 6)]
    whole = similarity.accepted
    for first, few in ((4, 1 << 20), (1, 0)):  # one band and a scan, and several in rounds
        monkeypatch.setattr(similarity, "accepted", lambda *a, few=few: whole(*a, few=few))
        monkeypatch.setattr(similarity, "FIRST", first)
        monkeypatch.setattr(similarity, "NEXT", 1.3)
        graph = similarity.build(frame(spark, rows), cap=3)
        want, cut = plain_edges(rows, cap=3)
        assert abs(graph.cut - cut) < 2e-6 and {(e.a, e.b) for e in graph.edges.collect()} == want
        assert graph.work["bands"] > 1 or first == 4
    for few in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.5])]):
        assert {(e.a, e.b) for e in similarity.build(frame(spark, few)).edges.collect()} == plain_edges(few)[0]


def test_far_tiles_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PER_WAY", 1)
    r = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] + r.normal(size=8) * 0.02).tolist()) for i in range(400)]
    graph = similarity.build(frame(spark, rows), cap=5)
    assert graph.work["skipped"] > graph.work["tile_pairs"] / 3
    assert {(e.a, e.b) for e in graph.edges.collect()} == plain_edges(rows, cap=5)[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_grown_graphs_equal_rebuilt_ones(spark, seed):
    r = np.random.default_rng(seed)
    rows = points(r, 150)
    graph = similarity.build(frame(spark, rows), cap=3)
    for step in range(2):
        gone, changed = {int(i) for i in r.choice(100, 4, replace=False)}, {int(i) for i in r.choice(range(100, 150), 3, replace=False)}
        new = [(1000 * (step + 1) + i, v) for i, v in points(r, 5)]
        after = [(i, (np.array(v) + r.normal(size=6)).tolist() if i in changed else v) for i, v in rows if i not in gone] + new
        stale = spark.createDataFrame([(i,) for i in gone | changed | {i for i, _ in new}], "id int")
        graph = similarity.extend(graph, frame(spark, rows), frame(spark, after), stale, cap=3)
        want, cut = plain_edges(after, cap=3)
        assert {(e.a, e.b) for e in graph.edges.collect()} == want and abs(graph.cut - cut) < 2e-6
        assert graph.counts.agg(F.sum("n")).first()[0] == len(after) * (len(after) - 1) // 2
        rows = after


@pytest.mark.parametrize("seed", range(4))
def test_threshold_search_equals_whole_ranks(spark, seed):
    r = random.Random(seed)
    score = lambda: r.choice([r.uniform(-1, 1), r.randint(-2, 3) / 3])
    semantic = spark.createDataFrame([(i, score()) for i in range(600)], "doc_id int, score double")
    chunks = spark.createDataFrame([(r.randrange(650), j, score()) for j in range(1500)], "doc_id int, chunk_id int, score double")
    lexical = spark.createDataFrame([(i, abs(score())) for i in r.sample(range(700), 250)], "doc_id int, score double")
    best = chunks.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("c"))).alias("b")).select("doc_id", "b.score", (-F.col("b.c")).alias("chunk_id"))
    want = [(h.doc_id, round(h.rrf, 12)) for h in search.fuse(semantic, best, lexical).orderBy(F.desc("rrf"), F.desc("doc_id")).limit(7).collect()]
    got, work = search.top_fused(semantic, chunks, lexical, 7, depth=16)
    assert [(h.doc_id, round(h.rrf, 12)) for h in got] == want
    full, _ = search.top_fused(semantic, chunks, lexical, 7)
    assert got == full and work["rows_read"] < 1100


def test_scratch_goes_with_its_block(spark):
    before = left(spark)
    with scratch(spark):
        inside = written(spark.range(3))
        assert inside.count() == 3 and len(left(spark) - before) == 1
    assert left(spark) == before


def test_texts_without_users_and_empty_sources(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "root"), buckets=2)
    engine.ingest(spark.createDataFrame([], EMPTY))
    assert engine.ingest(spark.createDataFrame([("a", "name", "", "p", [("assistant", "x", "")])], EMPTY), k=1)
    assert [h["id"] for h in engine.search("name")] == ["a"]
    assert engine.ingest(spark.createDataFrame([], EMPTY), mode="replace") and engine.stats()["totalConversations"] == 0
