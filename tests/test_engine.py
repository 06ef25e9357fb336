"""Clusters, layout, compact export, notes and the engine on small data."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest

from lorekeep.engine import EMPTY, MemoryEngine
from lorekeep.operators import clustering, compact, notes
from lorekeep.operators.common import numbered


def blobs(spark, groups=3, each=8, dim=6):
    r = random.Random(5)
    rows = [(g * each + i, [(3.0 if d == g else 0.0) + r.gauss(0, 0.1) for d in range(dim)]) for g in range(groups) for i in range(each)]
    return spark.createDataFrame(rows, "id int, vector array<double>"), rows


def test_kmeans_finds_groups(spark):
    df, rows = blobs(spark)
    got = {r.id: r.cluster for r in clustering.kmeans(df, 3, seeds=(42, 43)).collect()}
    assert len(got) == len(rows) and [len({got[g * 8 + i] for i in range(8)}) for g in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    k, found = clustering.sweep(df, 2, 4, seeds=(42,))
    assert k == 3 and found.count() == len(rows)


def test_kmeans_of_zero_and_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id int, vector array<double>")
    assert [r.cluster for r in clustering.kmeans(df, 2).collect()] == [0, 0]
    assert clustering.sweep(df)[0] == 1
    assert {r.cluster for r in clustering.kmeans(df.union(spark.createDataFrame([(3, [1.0, 0.0])], df.schema)), 1).collect()} == {0}
    assert clustering.kmeans(df.where("id > 9"), 2).count() == 0
    mixed = df.union(spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 2.0])], df.schema))
    got = {r.id: r.cluster for r in clustering.kmeans(mixed, 2, seeds=(42,)).collect()}
    assert got[1] == got[2] == 0 and got[4] == got[5] != got[3]


def test_components_equal_a_decomposition(spark):
    df, rows = blobs(spark)
    x = np.array([v for _, v in rows])
    x = x - x.mean(axis=0)
    v = np.linalg.svd(x, full_matrices=False)[2][:3].T
    want = x @ (v * np.where(v[abs(v).argmax(axis=0), range(3)] > 0, 1, -1))
    got = np.array([r.p for r in clustering.components(df).orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-9)
    top = np.array([r.p for r in clustering.scaled(clustering.components(df)).collect()])
    assert abs(top).max() == pytest.approx(100)
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, vector array<double>")
    assert [r.p for r in clustering.scaled(clustering.components(flat)).collect()] == [[0.0, 0.0, 0.0]] * 2


def test_layout_and_labels(spark):
    df, rows = blobs(spark)
    items = spark.createDataFrame([(i, "2024-01-01T00:00:00" if i else "?", f"topic{'abc'[i // 8]} talk", f"about gadget{'abc'[i // 8]}") for i, _ in rows], "id int, created_at string, name string, first_message string")
    got = {r.id: r for r in clustering.layout(df, items).collect()}
    assert got[0].tx == -100 and got[1].tx == 100 and len(got) == len(rows)
    assert max(max(abs(r.ty), abs(r.tz)) for r in got.values()) == pytest.approx(80)
    members = clustering.kmeans(df, 3, seeds=(42,))
    found = {r.label: (r.n, r.color) for r in clustering.labels(members, items, 6).collect()}
    assert len(found) == 3 and all(n == 8 for n, _ in found.values()) and all(" / " in label for label in found)
    bare = clustering.labels(members, items.selectExpr("id", "'' as name", "'' as first_message"), 6)
    assert {r.label for r in bare.collect()} == {"Cluster 0", "Cluster 1", "Cluster 2"}


def test_numbered(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(7)
    from pyspark.sql import functions as F

    got = {x.id: x.at for x in numbered(df, [F.desc("x"), F.col("id")], "at").collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda p: (-p[1], p[0])))}


def test_compact(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "a  \n" + "b" * 200, "p", "2024-01-01", i % 2, 3, ["t" * 30], None, 1.234, None, 0.0, 0.0, 0.0, 0.0) for i in range(5)], "id string, name string, provider string, date string, cluster int, n_messages int, terms array<string>, snippet string, x double, y double, z double, tx double, ty double, tz double")
    edges = spark.createDataFrame([("n0", "n1", 0.5), ("n1", "n0", 0.9), ("n0", "n0", 1.0), ("n0", "gone", 1.0), ("n0", "n2", 0.8), ("n3", "n4", 0.11111), ("n1", "n2", 0.1)], "a string, b string, w double")
    bundle = compact.compact(nodes, edges, per_node=1)
    assert bundle["counts"].first().asDict() == {"edges_in": 7, "edges_unresolved": 2, "edges_kept": 3, "nodes": 5}
    assert {tuple(r) for r in bundle["edges"].collect()} == {(0, 1, 0.9), (0, 2, 0.8), (3, 4, 0.111)}
    first = bundle["nodes"].where("idx = 0").first()
    assert (first.n, first.t, first.s, first.x, first.y) == ("a " + "b" * 118, ["t" * 24], "", 1.23, 0.0)
    compact.write(bundle, str(tmp_path / "out"), ("n0", first.n))
    with pytest.raises(ValueError, match="no node"):
        compact.write(bundle, str(tmp_path / "out"), ("n0", "other"))


def test_notes(spark, tmp_path):
    store = notes.Notes(spark, str(tmp_path / "notes"), keep=2)
    assert store.table().count() == 0
    one, two = store.add("c", " a "), store.add("c", "b")
    assert [r.text for r in store.of("c").collect()] == [" a ", "b"]
    assert store.delete("c", one["note_id"]) and not store.delete("c", one["note_id"]) and not store.delete("d", two["note_id"])
    store.restore(spark.createDataFrame([("c", two["note_id"], "b", "t"), ("e", "n9", "x", "t")], notes.NOTE))
    assert sorted((r.conv_id, r.text) for r in store.table().collect()) == [("c", "b"), ("e", "x")]
    for _ in range(3):
        last = store.backup()
    assert spark.read.parquet(last).count() == 2 and len(list((tmp_path / "notes/backups").iterdir())) == 2
    (tmp_path / "n.json").write_text(json.dumps({"c": [{"note_id": "1", "text": "t", "created_at": "x"}], "d": []}))
    assert [tuple(r) for r in notes.read_sidecar(spark, str(tmp_path / "n.json"))[0].collect()] == [("c", "1", "t", "x")]
    (tmp_path / "n.json").write_text("{torn")
    got, bad = notes.read_sidecar(spark, str(tmp_path / "n.json"))
    assert got.count() == 0 and bad.count() == 1
    assert notes.read_sidecar(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_assign_and_older_notes(spark, tmp_path):
    df, rows = blobs(spark)
    members = clustering.kmeans(df, 3, seeds=(42,))
    of = {r.id: r.cluster for r in members.collect()}
    new = spark.createDataFrame([(100 + g, [2.0 if d == g else 0.1 for d in range(6)]) for g in range(3)], df.schema)
    assert {r.id: r.cluster for r in clustering.assign(new, members, 6).collect()} == {100 + g: of[g * 8] for g in range(3)}
    old = spark.createDataFrame([("a", [("n1", "t", "x")]), ("b", []), ("c", None)], "id string, notes array<struct<note_id: string, text: string, created_at: string>>")
    assert [tuple(r) for r in notes.legacy_notes(old).collect()] == [("a", "n1", "t", "x")]


def chats(spark, rows):
    return spark.createDataFrame([(i, n, at, p, [{"role": "user", "text": q, "timestamp": at}, {"role": "assistant", "text": a, "timestamp": at}]) for i, n, at, p, q, a in rows], EMPTY)


def test_engine(spark, tmp_path):
    rows = [(f"c{i}", f"{word} notes", f"2024-0{i + 1}-01T00:00:00", "claude" if i % 2 else "grok", f"tell me about {word} recipes number {i}", f"{word} is fine") for i, word in enumerate(("bread", "bread", "soup", "engines", "engines", "boats"))]
    engine = MemoryEngine(spark, str(tmp_path / "root"))
    with pytest.raises(FileNotFoundError):
        engine.table("nodes")
    first = engine.ingest(chats(spark, rows), k=2)
    assert engine.version() == first
    hits = engine.search("bread recipes", 2)
    assert {h["id"] for h in hits} == {"c0", "c1"} and hits[0]["excerpt"].startswith("tell me about bread") and hits[0]["notes_count"] == 0
    assert [h["provider"] for h in engine.search("bread recipes", 2, "claude")] == ["claude"] * 2
    assert engine.search("  ") == [] and len(engine.search("???", 3)) == 3
    note = engine.add_note("c1", "good")["note"]
    assert engine.add_note("x", "good")["error"] and engine.add_note("c1", " ")["error"] and engine.delete_note("c1", "x")["error"]
    assert engine.get("c1")["notes"][0]["text"] == "good" and engine.get("")["error"] and engine.get("x")["error"]
    assert engine.list("x", None)["limit"] == 20 and len(engine.recent("x")) == 6 and len(engine.search("bread", 0)) == 5
    assert engine.stats()["dateRange"] == ["2024-01-01", "2024-06-01"] and engine.stats()["embeddingDim"] == 256
    page = engine.list(0, 2, "date")
    assert [c["id"] for c in page["conversations"]] == ["c5", "c4"] and page["total"] == 6
    assert {c["id"]: c["has_notes"] for c in engine.list(0, 50)["conversations"]}["c1"]
    assert [c["id"] for c in engine.recent(5, before="2024-03-01T00:00:00")] == ["c1", "c0"]
    assert engine.delete_note("c1", note["note_id"])["notes"] == []
    changed = [("c0", "bread notes", "2024-09-01T00:00:00", "grok", "tell me about gliders", "ok"), ("c9", "new", "2024-09-02T00:00:00", "grok", "gliders", "ok")]
    second = engine.ingest(chats(spark, changed), k=2)
    assert second != first and engine.stats()["totalConversations"] == 7 and engine.stats()["providers"] == {"grok": 4, "claude": 3}
    assert {h["id"] for h in engine.search("gliders", 2)} == {"c0", "c9"}
    vectors = {r.id: r.vector for r in engine.table("vectors").collect()}
    assert len(vectors) == 7 and all(math.isclose(sum(x * x for x in v), 1) for v in vectors.values())
    engine.ingest(chats(spark, changed), mode="replace")
    assert engine.stats()["totalConversations"] == 2
    before = engine.version()
    assert engine.recluster(2) == engine.version() != before and engine.stats()["clusterCount"] == 2 and engine.stats()["totalConversations"] == 2
    with pytest.raises(ValueError, match="neither"):
        engine.ingest(chats(spark, changed), mode="x")


def test_engine_of_nothing(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "root"))
    engine.ingest(spark.createDataFrame([], EMPTY))
    assert engine.search("a") == [] and engine.stats()["totalConversations"] == 0


def test_engine_runs(spark, tmp_path):
    """Manifest, trivial sessions, dry runs, reports, sweeps and exports with what is gone."""
    steps = []
    engine = MemoryEngine(spark, str(tmp_path / "root"), progress=lambda *x: steps.append(x))
    assert engine.server_info()["total_conversations"] == 0 and engine.reports().count() == 0
    rows = [(f"c{i}", f"n{i}", f"2024-01-0{i + 1}", "grok", f"question {i}", "a") for i in range(4)]
    silent = spark.createDataFrame([("t", "trivial", "", "grok", [{"role": "assistant", "text": "x", "timestamp": ""}])], EMPTY)
    batch = chats(spark, rows).union(silent)
    plan = engine.update(batch, dry_run=True)
    assert (plan["new"], plan["changed"], plan["unchanged"]) == (5, 0, 0) and engine.version() is None and engine.manifest().count() == 0
    done = engine.update(batch, k=2)
    assert (done["ingested"], done["skipped_trivial"], done["corpus_before"], done["corpus_after"], done["notes_untouched"]) == (4, 1, 0, 4, True)
    assert steps[0] == ("conversations", 1, 9) and steps[-1][1] == steps[-1][2] == 9
    version = engine.version()
    assert engine.update(batch)["action"] == "nothing to do" and engine.version() == version and engine.manifest().count() == 5
    changed = chats(spark, [("c1", "n1", "2024-02-02", "grok", "another question", "a"), ("c0", "n0", "2024-01-01", "grok", "question 0", "a")])
    again = engine.update(changed, k=2)
    assert (again["new"], again["changed"], again["unchanged"], again["corpus_after"]) == (0, 1, 1, 4)
    assert engine.search("another question", 1)[0]["id"] == "c1" and engine.reports().count() == 3
    more = chats(spark, [("c1", "other", "2024-03-01", "claude", "q", "a"), ("d1", "d", "2024-03-02", "claude", "q", "a")])
    both = {"claude": more, "late": chats(spark, [("d1", "dup", "2024-03-03", "late", "q", "a"), ("d2", "d", "", "late", "q", "a")])}
    report = engine.sweep(both, dry_run=True)
    assert [(p["source"], p["n_parsed"], p["n_new"], p["first"]) for p in report["plan"]] == [("claude", 2, 1, "2024-03-02"), ("late", 2, 1, "-")]
    report = engine.sweep(both, k=2)
    assert report["corpus_after"] == 6 and report["provider_before"] == {"grok": 4} and report["provider_after"] == {"grok": 4, "claude": 1, "late": 1}
    assert engine.sweep(both)["action"] == "nothing to ingest"
    export = chats(spark, [*rows[:2], ("e1", "e", "2024-05-01", "grok", "q", "a")])
    assert engine.ingest_export(export, "grok", dry_run=True)["projected_after"] == 7
    got = engine.ingest_export(export, "grok", k=2)
    assert (got["new"], got["absent_from_export"], got["corpus_after"]) == (1, 2, 7)
    assert {r.id for r in spark.read.parquet(got["record"]).collect()} == {"c2", "c3"} and engine.get("c2")["id"] == "c2"
    assert engine.server_info({"grok": "/x"})["total_conversations"] == 7
    for f in (tmp_path / "root/manifests" / engine._pointed("manifest")).glob("*.parquet"):
        f.write_bytes(b"torn")
    assert engine.manifest().count() == 0
    for f in (tmp_path / "root" / engine.version() / "nodes").glob("*.parquet"):
        f.write_bytes(b"torn")
    assert engine.get("c2")["cluster_label"] == "Unknown" and engine.search("another question", 1)[0]["cluster_id"] == 0


def test_messages_without_timestamp(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "root"))
    old = spark.createDataFrame([("a", "n", "", "claude", [("user", "hi", "then", 1)])], "id string, name string, created_at string, provider string, messages array<struct<role: string, text: string, created_at: string, extra: int>>")
    engine.ingest(old)
    assert engine.get("a")["messages"] == [{"role": "user", "text": "hi", "timestamp": "then"}]


def test_stored_index_equals_bm25(spark, tmp_path):
    from lorekeep.operators import lexical

    docs = spark.createDataFrame([("a", "bread soup bread"), ("b", "soup"), ("c", ""), ("d", None), ("e", "boats, Bread")], "doc_id string, text string")
    lexical.write_index(lexical.entries(docs), str(tmp_path / "i"))
    for query in (["bread", "soup", "bread"], ["none"], []):
        got, want = ({r.doc_id: pytest.approx(r.score) for r in df.collect()} for df in (lexical.search_index(spark, str(tmp_path / "i"), query), lexical.bm25(docs, query)))
        assert got == want


def test_command_line(spark, tmp_path, capsys):
    from lorekeep import config
    from lorekeep.__main__ import main

    chat = [{"uuid": f"u{i}", "name": f"about {w}", "created_at": f"2024-01-0{i + 1}", "chat_messages": [{"sender": "human", "text": f"tell me about {w}"}, {"sender": "assistant", "text": "yes"}]} for i, w in enumerate(("bread", "soup", "boats"))]
    (tmp_path / "a.json").write_text(json.dumps(chat))
    (tmp_path / "c.json").write_text(json.dumps({"engine": {"root": str(tmp_path / "root"), "clusters": 2}, "search": {"top_k": 1}, "extra": 1}))
    assert config.load(spark, str(tmp_path / "none.json")) == config.DEFAULTS
    assert config.load(spark, str(tmp_path / "c.json"))["engine"]["least_user_messages"] == 1
    base = ["--config", str(tmp_path / "c.json")]
    assert main([*base, "--source", str(tmp_path / "a.json"), "--dry-run"], spark) == 0
    assert json.loads(capsys.readouterr().out)["new"] == 3
    assert main([*base, "--add-source", "claude", str(tmp_path / "a.json"), "--search", "soup", "--stats"], spark) == 0
    said = capsys.readouterr()
    report, hits, info = map(json.loads, said.out.strip().splitlines())
    assert report["ingested"] == 3 and [h["id"] for h in hits] == ["u1"] and info["total_conversations"] == 3 and "timeline: 9/9" in said.err
