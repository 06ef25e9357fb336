"""Every query against its SQL on the small tables, and readers on small exports."""

from __future__ import annotations

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.plans import registry
from lorekeep.sources import exports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr([None if pd.isna(x) else float(x) if not isinstance(x, str) and not hasattr(x, "isoformat") else str(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


def test_read_grok_tells_every_turn(spark, duck):
    """A turn that is left out of both the query and its SQL would not show in their comparison."""
    want = dict(duck.execute("SELECT conv_id, count(*) FROM conversations WHERE trim(text) <> '' GROUP BY 1").fetchall())
    assert {r.id: r.n for r in registry.queries()["read_grok"](spark, SF).collect()} == want
    assert {i: n for i, n, _ in duck.execute(registry.oracle_sql()["read_grok"]).fetchall()} == want


@pytest.mark.parametrize("few", [1 << 20, 20])
def test_degree_cap_equals_a_scan(spark, few):
    from lorekeep.operators.similarity import accepted

    import random

    r = random.Random(1)
    edges = [(a, b, r.randint(1, 30) / 10) for a in range(25) for b in range(a + 1, 25)]
    degree, want = dict.fromkeys(range(25), 0), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree[a] < 4 and degree[b] < 4:
            degree[a], degree[b] = degree[a] + 1, degree[b] + 1
            want.add((a, b, w))
    assert {tuple(x) for x in accepted(spark.createDataFrame(edges, "a int, b int, w double"), 4, few=few).collect()} == want


def test_readers(spark, tmp_path):
    chat = [{"uuid": "u1", "name": "n", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [{"sender": "human", "text": " hi ", "created_at": "t1"}, {"sender": "x", "content": [{"type": "text", "text": "yo", "start_timestamp": "t2"}]}, {"sender": "human", "text": "  "}]}, {"uuid": "u2", "chat_messages": []}]
    (tmp_path / "a.json").write_text(json.dumps(chat))
    got = exports.read(spark, "claude", str(tmp_path / "a.json")).collect()
    assert [(r.id, [tuple(m) for m in r.messages]) for r in got] == [("u1", [("user", "hi", "t1"), ("assistant", "yo", "t2")])]
    odd = [{"uuid": "u3", "messages": [{"role": "user", "content": "plain string"}, {"role": "assistant", "content": ["s1", {"type": "image"}, {"type": "text", "text": "t2"}], "timestamp": "t3"}, {"sender": "human", "text": ["a", {"type": "text", "text": "b"}]}, {"sender": "human", "text": "", "content": "not this"}]}]
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    got = exports.read(spark, "claude", str(tmp_path / "odd.json")).collect()
    assert [[tuple(m) for m in r.messages] for r in got] == [[("user", "plain string", ""), ("assistant", "s1 t2", "t3"), ("user", "a b", "")]]
    node = lambda parent, who, text: {"parent": parent, "message": {"author": {"role": who}, "content": {"content_type": "text", "parts": [text]}, "create_time": 1.5}}
    tree = {"id": "c", "title": "New chat", "create_time": 0, "current_node": "d", "mapping": {"a": {"parent": "d"}, "b": node("a", "user", "q"), "c": node("b", "assistant", "side"), "d": node("b", "assistant", "ans")}}
    (tmp_path / "c.json").write_text(json.dumps([tree]))
    got = exports.read(spark, "chatgpt", str(tmp_path / "c.json")).collect()
    assert [(r.id, r.name, [m.text for m in r.messages]) for r in got] == [("c", "Untitled", ["q", "ans"])]
    assert got[0].messages[0].timestamp == "1970-01-01T00:00:01.500000+00:00"
    parts = lambda parent, who, *p: {"parent": parent, "message": {"author": {"role": who}, "content": {"content_type": "text", "parts": list(p)}}}
    trees = [{"id": f"i{k}", "current_node": "d", "mapping": {"a": parts(None, "user", {"asset": 1}, "x"), "b": parts("a", "user", "hi", {"asset": 1}, "you"), "c": parts("b", "user", 5), "d": parts("c", "tool", "no")}} for k in range(4)]
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards/conversations-000.json").write_text(json.dumps([trees[1], trees[0]]))
    (tmp_path / "shards/conversations-001.json").write_text(json.dumps([trees[0], trees[3], trees[2]]))
    got = exports.read_chatgpt(spark, str(tmp_path / "shards")).collect()
    assert {r.id: [m.text for m in r.messages] for r in got} == {f"i{k}": ["hi you"] for k in range(4)}
    assert {r.id for r in exports.read_chatgpt(spark, str(tmp_path / "shards"), 3).collect()} == {"i1", "i0", "i3"}
    assert exports.unite(*(exports.read_chatgpt(spark, str(tmp_path / "shards")),) * 2).count() == 8
    (tmp_path / "b.json").write_text(json.dumps({"conversations": [{"uuid": "z", "chat_messages": [{"role": "user", "text": "a"}]}]}))
    assert [(r.id, r.name) for r in exports.read(spark, "abacus", str(tmp_path / "b.json")).collect()] == [("abacus_z", "Abacus chat")]
    with pytest.raises(ValueError, match="available"):
        exports.read(spark, "none", "x")


def test_branches_of_trees(spark):
    """Branches as a walk finds them: side branches, parents that are missing, cycles, no nodes, and a chain of 3,000."""
    import random

    r = random.Random(7)
    trees = [("none", "a", None), ("empty", "a", {}), ("lost", "z", {"a": None}), ("start", None, {"a": None}), ("self", "a", {"a": "a"}), ("null", "b", {"a": None, "b": "a"})]
    for i in range(60):
        n = r.randint(1, 40)
        trees.append((f"t{i}", f"n{r.randrange(n)}", {f"n{k}": r.choice([f"n{r.randrange(n + 2)}", f"n{max(0, k - 1)}", None]) for k in range(n)}))
    trees.append(("chain", "n2999", {f"n{k}": f"n{k - 1}" for k in range(3000)}))

    def plain(at, up):
        seen = {}
        while at in up and at not in seen:
            seen[at] = True
            at = up[at]
        return list(seen)[::-1]

    df = spark.createDataFrame(trees, "id string, current_node string, up map<string, string>")
    got = exports._branches(df.withColumn("mapping", F.transform_values("up", lambda _, p: F.struct(p.alias("parent"))))).select("id", F.transform("branch", lambda i: F.get("keys", i - 1)).alias("b")).collect()
    assert {x.id: x.b or [] for x in got} == {i: plain(at, up or {}) for i, at, up in trees}


def test_chunks_of_paragraphs(spark):
    from lorekeep.functions.text import chunk_paragraphs

    def plain(text, size):
        if len(text.split()) <= size:
            return [text]
        parts = [p.strip() for p in text.split("\n\n") if p.strip()]
        windows = lambda t: [" ".join(t.split()[i : i + size]) for i in range(0, len(t.split()), size)]
        if len(parts) < 2:
            return windows(text)
        out, held = [], []
        for p in parts:
            if held and (len(p.split()) > size or sum(len(h.split()) for h in held) + len(p.split()) > size):
                out, held = [*out, "\n\n".join(held)], []
            if len(p.split()) > size:
                out += windows(p)
            else:
                held.append(p)
        return out + (["\n\n".join(held)] if held else [])

    import random

    r = random.Random(2)
    texts = ["", "a b", "a b c d e f g"] + ["\n\n".join(" ".join("w%d" % r.randint(0, 9) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 7))) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk_paragraphs(F.col("t"), 5).alias("c")).collect()
    assert {g.i: g.c for g in got} == {i: plain(t, 5) for i, t in enumerate(texts)}
