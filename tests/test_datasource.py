"""The data source of a folder of exports, against the readers of each provider."""

from __future__ import annotations

import io
import json
import zipfile
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import datasource, exports


@pytest.fixture
def root(tmp_path):
    flat = [{"uuid": f"u{i}", "id": f"u{i}", "conversation_id": f"k{i}", "name": "n", "chat_messages": [{"sender": "human", "text": 'brace { and "quote\\" ' * i}]} for i in range(30)]
    tree = [{"id": f"t{i}", "title": "T", "current_node": "b", "mapping": {"a": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["q"]}}}, "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["r"]}}}}} for i in range(3)]
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("chats.json", json.dumps(flat[:4]))
    turns = {"chunkedPrompt": {"chunks": [{"role": "user", "text": "q"}, {"role": "model", "text": "a"}]}}
    held = {
        "claude/a.json": json.dumps(flat), "chatgpt/conversations-0.json": json.dumps(tree[:2]), "chatgpt/conversations-1.json": json.dumps(tree), "abacus/x.json": json.dumps({"meta": [1], "conversations": flat[:5], "after": {"a": {}}}), "grok/deep/g.json": json.dumps(tree), "grok/g.zip": zipped.getvalue(),
        "gemini/a.json": json.dumps([{"title": "Prompted x", "time": "2024-01-01T00:00:00Z"}]), "claude-code/s.jsonl": json.dumps({"type": "user", "message": {"content": "hi"}}) + "\n{torn", "notebooklm/N/Chat History/Chat Session - 0a.html": "USER: what\nMODEL: it", "aistudio/chat": json.dumps(turns), "aistudio/list": "[1]",
        "claude/.hidden.json": "[", "claude/readme.md": "x",
    }
    for name, text in held.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return tmp_path / "root"


def told(df):
    return sorted((r.id, r.name, r.created_at, r.provider, [(m.role, m.text) for m in r.messages]) for r in df.collect())


def test_all_providers_through_the_source(spark, root):
    found = told(datasource.read_folder(spark, str(root)))
    each = []
    for provider in exports.providers():
        path = {"gemini": "gemini/a.json", "claude": "claude/a.json"}.get(provider, provider)
        each += told(exports.read(spark, provider, str(root / path)))
    assert found == sorted(each) and len(found) == 29 + 3 + 4 + 6 + 1 + 1 + 1 + 1  # the blank ones are dropped
    assert {f[3] for f in found} == set(exports.providers())


def test_filters_on_the_provider_are_pushed(spark, root):
    datasource.register_source(spark)
    (root / "grok/bad.json").write_text('[{"id": "a"}, {"id"')
    load = lambda push: spark.read.format("lorekeep").option("push", push).load(str(root))
    with pytest.raises(Exception, match="damaged export"):
        load(True).count()
    assert load(True).where("provider = 'claude'").count() == 30  # grok's folder is not opened
    assert load(True).where(F.col("provider").isin("claude", "abacus") & (F.col("n") < 5)).count() == 10
    plan = io.StringIO()
    with redirect_stdout(plan):
        load(True).where("provider = 'claude'").explain("formatted")
    assert "PushedFilters: [EqualTo(provider,claude)]" in plan.getvalue()
    assert load(True).where("provider = 'none'").count() == 0
    (root / "grok/bad.json").write_text("[]")
    whole = load(False)
    assert whole.where("provider = 'claude'").union(whole.where("provider = 'abacus'")).count() == 35  # one frame, two filters
    (root / "grok/bad.json").unlink()
    (root / "claude/b.json").write_text('[{"id": "a", x}]')
    with pytest.raises(Exception, match="damaged record in"):
        datasource.read_folder(spark, str(root), ["claude"]).collect()


def test_small_files_share_a_partition(root, monkeypatch):
    reader = datasource.Reader(str(root), "grok")
    assert [len(p.paths) for p in reader.partitions()] == [2]
    monkeypatch.setattr(datasource, "SHARE", 10)
    assert [len(p.paths) for p in reader.partitions()] == [1, 1]
    monkeypatch.setattr(datasource, "PIECE", 7)
    with (root / "claude/a.json").open("rb") as f:
        assert [json.loads(t)["id"] for _, t in datasource.cut(f, "x")] == [f"u{i}" for i in range(30)]
