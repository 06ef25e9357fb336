"""Readers of files on small exports."""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile

from lorekeep.sources import chats, exports, files


def talk(row):
    return [(m.role, m.text) for m in row.messages]


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)


def test_session_logs(spark, tmp_path):
    say = lambda kind, content, **more: {"type": kind, "message": {"content": content}, "timestamp": "2024-01-0%d" % (2 if kind == "user" else 1)} | more
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/one.jsonl").write_text(lines(say("user", " hi "), "{broken", "", {"type": "ai-title", "aiTitle": "old"}, say("assistant", [{"type": "text", "text": "a"}, "b", {"type": "tool_use"}]), say("user", "meta", isMeta=True), say("user", "side", isSidechain=True), {"type": "ai-title", "title": "new"}, "[1]", say("user", [])))
    (tmp_path / "two.v2.jsonl").write_text(lines(say("assistant", "x" * 70)))
    (tmp_path / "agent-3.jsonl").write_text("{}")
    got = {r.id: r for r in exports.read(spark, "claude-code", str(tmp_path)).collect()}
    assert set(got) == {"local_one", "local_two.v2"}
    assert talk(got["local_one"]) == [("user", "hi"), ("assistant", "a b")] and got["local_one"].name == "new" and got["local_one"].created_at == "2024-01-01"
    assert got["local_two.v2"].name == "x" * 60 + "…"
    assert [r.path.rsplit("/", 1)[1] for r in files.find_sessions(spark, str(tmp_path)).orderBy("path").collect()] == ["one.jsonl", "two.v2.jsonl"]
    assert {r.sha for r in files.hashed(spark, str(tmp_path), "agent*").collect()} == {hashlib.sha256(b"{}").hexdigest()}


def test_notebook_pages(spark, tmp_path):
    for top in ("A", "B"):
        (tmp_path / top / "Chat History").mkdir(parents=True)
        (tmp_path / top / "Chat History/Chat Session - 0a-1f.html").write_text("<p>intro</p>\nUSER: <b>what</b> &eacute;\n\nMODEL:\t<p>it &amp; that</p> USER: inline\nUSER:   \n<i></i>")
    (tmp_path / "A/Chat History/Notes.html").write_text("USER: no")
    (got,) = exports.read(spark, "notebooklm", str(tmp_path)).collect()
    assert (got.id, got.name) == ("notebooklm_0a-1f", "A")
    assert talk(got) == [("user", "what é"), ("assistant", "it & that USER: inline")]


def test_prompt_files(spark, tmp_path):
    turns = [{"role": "user", "text": " q "}, {"role": "model", "text": "hm", "isThought": True}, {"role": "model", "text": "ans"}, {"role": "tool", "text": "t"}]
    (tmp_path / "My chat").write_text(json.dumps({"runSettings": {"model": "m1"}, "systemInstruction": {"parts": [{"text": "be"}, {"text": "good"}]}, "chunkedPrompt": {"chunks": turns}}))
    (tmp_path / "draft").write_text(json.dumps({"chunkedPrompt": {"chunks": turns[:1]}}))
    (tmp_path / "list").write_text("[1]")
    (tmp_path / "bad").write_text("{")
    (tmp_path / "raw.png").write_bytes(b"\xff\xfe")
    (got,) = exports.read(spark, "aistudio", str(tmp_path)).collect()
    assert (got.id, got.name, got.model, got.system_instruction) == ("aistudio_" + hashlib.sha1(b"My chat").hexdigest()[:12], "My chat", "m1", "be good")
    assert talk(got) == [("user", "q"), ("assistant", "ans")]


def test_prompt_folder(spark, tmp_path):
    chat = {"chunkedPrompt": {"chunks": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}, {"role": "model", "isThought": True, "parts": [{"text": "x"}]}]}}
    name = "n" * 110
    (tmp_path / name).write_text(json.dumps(chat))
    os.utime(tmp_path / name, (1000, 1000))
    (tmp_path / "same.json").write_text(json.dumps(chat))
    (tmp_path / "bytes").write_bytes(b"\xff\"chunkedPrompt\"")
    (got,) = chats.read_prompt_folder(spark, str(tmp_path)).collect()
    h = hashlib.sha256(name.encode()).hexdigest()
    assert got.id == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}" and got.name == "n" * 97 + "..."
    assert got.created_at == "1970-01-01T00:16:40+00:00" and talk(got) == [("user", "a b")]


def test_activity(spark, tmp_path):
    cell = lambda ask, at, answer: f'<div class="outer-cell x"><p>Prompted\u00a0{ask}<br>{at}<br><p>{answer}</p><div class="caption">Products: Gemini Apps</div></div>'
    page = "<html>" + cell("one &lt;1&gt;", "Mar 5, 2023, 1:02:03\u202fPM UTC", "yes") + cell("two", "Mar 5, 2023, 1:32:03\u202fPM UTC", "") + cell("three", "Mar 5, 2023, 2:32:04\u202fPM UTC", "no") + cell("early", "Feb 5, 2023, 2:32:04\u202fPM UTC", "no") + cell("undated", "soon", "no")
    (tmp_path / "a.html").write_text(page)
    got = exports.read(spark, "gemini", str(tmp_path / "a.html")).orderBy("created_at").collect()
    assert [(r.name, r.created_at, talk(r)) for r in got] == [("one <1>", "2023-03-05T13:02:03", [("user", "one <1>"), ("assistant", "yes"), ("user", "two")]), ("three", "2023-03-05T14:32:04", [("user", "three"), ("assistant", "no")])]
    assert got[0].id == "gemini_" + hashlib.sha1(b"2023-03-05T13:02:03|one <1>").hexdigest()[:12]
    (tmp_path / "a.json").write_text(json.dumps([{"title": "Prompted x", "time": "2024-01-01T00:00:00.500Z", "safeHtmlItem": [{"html": "<p>a</p>"}, {"html": "b"}]}, {"title": "Prompted ", "time": "2024-01-01T00:00:00Z"}]))
    (got,) = exports.read(spark, "gemini", str(tmp_path / "a.json")).collect()
    assert got.created_at == "2024-01-01T00:00:00.500000" and talk(got) == [("user", "x"), ("assistant", "a b")]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("_", "."), text)
    return out.getvalue()


def test_archives(spark, tmp_path):
    flat = [{"id": "f", "title": "", "create_time": 5, "messages": [{"role": "user", "content": "hey"}, {"sender": "bot", "text": ["a", "b"]}, {"role": "user"}]}, {"title": "no id", "messages": [{"text": "x"}]}]
    tree = [{"id": "t", "title": "T", "current_node": "n", "mapping": {"n": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["q"]}}}}}]
    (tmp_path / "flat.zip").write_bytes(zipped(other_json="[]", chats_json=json.dumps(flat)))
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    (tmp_path / "odd.json").write_text('{"a": 1}')
    (tmp_path / "empty.zip").write_bytes(zipped(readme_md=""))
    got = {r.id: r for r in exports.read(spark, "grok", str(tmp_path)).collect()}
    assert {k: (r.name, r.provider, talk(r)) for k, r in got.items()} == {"f": ("Untitled", "grok", [("user", "hey"), ("assistant", "a b")]), "t": ("T", "grok", [("user", "q")])}
    assert got["f"].created_at == "5"


def test_shards_and_discovery(spark, tmp_path):
    tree = lambda i, text: {"id": i, "title": "T", "current_node": "n", "mapping": {"n": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": [text]}}}}}
    one = tmp_path / "one"
    one.mkdir()
    (one / "conversations.json").write_text(json.dumps([tree("z", "whole")]))
    assert [r.id for r in exports.read(spark, "chatgpt", str(one)).collect()] == ["z"]
    (one / "conversations-000.json").write_text(json.dumps([tree("a", "first")]))
    (one / "conversations-001.json").write_text(json.dumps([tree("a", "second"), tree("b", "b")]))
    for path in (one, one / "conversations.json", one / "conversations-*.json"):
        assert {r.id: r.messages[0].text for r in exports.read(spark, "chatgpt", str(path)).collect()} == {"a": "first", "b": "b"}
    stamp = "data-2024-01-02-03-04-05-batch-0001.zip"
    (tmp_path / stamp).write_bytes(zipped(conversations_json="[]"))
    (tmp_path / stamp.replace("0001", "0002")).write_bytes(zipped(x_json="[]"))
    (tmp_path / "conversations.json").write_text("[]")
    for k, p in enumerate((tmp_path / stamp, one / "conversations.json", tmp_path / "conversations.json")):
        os.utime(p, (1000 + k, 1000 + k))
    got = files.find_exports(spark, str(tmp_path)).collect()
    assert [(r.kind, r.path.split(str(tmp_path))[1]) for r in got] == [("json", "/conversations.json"), ("json", "/one/conversations.json"), ("zip", f"/{stamp}")]


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text(lines({"level": "INFO", "message": "a"}, {"level": "ERROR", "message": "b"}, "torn {", "", {"level": "INFO", "message": "c"}, {"level": "ERROR"}))
    show = lambda **k: [(r.level, r.message) for r in files.read_log(spark, str(tmp_path / "log"), **k).collect()]
    assert show(n=3) == [("RAW", "torn {"), ("INFO", "c"), ("ERROR", "")]
    assert show(level="ERROR") == [("ERROR", "b"), ("RAW", "torn {"), ("ERROR", "")]


def test_abacus_bare_list(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"conversation_id": "z", "messages": [{"role": "user", "text": "a"}]}]))
    assert [(r.id, r.name) for r in exports.read(spark, "abacus", str(tmp_path / "b.json")).collect()] == [("abacus_z", "Abacus chat")]
    assert exports.providers() == ["abacus", "aistudio", "chatgpt", "claude", "claude-code", "gemini", "grok", "notebooklm"]
