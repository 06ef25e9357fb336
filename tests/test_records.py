"""The cut of JSON exports into records, against json.loads, in ranges of few bytes."""

from __future__ import annotations

import io
import json
import random
import zipfile
from contextlib import contextmanager

import pytest

from lorekeep.sources import exports, records


@contextmanager
def ranges_of(spark, n):
    """Files are read in ranges of n bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def value(r, depth=0):
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "漢", "\n", "\\{", " 0, 0 ", "/"]) for _ in range(r.randint(0, 12)))
    kind = r.randint(0, 6 if depth < 3 else 3)
    if kind > 4:
        return {text() + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return [text(), r.random(), None, True][kind]


def made(r, n):
    return [{"id": i, text: value(r)} for i, text in enumerate(r.choice(["x", 'y"{', "conversations", "\\"]) for _ in range(n))]


def cut(spark, path, **more):
    found = records.records(spark, [str(path)], **more).orderBy("path", "pos").collect()
    return [json.loads(f.text) for f in found]


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_records_are_those_of_a_parser(spark, tmp_path, size):
    r = random.Random(size)
    for i in range(2):
        rows = made(r, 40)
        (tmp_path / f"list{i}.json").write_text(json.dumps(rows, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]), separators=r.choice([None, (",", ":")])) + r.choice(["", "\n "]))
        with ranges_of(spark, size):
            assert cut(spark, tmp_path / f"list{i}.json") == rows
    whole = {"meta": {"a": {"b": [{"c": 1}]}}, "other": [{"id": -1, "conversations": [{"id": -2}]}], "conversations": made(r, 40), "last": [{"id": -3}], "n": [1, 0, 0, "0, 0"]}
    (tmp_path / "object.json").write_text("\ufeff \n" + json.dumps(whole))
    with ranges_of(spark, size):
        assert cut(spark, tmp_path / "object.json") == whole["conversations"]
        assert cut(spark, tmp_path / "object.json", section="last") == whole["last"]
    (tmp_path / "none.json").write_text("[]")
    assert cut(spark, tmp_path / "none.json") == []


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_damage_is_counted_and_raised(spark, tmp_path, size):
    text = json.dumps(made(random.Random(1), 20))
    good = tmp_path / "good.json"
    good.write_text(text)
    broken = {"cut": text[:-1], "inside": text[: len(text) // 2], "string": text[:-2] + '"', "comma": text.replace("}, {", "} {", 1), "twice": text.replace("}, {", "},, {", 1), "more": text + "]", "end": text[:-1] + ",]", "no": "hello", "open": "{"}
    with ranges_of(spark, size):
        for name, bad in broken.items():
            if size < 1000 and name not in ("inside", "comma"):
                continue
            path = tmp_path / "bad" / name
            path.mkdir(parents=True)
            (path / "x.json").write_text(bad)
            with pytest.raises(records.DamagedExport) as error:
                cut(spark, path)
            assert error.value.files == 1 and "x.json" in str(error.value), name
        (tmp_path / "bad" / "record").mkdir()
        (tmp_path / "bad" / "record/x.json").write_text('[{"id": 1}, {"id": 2, a}, {"id": tru}, {"id": 3}]')
        with pytest.raises(records.DamagedExport) as error:
            cut(spark, tmp_path / "bad/record")
        assert (error.value.files, error.value.records) == (0, 2)
        assert cut(spark, tmp_path / "bad/record", strict=False) == [{"id": 1}, {"id": 3}]


def zip_of(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)
    return out.getvalue()


def test_archives_are_cut_piece_by_piece(spark, tmp_path):
    rows = [r | {"more": "}\\\"{" * 3000} for r in made(random.Random(4), 200)]
    (tmp_path / "a.ZIP").write_bytes(zip_of("chats.json", json.dumps(rows)))
    (tmp_path / "b.zip").write_bytes(zip_of("readme", "[{}]"))
    assert cut(spark, tmp_path) == rows
    (tmp_path / "b.zip").write_bytes(zip_of("x.json", json.dumps(rows)[:-40]))
    with pytest.raises(records.DamagedExport):
        cut(spark, tmp_path)
    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    with pytest.raises(records.DamagedExport):
        cut(spark, tmp_path)


def test_a_large_single_line_goes_to_many_tasks(spark, tmp_path):
    path = tmp_path / "grok.json"
    with path.open("w") as f:
        f.write("[")
        for i in range(140):
            f.write((", " if i else "") + json.dumps({"id": f"c{i}", "messages": [{"role": "user", "content": "word \\{\" " * 100}] * 1100}))
        f.write("]")
    assert path.stat().st_size > 130 << 20
    with ranges_of(spark, 8 << 20):
        found = exports.read(spark, "grok", str(path))
        assert {(r.id, r.n) for r in found.selectExpr("id", "size(messages) n").collect()} == {(f"c{i}", 1100) for i in range(140)}
        tasks = records._segments(spark, [str(path)])
        assert tasks.selectExpr("start").distinct().count() > 16 and tasks.rdd.getNumPartitions() > 16


def test_claude_defaults(spark, tmp_path):
    say = lambda **m: [{"sender": "human", "text": "q"} | m]
    rows = [
        {"uuid": "a", "chat_messages": say()}, {"uuid": "b", "name": "", "title": "T", "chat_messages": say()}, {"id": "c", "title": "T", "create_time": 5, "messages": [{"role": "human", "content": [{"type": "text", "text": "x"}, "y", {"type": "image"}]}]},
        {"name": "no id", "created_at": None, "chat_messages": say()}, {"uuid": "d", "name": None, "chat_messages": say(text="", content="kept out")}, {"uuid": "e", "chat_messages": None, "messages": say()}, {"uuid": None, "id": "f", "chat_messages": say(sender=None, role="user")},
    ]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = sorted((r.id, r.name, r.created_at, [(m.role, m.text) for m in r.messages]) for r in exports.read(spark, "claude", str(tmp_path / "c.json")).collect())
    assert got == [("", "Untitled", "", [("assistant", "q")]), ("", "no id", "", [("user", "q")]), ("a", "Untitled", "", [("user", "q")]), ("b", "Untitled", "", [("user", "q")]), ("c", "T", "5", [("user", "x y")])]


def test_grok_and_abacus_texts(spark, tmp_path):
    parts = ["s1", {"type": "text", "text": "dict"}, 4, "s2"]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "g", "title": None, "messages": [{"role": "user", "text": parts}, {"sender": "human", "text": None, "content": "unread"}, {"sender": "human", "content": 12}, {"role": "bot", "text": {"a": 1}}]}, {"uuid": "h", "chat_messages": []}]))
    (got,) = exports.read(spark, "grok", str(tmp_path / "g.json")).collect()
    assert (got.id, got.name, [(m.role, m.text) for m in got.messages]) == ("g", "Untitled", [("user", "s1 s2"), ("user", "12")])
    (tmp_path / "a.json").write_text(json.dumps({"export_metadata": {"source": "x"}, "conversations": [{"uuid": "u", "conversation_id": "", "name": "", "chat_messages": [{"sender": "human", "text": parts, "created_at": "t"}]}, {"name": "no id", "chat_messages": [{"text": "x"}]}]}))
    (got,) = exports.read(spark, "abacus", str(tmp_path / "a.json")).collect()
    assert (got.id, got.name, [tuple(m) for m in got.messages]) == ("abacus_u", "Abacus chat", [("user", "s1 s2", "t")])


@pytest.mark.parametrize("provider", ["claude", "chatgpt", "abacus", "grok"])
def test_truncated_exports_raise(spark, tmp_path, provider):
    rows = json.dumps([{"id": i, "uuid": i, "current_node": "n", "mapping": {}, "messages": [{"text": "x"}]} for i in "abc"])
    (tmp_path / "t.json").write_text(rows[:-20])
    with pytest.raises(records.DamagedExport):
        exports.read(spark, provider, str(tmp_path / "t.json")).collect()
