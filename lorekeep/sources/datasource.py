"""All providers' exports under one folder as a Spark data source: `spark.read.format("lorekeep").load(root)`.

root has a folder a provider, with that provider's files in it. A row is a record of a JSON export, or a whole file of the others: (provider, path,
start, n, text). Small files share a partition; a larger one has its own, and JSON arrays are cut into records piece by piece, so memory is bounded by
a record. With the option `push` a filter on the provider is pushed: folders of other providers are not listed. Files are opened where pyarrow finds a
file system for the path (local, object stores, HDFS); `records.py` reads what only Spark can open, and divides single files of very many records.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from . import chats, exports
from .records import MEMBERS, Cutter

#: Bytes of files that share a partition, and that are read at a time.
SHARE, PIECE = 64 << 20, 1 << 20
#: Providers whose *.json files and archives are arrays of records; other files are taken whole.
RECORDS = ("claude", "chatgpt", "abacus", "grok", "gemini")
WHOLE = {"claude-code": ".jsonl", "notebooklm": ".html", "aistudio": "", "gemini": ".html"}
SCHEMA = "provider string, path string, start long, n long, text string"


@dataclass
class Files(InputPartition):
    """Files of one provider."""

    provider: str
    paths: list[str]


def pieces(stream) -> Iterator[bytes]:
    """The bytes of a stream in pieces that, but for the first, begin with '{'."""
    held = b""
    while piece := stream.read(PIECE):
        done, brace, rest = (held + piece).rpartition(b"{")
        if brace:
            yield done
            held = brace + rest
        else:
            held = rest
    yield held


def cut(stream, path: str) -> Iterator[tuple[int, str]]:
    """(n, text) of the records of a stream, which is an error if it is cut off or no JSON without them."""
    cutter = Cutter()
    for piece in pieces(stream):
        for _, section, text in cutter.feed(piece):
            if section in ("", "conversations"):
                yield cutter.n, text.decode(errors="replace")
    rest = b"".join(text for kind, _, text in cutter.end() if kind == "rest")
    try:
        json.loads(rest.removeprefix(b"\xef\xbb\xbf"))
    except ValueError as error:
        raise ValueError(f"damaged export: {path}") from error


class Reader(DataSourceReader):
    def __init__(self, root: str, provider: str | None = None, push: bool = False):
        self.root, self.wanted, self.push = root.rstrip("/"), [provider] if provider else exports.providers(), push

    def pushFilters(self, filters):
        for f in filters:
            if self.push and isinstance(f, EqualTo | In) and f.attribute == ("provider",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = [p for p in self.wanted if p in values]
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def partitions(self):
        from pyarrow import fs

        store, top = self._store()
        out = []
        for provider in self.wanted:
            held, size = [], 0
            found = store.get_file_info(fs.FileSelector(f"{top}/{provider}", allow_not_found=True, recursive=True))
            for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
                json_ = provider in RECORDS and f.path.lower().endswith((".json", ".zip"))
                if not json_ and not (provider in WHOLE and f.path.endswith(WHOLE[provider])):
                    continue
                if held and size + f.size > SHARE:
                    out.append(Files(provider, held))
                    held, size = [], 0
                held.append(f.path)
                size += f.size
            if held:
                out.append(Files(provider, held))
        return out or [Files("", [])]

    def read(self, partition):
        store, _ = self._store()
        for path in partition.paths:
            name = path.lower()
            if partition.provider not in RECORDS or not name.endswith((".json", ".zip")):
                with store.open_input_stream(path) as f:
                    yield partition.provider, path, 0, 0, f.read().decode(errors="replace")
                continue
            with store.open_input_file(path) as f:
                if not name.endswith(".zip"):
                    for n, text in cut(f, path):
                        yield partition.provider, path, 0, n, text
                    continue
                archive = zipfile.ZipFile(io.BufferedReader(f) if not f.seekable() else f)
                names = archive.namelist()
                found = [m for m in MEMBERS if m in names] or [m for m in names if m.endswith(".json")]
                if found:
                    with archive.open(found[0]) as member:
                        for n, text in cut(member, path):
                            yield partition.provider, path, 0, n, text


class ExportSource(DataSource):
    """Options: path, the root folder; provider, the only one to be read; push, whether filters on the provider are pushed.

    Spark keeps one pushed reader for each load, so push only where the frame of a load is filtered in one way: of two filters of one such frame in one
    plan the first would see the files of the second.
    """

    @classmethod
    def name(cls):
        return "lorekeep"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("provider"), self.options.get("push", "").lower() == "true")


def register_source(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.dataSource.register(ExportSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)


def parsed(rows: DataFrame, provider: str) -> DataFrame:
    """The conversations of one provider's rows of the source; a record that is no JSON is an error."""
    own = rows.where(F.col("provider") == provider)
    text = own.select("path", F.struct("start", "n").alias("pos"), "text")
    damaged = F.raise_error(F.concat(F.lit("damaged record in "), F.col("path"), F.lit(", number "), F.col("pos.n").cast("string")))
    found = text.withColumn("v", F.coalesce(F.try_parse_json("text"), damaged))
    if provider == "gemini":
        json_ = F.lower("path").endswith(".json")
        return chats.group_activity(chats.activity_of_records(text.where(json_)).unionByName(chats.activity_of_pages(text.where(~json_))))
    form = {"claude": exports.claude, "abacus": exports.abacus, "grok": chats.grok, "chatgpt": lambda d: exports.linearise(exports.trees(d), "chatgpt")}.get(provider)
    if form:
        return form(found)
    return {"claude-code": chats.sessions, "notebooklm": chats.notebooks, "aistudio": chats.prompts}[provider](text)


def read_folder(spark: SparkSession, root: str, providers: list[str] | None = None) -> DataFrame:
    """Conversations of all providers, or of some, with a folder under root."""
    register_source(spark)
    rows = lambda p: spark.read.format("lorekeep").option("provider", p).load(root)
    return exports.unite(*(parsed(rows(p), p) for p in providers or exports.providers()))
