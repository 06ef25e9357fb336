"""The records of JSON exports of any size: a file is cut where its records begin and end, by ranges of bytes, before any of it is parsed.

A record is an object in the file's array; where the file is an object, one in an array right under it (`section` is that array's key).
Spark reads the file as rows that end at each '{', so ranges of one file, or of one line, go to many tasks. A first pass finds, for each range, how it
changes the state (inside a string or not, depth of brackets) for either state it may begin in. Those few numbers are composed over the
ranges of a file by a window, which tells each range the state it begins in; a second pass then cuts the records, and the two parts of a
record that crosses a range are joined. What is left of a file without its records must be JSON and every record must be, or
the export is damaged, which is an error that counts the damage. Archives (*.zip) cannot be divided: one is read in one task, piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import small_join, written
from .files import files

#: Members that an archive's conversations are looked for in, in this order.
MEMBERS = ["conversations.json", "chats.json", "data.json", "messages.json", "history.json", "export.json"]

#: The section of objects under an object's member that is no array.
NO_LIST = "{"

CUT = "path string, start long, n long, kind string, section string, text binary"
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)
_STRING_END = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_KEY = re.compile(rb'\s*"([^"\\]*(?:\\.[^"\\]*)*)"\s*:\s*\Z', re.DOTALL)
_ZEROS = re.compile(rb"\b0(?:\s*,\s*0)+\b")


def _depth(text: bytes) -> int:
    return text.count(b"{") + text.count(b"[") - text.count(b"}") - text.count(b"]")


class Cutter:
    """Cuts the text of one range, given in order by `feed`; each text but a file's first begins with '{'.

    base is the depth of records, 1 in an array and 2 in an object, and None until the first text shows it.
    """

    def __init__(self, inside: bool = False, depth: int = 0, base: int | None = None):
        self.inside, self.depth, self.base, self.n = inside, depth, base, 0
        self.section = None  # of records; not known before a range's first key
        self.held: list[bytes] | None = [] if base is not None and depth > base else None  # parts of the open record
        self.head = self.held is not None  # the open record began before this range
        self.rest: list[bytes] = []

    def feed(self, data: bytes) -> Iterator[tuple[str, str | None, bytes]]:
        """(kind, section, text) of what ends in data: a record, or the head, the last part of a record that began before."""
        at = kept = 0  # kept: from where on data is not yet held or left
        if self.base is None:
            began = data.removeprefix(b"\xef\xbb\xbf").lstrip()
            kept = at = len(data) - len(began)
            if not began:
                return
            self.base = 2 if began[:1] == b"{" else 1
            self.section = "" if self.base == 1 else None
        if self.inside:
            end = _STRING_END.match(data, at)
            at, self.inside = (end.end(), False) if end else (len(data), True)
        for m in _TOKEN.finditer(data, at):
            token = m.group()
            if token[:1] == b'"':
                self.inside = m.end() == len(data) and not _closed(token)
            elif token in b"{[":
                if self.base == 2 and self.depth == 1:
                    key = _KEY.search(data[max(kept, m.start() - 4096) : m.start()]) if token == b"[" else None
                    self.section = key.group(1).decode(errors="replace") if key else NO_LIST
                if token == b"{" and self.depth == self.base and self.held is None:
                    self.rest += [data[kept : m.start()], b"0"]
                    self.held, kept = [], m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.held is not None and self.depth == self.base:
                    yield "head" if self.head else "record", self.section, b"".join([*self.held, data[kept : m.end()]])
                    self.held, self.head, kept = None, False, m.end()
                    self.n += 1
        (self.rest if self.held is None else self.held).append(data[kept:])

    def end(self) -> Iterator[tuple[str, str | None, bytes]]:
        if self.held is not None:
            yield "middle" if self.head else "tail", self.section, b"".join(self.held)
        yield "rest", self.section, _ZEROS.sub(b"0", b"".join(self.rest))


def _closed(token: bytes) -> bool:
    """Whether a string token that ends its text has its closing quote."""
    body = token[1:-1]
    return len(token) > 1 and token[-1:] == b'"' and (len(body) - len(body.rstrip(b"\\"))) % 2 == 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "start", "n", "kind", "section", "text"])


def _batches(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[5])
        if total >= size:
            yield _batch(held)
            held, total = [], 0
    if held:
        yield _batch(held)


def _units(batches) -> Iterator[tuple[str, int, bytes, tuple]]:
    """(path, start, text, the other columns' first values) of runs of rows of one range; but for a file's first, rows begin with the '{' before them."""
    last = None
    for b in batches:
        paths, starts, values = (b.column(c).to_pylist() for c in ("path", "start", "value"))
        i = 0
        while i < len(values):
            path, start, j = paths[i], starts[i], i + 1
            while j < len(values) and starts[j] == start and paths[j] == path:
                j += 1
            first = start == 0 and last != (path, start)
            last = path, start
            yield path, start, (b"" if first else b"{") + b"{".join(values[i:j]), tuple(c[i].as_py() for c in b.columns[3:])
            i = j


def _segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "{").option("recursiveFileLookup", True).text(paths)
    at = F.col("_metadata.file_path")
    return rows.select(at.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")).where(~F.lower(at).endswith(".zip"))


def _changes(segments: DataFrame) -> DataFrame:
    """(path, start, first, quotes, out, inside): of each range the first byte, whether it changes between inside and outside of strings, and the depth it
    adds if it begins outside, or inside."""

    def run(batches):
        held: dict = {}
        for path, start, data, _ in _units(batches):
            now = held.setdefault((path, start), [data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode(errors="replace"), 0, 0, 0])
            parts = re.sub(rb"\\.", b"", data, flags=re.DOTALL).split(b'"')
            sides = _depth(b"".join(parts[::2])), _depth(b"".join(parts[1::2]))
            now[2] += sides[now[1]]
            now[3] += sides[1 - now[1]]
            now[1] ^= (len(parts) - 1) & 1
        if held:
            rows = [(p, s, *v) for (p, s), v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["path", "start", "first", "quotes", "out", "inside"])

    return segments.mapInArrow(run, "path string, start long, first string, quotes long, out long, inside long")


def _states(changes: DataFrame) -> DataFrame:
    """(path, start, inside, depth, base) with which each range begins, and after, depth_after of its end."""
    by = Window.partitionBy("path").orderBy("start")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    quoted = changes.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    own = quoted.withColumn("d", F.when(F.col("q") == 0, F.col("out")).otherwise(F.col("inside")))
    depth = own.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    base = F.when(F.min(F.struct("start", "first")).over(whole)["first"] == "{", 2).otherwise(1)
    return depth.select("path", "start", (F.col("q") == 1).alias("inside"), "depth", base.alias("base"), ((F.col("q") + F.col("quotes")) % 2).alias("after"), (F.col("depth") + F.col("d")).alias("depth_after"))


def _cut(segments: DataFrame, states: DataFrame) -> DataFrame:
    """CUT rows of each range: records, the parts of those that cross ranges (n counts within the range), and the rest."""

    def run(batches):
        def rows():
            at = cutter = None
            for path, start, data, (inside, depth, base) in _units(batches):
                if at != (path, start):
                    if cutter:
                        yield from ((*at, cutter.n, *x) for x in cutter.end())
                    at, cutter = (path, start), Cutter(inside, depth, None if start == 0 else base)
                for kind, section, text in cutter.feed(data):
                    yield path, start, cutter.n, kind, section, text
            if cutter:
                yield from ((*at, cutter.n, *x) for x in cutter.end())

        yield from _batches(rows())

    ordered = small_join(segments.withColumn("_row", F.monotonically_increasing_id()), states.select("path", "start", "inside", "depth", "base"), ["path", "start"], order=["path", "start", "_row"])
    return ordered.select("path", "start", "value", "inside", "depth", "base").mapInArrow(run, CUT)


def _cut_archives(spark: SparkSession, paths: list[str], wanted: list[str]) -> DataFrame:
    """CUT rows of the first wanted member, or else the first *.json, of each archive, which is read piece by piece; one without such a member has no rows."""

    def run(batches):
        import io
        import zipfile

        def rows():
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    cutter, held = Cutter(), b""
                    try:
                        archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                        names = archive.namelist()
                        found = [n for n in wanted if n in names] or [n for n in names if n.endswith(".json")]
                        if not found:
                            continue
                        with archive.open(found[0]) as member:
                            while piece := member.read(1 << 20):
                                done, brace, held = (held + piece).rpartition(b"{")
                                if brace:
                                    held = brace + held
                                    yield from ((path, 0, cutter.n, *x) for x in cutter.feed(done))
                    except (zipfile.BadZipFile, EOFError, OSError):
                        yield path, 0, cutter.n, "rest", None, b"no archive"
                        continue
                    yield from ((path, 0, cutter.n, *x) for x in cutter.feed(held))
                    yield from ((path, 0, cutter.n, *x) for x in cutter.end())

        yield from _batches(rows())

    zips = [files(spark, p, "*.[zZ][iI][pP]").select("path", "content") for p in paths]
    out = zips[0]
    for more in zips[1:]:
        out = out.union(more)
    return out.mapInArrow(run, CUT)


def _joined(cut: DataFrame) -> DataFrame:
    """Records that cross ranges: a tail, and the parts up to the next head. A part without a tail has no text, which is damage."""
    parts = cut.where(F.col("kind").isin("head", "middle", "tail"))
    order = F.when(F.col("kind") == "tail", 1).otherwise(0)  # of one range's parts the head comes first
    at = Window.partitionBy("path").orderBy("start", order)
    keys = parts.select("path", "start", "n", "kind", F.count_if(F.col("kind") == "tail").over(at).alias("g"))
    told = parts.join(keys, ["path", "start", "n", "kind"]).groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("start", "n", "kind", "section", "text"))).alias("ps"))
    first, last = F.get("ps", 0), F.element_at("ps", -1)
    whole = (first["kind"] == "tail") & (last["kind"] == "head")
    text = F.aggregate(F.transform("ps", lambda p: p["text"]), F.lit(b""), lambda s, p: F.concat(s, p))
    return told.select("path", first["start"].alias("start"), first["n"].alias("n"), first["section"].alias("section"), F.when(whole, text).alias("text"))


def _damaged(cut: DataFrame, states: DataFrame | None) -> DataFrame:
    """(path): files that end inside a string or bracket, or that are no JSON with their records left out."""
    rests = cut.where("kind = 'rest'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("ps"))
    text = F.aggregate(F.transform("ps", lambda p: p["text"]), F.lit(b""), lambda s, p: F.concat(s, p))
    bad = rests.where(F.try_parse_json(F.make_valid_utf8(text.cast("string"))).isNull()).select("path")
    if states is None:
        return bad
    ends = states.groupBy("path").agg(F.max(F.struct("start", "after", "depth_after")).alias("e"))
    return bad.union(ends.where("e.after <> 0 or e.depth_after <> 0").select("path")).distinct()


def raw_records(spark: SparkSession, paths: list[str], section: str = "conversations", wanted: list[str] = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Records (path, pos, text) of files, folders or globs, and files that are damaged (path). The cut is written once, so both can be read again and again."""
    segments = _segments(spark, paths)
    states = written(_states(_changes(segments)))
    cut = written(_cut(segments, states).unionByName(_cut_archives(spark, paths, wanted)))
    whole = cut.where("kind = 'record'").select("path", "start", "n", "section", "text").unionByName(_joined(cut))
    known = cut.where("kind = 'rest' and section is not null").select("path", "start", "section")
    at = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = states.select("path", "start").join(known, ["path", "start"], "left").withColumn("inherited", F.last("section", ignorenulls=True).over(at)).select("path", "start", "inherited")
    objects = written(spans.where("inherited <> ''"))  # ranges that begin in an array of an object
    own = small_join(whole, objects, ["path", "start"], "left").withColumn("section", F.coalesce("section", "inherited"))
    out = own.where(F.coalesce(F.col("section").isin("", section) | F.col("text").isNull(), F.lit(True)))
    return out.select("path", F.struct("start", "n").alias("pos"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")), _damaged(cut, states)


class DamagedExport(ValueError):
    """An export, or some of its records, that is not JSON: files, records, and the first places of each."""

    def __init__(self, files_: int, records_: int, places: list[str]):
        self.files, self.records, self.places = files_, records_, places
        super().__init__(f"damaged export: {files_} files are cut off or no JSON, {records_} records are no JSON; first: {', '.join(places)}")


def records(spark: SparkSession, paths: list[str], section: str = "conversations", strict: bool = True) -> DataFrame:
    """(path, pos, v) of the records of JSON exports, v being a VARIANT; damage is raised, or if not strict left out."""
    found, bad = raw_records(spark, paths, section)
    parsed = found.withColumn("v", F.try_parse_json("text"))
    if strict:
        lost = parsed.where("v is null")
        n_files, n_records = bad.count(), lost.count()
        if n_files or n_records:
            places = [r.path for r in bad.orderBy("path").limit(5).collect()] + [f"{r.path} at {r.pos.start}+{r.pos.n}" for r in lost.orderBy("path", "pos").limit(5).collect()]
            raise DamagedExport(n_files, n_records, places)
    return parsed.where("v is not null").select("path", "pos", "text", "v")


def field(v: Column, key: str, kind: str = "string") -> Column:
    """A member of a VARIANT, null where the key is missing or the value is of another kind."""
    return F.try_variant_get(v, f"$['{key}']", kind)


def present(v: Column, *keys: str) -> Column:
    """The first of the keys that v has, even if its value is a JSON null, as a VARIANT."""
    return F.coalesce(*(F.try_variant_get(v, f"$['{k}']", "variant") for k in keys))
