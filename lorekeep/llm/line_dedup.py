"""Line dedup: winnowing over line hashes, native DataFrame functions only.

A text is its lines, split at \\n; a line has two independent 64-bit hashes. Each window of `min_lines` successive
lines selects the smallest first hash in it (the rightmost of equal ones) as a fingerprint, so that any two equal runs of
`min_lines` lines or more share one at the same place in the run. With `min_words`, a line of that many words or more
is a fingerprint of its own too, so it is found in any surroundings.

Positions of fingerprints found twice or more are joined, a row a position. Positions that agree in all lines about them,
as far as the next fingerprint of either side can lie (`min_lines` - 1 lines, or to the end of the text; both hashes of all lines
are equal), go to the earliest of them, in the order of doc_id, text hash and line: there the match is extended both ways over these
lines, and goes on from the next fingerprint. Only the earliest position of each surroundings is taken apart into the windows that
selected it, as it may share one with others; a window goes to the earliest position with it, too, and a long line that is no part
of such a run is deleted without its neighbours. The later run is deleted, whatever its length.

Edge cases. A text of fewer lines than `min_lines` is one window and is deleted if an earlier text is
the same. Null and empty texts have no lines and stay. Rows equal in doc_id and text are one document
repeated: they keep the same lines. A null doc_id comes before all others. Blank lines count as lines. A very long text is hashed
whole, in its row, and its positions are rows of their own. A fingerprint, surroundings or a window of very many positions is joined in many tasks. Columns other than doc_id and text are carried through by
`line_dedup`; `n_chars`, if there, is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound, join_spread, materialise, packed, unpacked

MIN_LINES = 3
#: Words of a line that is deleted alone.
MIN_WORDS = 20


def _lines(text):
    return F.split(text, "\n", -1)


def _selected(hs, t: int):
    """By window of t lines the line it selects."""

    def chosen(i):
        return bound(F.slice(hs, i + 1, F.lit(t)), lambda x: (i + F.size(x) - F.array_position(F.reverse(x), F.array_min(x))).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(hs) - t, F.lit(0))), chosen)


def _keys(hs, ks, start, size, *more):
    """Two hashes of so many lines from start on."""
    return [F.xxhash64(F.slice(x, start + 1, size), F.lit(salt), *more).alias(k) for x, salt, k in ((hs, 1, "k1"), (ks, 2, "k2"))]


def _positions(hs, ks, long, t: int):
    """Structs of the positions that windows of t lines select or that hold a long line: at, fp, how many lines to the left and to the right belong to
    them, the hashes of all these lines, and the windows (pos, len, k1, k2) that selected it, the long line itself among them."""
    n = F.size(hs)
    size = F.least(F.lit(t), n)

    def position(at, selected):
        left, right = F.least(at, F.lit(t - 1)), F.least(n - 1 - at, F.lit(t - 1))
        window = lambda i, k: F.struct(i.cast("int").alias("pos"), k.cast("int").alias("len"), *_keys(hs, ks, i, k))
        mine = F.filter(F.sequence(F.greatest(at - t + 1, F.lit(0)), F.least(at, F.greatest(n - t, F.lit(0)))), lambda i: F.get(selected, i) == at)
        alone = F.filter(F.array(F.get(long, at)), lambda i: i.isNotNull())
        windows = F.concat(F.transform(mine, lambda i: window(i, size)), F.transform(alone, lambda i: window(i, F.lit(1))))
        return F.struct(at.alias("at"), F.get(hs, at).alias("fp"), left.alias("left"), right.alias("right"), *_keys(hs, ks, at - left, left + right + 1, left, size), windows.alias("windows"))

    return bound(_selected(hs, t), lambda s: F.transform(F.array_distinct(F.concat(s, F.array_compact(long))), lambda at: position(at, s)))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Runs (_id, _t, pos, len) of lines that equal an earlier run."""
    lines = F.transform(_lines(F.col("text")), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("line"), x).alias("k"), _long(x, i, min_words).alias("long")))
    hashed = docs.where(F.length("text") > 0).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), lines.alias("ls"))
    hs, ks, long = (F.col(c) for c in ("hs", "ks", "long"))
    hashed = materialise(hashed.select("_id", "_t", F.col("ls.h").alias("hs"), F.col("ls.k").alias("ks"), F.col("ls.long").alias("long")))
    at = F.array_distinct(F.concat(_selected(hs, min_lines), F.array_compact(long)))
    shared = materialise(hashed.select(F.explode(bound(at, lambda x: F.transform(x, lambda i: F.get(hs, i)))).alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"))
    found = hashed.select("_id", "_t", F.explode(_positions(hs, ks, long, min_lines)).alias("x")).select("_id", "_t", "x.*")
    found = materialise(join_spread(found, shared, ["fp"]).drop("fp"))
    around = materialise(found.groupBy("k1", "k2").agg(F.min(F.struct("_id", "_t", "at", "windows")).alias("first"), F.count("*").alias("n")))
    extended = _later(found.drop("windows"), around.where("n > 1"), ["k1", "k2"], "at").select("_id", "_t", (F.col("at") - F.col("left")).alias("pos"), (F.col("left") + F.col("right") + 1).alias("len"))
    windows = materialise(around.select("first._id", "first._t", F.explode("first.windows").alias("w")).select("_id", "_t", "w.*"))
    first = materialise(windows.groupBy("k1", "k2", "len").agg(F.min(F.struct("_id", "_t", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    return extended.union(_later(windows, first, ["k1", "k2", "len"], "pos").select("_id", "_t", "pos", "len")).distinct()


def _later(rows: DataFrame, first: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows that are not the first of their keys."""
    first = first.select(*keys, "n", F.struct("first._id", "first._t", f"first.{at}").alias("_first"))
    return join_spread(rows, first, keys).where(~F.struct("_id", "_t", at).eqNullSafe(F.col("_first")))


def _long(line, i, min_words: int | None):
    """i if the line has min_words words or more; shorter lines than that many words can be are not searched."""
    if not min_words:
        return F.lit(None).cast("int")
    return F.when((F.length(line) >= 2 * min_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= min_words), i)


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, n_removed_col: str | None = None, min_words: int | None = None) -> DataFrame:
    """docs without the repeated runs and, if min_words is given, the repeated lines of so many words; n_removed_col, if given, counts the lines removed."""
    by = Window.partitionBy("_id", "_t").orderBy("pos")
    start = F.coalesce(F.max(F.col("pos") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = (
        repeated_runs(docs, min_lines, min_words)
        .withColumn("start", start)
        .groupBy("_id", "_t")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("pos") > F.col("start"), F.struct("start", F.col("pos").alias("end"))))).alias("_kept"),
            F.max(F.col("pos") + F.col("len")).alias("_tail"),
        )
    )
    both = packed(docs, _di=F.col("doc_id"), _h=F.xxhash64("text"), text=F.col("text")).join(kept, F.col("_di").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")

    def rest(lines):
        runs = F.concat(F.col("_kept"), F.array(F.struct(F.col("_tail").alias("start"), F.size(lines).alias("end"))))
        return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["end"] - r["start"]))), "\n")

    text = F.when(F.col("_tail").isNull(), F.col("text")).otherwise(bound(_lines(F.col("text")), rest))
    columns = dict(zip(docs.columns, unpacked(docs), strict=True)) | {"text": F.col("_new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_tail").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    out = [c.alias(n) for n, c in columns.items()]
    if n_removed_col:
        size = F.size(_lines(F.col("text")))
        left = F.aggregate("_kept", F.lit(0), lambda a, r: a + r["end"] - r["start"])
        out.append(F.when(F.col("_tail").isNull(), F.lit(0)).otherwise(F.col("_tail") - left).cast("long").alias(n_removed_col))
        out.append(F.coalesce(F.when(F.length("text") > 0, size), F.lit(0)).cast("long").alias("n_lines"))
    return both.withColumn("_new", text).select(*out)


def op1(docs: DataFrame) -> DataFrame:
    d = line_dedup(docs.select("doc_id", "text"), n_removed_col="n_removed", min_words=MIN_WORDS)
    return d.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP1_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, ls, p AS pos, least(len(ls), {MIN_LINES}) AS n, array_to_string(list_slice(ls, p + 1, p + {MIN_LINES}), chr(10)) AS win
      FROM (SELECT *, unnest(range(0, greatest(len(ls) - {MIN_LINES}, 0) + 1)) AS p FROM d)),
r AS (SELECT *, row_number() OVER (PARTITION BY n, win ORDER BY doc_id NULLS FIRST, text, pos) AS k FROM w),
l AS (SELECT doc_id, text, unnest(ls) AS s, unnest(range(0, len(ls))) AS line FROM d),
long AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, text, line) AS k FROM l WHERE len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}),
gone AS (SELECT doc_id, text, unnest(range(pos, pos + n)) AS line FROM r WHERE k > 1 UNION SELECT doc_id, text, line FROM long WHERE k > 1),
k AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.line) AS n_removed,
             coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept
      FROM l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.line = g.line GROUP BY 1, 2)
SELECT o.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, md5(coalesce(k.kept, '')) AS kept_md5
FROM documents o LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the repeated runs and long lines; those of which no line is left go."""
    name = "_lines_removed"
    return line_dedup(docs, n_removed_col=name, min_words=MIN_WORDS).where(f"{name} = 0 or {name} < n_lines").select(*docs.columns)
