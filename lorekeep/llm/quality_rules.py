"""Quality rules: a short-circuit cascade, native DataFrame functions only.

Each rule rejects a document by counts of its whole text. On a sample the work of each count (its units for a character and a word,
times those of the sample's texts) and the joint rejections of all rules are estimated. A rule costs the counts it needs that no rule
before it needed, so a shared count is charged once. The next rule asked is always that with most rejections per cost among the documents
that the rules before let pass; the cascade stops at the first that rejects. The order never changes the verdict, only the work, and as
nothing in it is timed, the same rows always give the same order.

Edge cases. Null, empty and blank texts have no words and are rejected by `n_words`. Repeated rows get
the same verdict each. Very long texts are counted whole, in their row. An empty table keeps the given
order and gives an empty result. Columns other than the text are carried through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound, words

#: Expected documents of the sample that the order is estimated on.
SAMPLE = 2000
WINDOW = 5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.array_join(words(text), "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")), F.lit(0)).cast("long")


def n_upper(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")), F.lit(0)).cast("long")


def n_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words in windows of five words found twice or more; only texts with such a window are searched for places."""

    def windows(w):
        return F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def places(g):
        marked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda y, k: ((k > 0) & (F.get(s, k - 1)["x"] == y["x"])) | F.coalesce(F.get(s, k + 1)["x"] == y["x"], F.lit(False)))
        return F.sort_array(F.transform(bound(marked, twice), lambda y: y["i"]))

    def covered(p):
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

    found = bound(bound(words(text), windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(places(g))))
    return F.coalesce(found, F.lit(0)).cast("long")


#: A rule is true for a text it rejects. The first two are the base rules.
BASE = {
    "n_words": lambda t: n_words(t) < 10,
    "repeat_words": lambda t: 100 * n_repeat_words(t) > 20 * n_words(t),
}
RULES = BASE | {
    "symbols": lambda t: 10 * n_symbols(t) > n_words(t),
    "word_length": lambda t: (word_chars(t) < 3 * n_words(t)) | (word_chars(t) > 10 * n_words(t)),
    "dup_lines": lambda t: 10 * n_dup_lines(t) > 3 * n_lines(t),
    "upper": lambda t: 10 * n_upper(t) > 3 * word_chars(t),
}


#: Counts that a rule needs.
NEEDS = {
    "n_words": ("n_words",), "repeat_words": ("n_repeat_words", "n_words"), "symbols": ("n_symbols", "n_words"), "word_length": ("word_chars", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "upper": ("n_upper", "word_chars"),
}
#: Work of a count for a character and for a word, in units of what n_words takes for a character (some 10 ns of a core); comparing counts takes one.
WORK = {
    "n_words": (1.0, 0.0), "word_chars": (1.2, 0.0), "n_symbols": (0.6, 0.0), "n_upper": (0.4, 0.0), "n_lines": (0.2, 0.0), "n_dup_lines": (0.2, 0.0), "n_repeat_words": (1.0, 36.0),
}


def order_rules(found: list[tuple[tuple[bool, ...], int]], cost: dict[str, float], after: Callable[[str, list[str]], float] | None = None) -> list[tuple[str, float, float]]:
    """(rule, cost, share rejected of the documents that reach it) in the order in which to ask the rules.

    found: which of the rules (in the order of cost) reject, and how many documents of the sample they do so together.
    after(rule, rules before it): what a rule then costs, if that is not always the same.
    """
    names, out = list(cost), []
    while len(out) < len(names):
        n, asked = sum(k for _, k in found), [x[0] for x in out]
        hit = {r: sum(k for v, k in found if v[i]) / max(1, n) for i, r in enumerate(names) if r not in asked}
        price = {r: after(r, asked) if after else cost[r] for r in hit}
        best = max(hit, key=lambda r: hit[r] / price[r])
        out.append((best, price[best], hit[best]))
        found = [(v, k) for v, k in found if not v[names.index(best)]]
    return out


def cascade(docs: DataFrame, rules=RULES, sample: int = SAMPLE, seed: int = 11, counted=lambda df: df, paid: tuple[str, ...] = (), needs=NEEDS, work=WORK) -> list[tuple[str, float, float]]:
    """The order of the rules for docs, as order_rules gives it, from a sample; counted(sample) adds the columns that rules use, paid are
    counts that are taken of every document in any case. Costs are units of work a document."""
    n = docs.count()
    if not n:
        return [(k, 0.0, 0.0) for k in rules]
    some = counted(docs.sample(min(1.0, sample / n), seed))
    text = F.coalesce("text", F.lit(""))
    verdicts = [F.coalesce(rule(F.col("text")), F.lit(False)).alias(k) for k, rule in rules.items()]
    rows = some.groupBy(*verdicts).agg(F.count("*"), F.sum(F.length(text)), F.sum(n_words(text))).collect()  # at most 2 ** rules rows
    total = max(1, sum(r[-3] for r in rows))
    chars, words_ = sum(r[-2] for r in rows) / total, sum(r[-1] for r in rows) / total

    def after(rule: str, asked: list[str]) -> float:
        known = {*paid, *(c for r in asked for c in needs[r])}
        return 1 + sum(work[c][0] * chars + work[c][1] * words_ for c in needs[rule] if c not in known)

    return order_rules([(tuple(r[:-3]), r[-3]) for r in rows], {k: after(k, []) for k in rules}, after)


def first_rejection(text: Column, order, rules=RULES) -> Column:
    """The name of the first rule in the order that rejects, null if none does; later rules are not evaluated."""
    out = F.when(rules[order[0][0]](text), F.lit(order[0][0]))
    for name, *_ in order[1:]:
        out = out.when(rules[name](text), F.lit(name))
    return out


def apply_rules(docs: DataFrame, rules=RULES, keep_only: bool = True, name: str = "rejected_by") -> DataFrame:
    """The documents that no rule rejects, or all with the rejecting rule in column `name`."""
    verdict = first_rejection(F.col("text"), cascade(docs, rules), rules)
    return docs.where(verdict.isNull()) if keep_only else docs.withColumn(name, verdict)


def op3(docs: DataFrame) -> DataFrame:
    """All counts of the base, as they are asked for, and the verdict: the cascade over them, which counts more of a text only where
    the rules before let it pass. The counts of the base cost a rule nothing, as they are taken of every document."""
    t, c = F.col("text"), F.col
    counted = lambda df: df.select(
        "doc_id", "text", n_words(t).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(t).alias("n_repeat_words"),
    )
    rules = {
        "n_words": lambda _: c("n_words") < 10, "repeat_words": lambda _: 100 * c("n_repeat_words") > 20 * c("n_words"), "symbols": lambda _: 10 * c("n_symbols") > c("n_words"),
        "word_length": lambda _: (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
        "dup_lines": lambda t: 10 * c("n_dup_lines") > 3 * n_lines(t), "upper": lambda t: 10 * n_upper(t) > 3 * c("word_chars"),
    }
    verdict = first_rejection(t, cascade(docs, rules, counted=counted, paid=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), rules)
    base = rules["n_words"](t) | rules["repeat_words"](t)
    return counted(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict.isNull().alias("kept"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
m AS (SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, p - coalesce(q, p - 5))) AS n FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM m) GROUP BY r),
k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS nl,
  length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS up FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 3 * nl OR 10 * up > 3 * word_chars) AS kept FROM b
"""
