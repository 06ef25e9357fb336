"""Mixing sources to target weights: hierarchical budgets, native DataFrame functions only.

The tree is domain, language, source. A budget of tokens is shared out from the root down in proportion
to the weights; what a node cannot fill (its leaves hold at most `max_epochs` times their tokens) goes to
its siblings first, and to its parent's siblings only when all siblings are full. Each leaf takes whole
epochs while its budget lasts and then, in the seeded order of the last epoch, the shortest prefix of
documents that reaches the rest. An epoch orders documents by md5 of seed, epoch and doc_id.

A node's room is that of its children of positive weight, at every level, so what children may not take goes on to
the ancestors' other children. The prefix needs no sorted leaf: tokens are summed by the next two hex digits of the
order, the digits in which the budget ends are found among those at most 256 sums, and so on with two digits more,
until only few documents (`FEW`) are behind them; these are put in order.

Edge cases. A null domain, language or source is a value of its own. Documents without words cost
nothing and follow the order alone. Rows of one doc_id share a place in the order and are taken together;
a null doc_id orders as ''. Weights not given are 1; a node of weight 0 gets nothing. An empty table
gives an empty result. All columns are carried through; a document of two epochs comes out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, packed, unpacked

SEED, MAX_EPOCHS, BUDGET_RATIO = 17, 2, 1.0
#: Target weights of the registered query and of the pipeline. Sources of a language weigh the same.
DOMAIN = "CASE WHEN try_cast(regexp_extract(source, '[0-9]+', 0) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END"
DOMAINS = {"even": 0.5, "odd": 0.5}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
#: Largest plan of leaves, in rows and in bytes of their names, that is broadcast; a larger one is joined in salted shuffles.
PLAN_ROWS, PLAN_BYTES, SALTS = 100_000, 8 << 20, 16
#: Hex digits by which the order of a leaf is summed at a time, and documents of a leaf that are put in order.
DIGITS, FEW = 2, 256


def _weight(name: Column, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in given.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, cap, weight, budget of the parent) with `alloc`: the budget in proportion
    to weight, none over its cap, shortages shared by the siblings that have room."""
    by = Window.partitionBy(*parent)
    up = by.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = (F.col("weight") > 0) & (F.sum("cap").over(up) + F.col("ratio") * (F.sum("weight").over(by) - F.sum("weight").over(up)) <= F.col("budget"))
    return (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(1e300)))
        .withColumn("full", full)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(by))
        .withColumn("alloc", F.when(F.col("full"), F.col("cap")).when(F.col("open") > 0, F.col("left") * F.col("weight") / F.col("open")).otherwise(F.lit(0.0)))
        .drop("ratio", "full", "left", "open")
    )


def leaf_budgets(leaves: DataFrame, domains=None, languages=None, sources=None, budget_ratio=BUDGET_RATIO, max_epochs=MAX_EPOCHS) -> DataFrame:
    """leaves (d, l, s, tokens) with budget (long), the tokens that each is to give."""
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs).withColumn("weight", _weight(F.col("s"), sources or {}))
    room = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))), F.lit(0.0)).alias("cap")
    langs = leaves.groupBy("d", "l").agg(room, F.sum("tokens").alias("all")).withColumn("weight", _weight(F.col("l"), languages or {}))
    doms = langs.groupBy("d").agg(room, F.sum("all").alias("all")).withColumn("weight", _weight(F.col("d"), domains or {})).withColumn("r", F.lit(0))
    doms = doms.withColumn("budget", F.floor(F.sum("all").over(Window.partitionBy("r")) * float(budget_ratio)).cast("double"))
    doms = share_out(doms, ["r"], "d").select("d", F.col("alloc").alias("budget"))
    langs = share_out(langs.join(doms, "d"), ["d"], "l").select("d", "l", F.col("alloc").alias("budget"))
    leaves = share_out(leaves.join(langs, ["d", "l"]), ["d", "l"], "s")
    return leaves.select("d", "l", "s", "tokens", F.floor(F.col("alloc") + 1e-6).cast("long").alias("budget"))


def _by_leaf(rows: DataFrame, plan: DataFrame, leaf: list[str], small: bool) -> DataFrame:
    """rows with the plan of their leaf; a leaf of many rows stays in many tasks, either way."""
    if small:
        return rows.join(F.broadcast(plan), leaf)
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*leaf, "_salt"]).drop("_salt")


def mix(docs: DataFrame, domain: Column | None = None, seed: int = SEED, epoch_col: str | None = None, few: int = FEW, **targets) -> DataFrame:
    """docs in the target mix; epoch_col, if given, tells the epoch (from 0) a row is taken in."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit("\0null"))
    keyed = packed(
        docs, d=value(domain if domain is not None else F.expr(DOMAIN)), l=value(F.col("lang")), s=value(F.col("source")),
        n=F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), id=F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
    )
    slim = materialise(keyed.select("d", "l", "s", "n", "id"))
    leaf = ["d", "l", "s"]
    order = lambda epoch, i: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), i))
    budgets = leaf_budgets(slim.groupBy(*leaf).agg(F.sum("n").alias("tokens")), **targets)
    plan = materialise(
        budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*leaf, "whole", "rest")
    )
    size = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(F.octet_length(c) for c in leaf)), F.lit(0)).alias("b")).first()
    small = size["n"] <= PLAN_ROWS and size["b"] <= PLAN_BYTES
    some = _by_leaf(slim, plan.where("rest > 0"), leaf, small).withColumn("o", order(F.col("whole"), F.col("id"))).select(*leaf, "rest", "o", "n")
    some = some.groupBy(*leaf, "rest", "o").agg(F.sum("n").alias("n"))
    some = materialise(some.withColumn("p", F.lit("")))
    up = lambda *by: Window.partitionBy(*by).orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in range(DIGITS, 33, DIGITS):
        if (some.groupBy(*leaf).count().agg(F.max("count")).first()[0] or 0) <= few:
            break
        sums = some.groupBy(*leaf, "rest", F.substring("o", 1, digits).alias("o")).agg(F.sum("n").alias("n")).withColumn("until", F.sum("n").over(up(*leaf)))
        last = sums.where("until >= rest and until - n < rest").select(*leaf, F.col("o").alias("p"), (F.col("rest") - F.col("until") + F.col("n")).alias("rest"))
        deeper = some.drop("p", "rest").withColumn("p", F.substring("o", 1, digits)).join(F.broadcast(last) if small else last, [*leaf, "p"])
        some = materialise(deeper.select(*leaf, "rest", "o", "n", "p"))
    cut = some.withColumn("until", F.sum("n").over(up(*leaf))).where("until >= rest and until - n < rest").select(*leaf, F.col("o").alias("cut"))
    plan = plan.join(cut, leaf, "left").select(*leaf, "whole", "cut")
    taken = F.col("whole") + F.coalesce(order(F.col("whole"), F.col("id")) <= F.col("cut"), F.lit(False)).cast("int")
    out = _by_leaf(keyed.drop("n"), plan, leaf, small).withColumn("taken", taken).where("taken > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    return out.select(*unpacked(docs), *([F.col("epoch").alias(epoch_col)] if epoch_col else []))


TARGETS = {"domains": DOMAINS, "languages": LANGUAGES}


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "lang", "source"), epoch_col="epoch", **TARGETS).select("doc_id", "lang", "source", "epoch")


def _case(name: str, given: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(v)}::DOUBLE" for k, v in given.items()) + " ELSE 1.0::DOUBLE END"


def _fill_sql(out: str, rows: str, parent: str) -> str:
    """A node is full if its siblings, each filled in proportion to weight until this one is full, need no more than the budget."""
    same = " AND ".join(f"b.{c} = a.{c}" for c in parent.split(", "))
    return f"""
{out}0 AS (SELECT *, weight > 0 AND (SELECT sum(least(b.cap, a.cap / nullif(a.weight, 0) * b.weight)) FROM ({rows}) b WHERE {same} AND b.weight > 0) <= budget + 1e-6 AS f FROM ({rows}) a),
{out} AS (SELECT a.*, CASE WHEN weight <= 0 THEN 0.0 WHEN f THEN cap ELSE weight
  * (budget - coalesce((SELECT sum(cap) FROM {out}0 b WHERE {same} AND b.f), 0)) / (SELECT sum(weight) FROM {out}0 b WHERE {same} AND NOT b.f AND b.weight > 0) END AS alloc FROM {out}0 a)"""


OP6_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(CASE WHEN TRY_CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END, '?') AS d,
  coalesce(lang, '?') AS l, coalesce(source, '?') AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
leaf AS (SELECT d, l, s, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE * {MAX_EPOCHS} AS cap, 1.0::DOUBLE AS weight FROM t GROUP BY d, l, s),
langs AS (SELECT d, l, sum(cap) AS cap, {_case("l", LANGUAGES)} AS weight FROM leaf GROUP BY d, l),
doms AS (SELECT 0 AS r, d, sum(cap) FILTER (WHERE weight > 0) AS cap, {_case("d", DOMAINS)} AS weight FROM langs GROUP BY d),
{_fill_sql("da", f"SELECT r, d, weight, coalesce(cap, 0.0) AS cap, floor((SELECT sum(tokens) FROM leaf) * {BUDGET_RATIO}::DOUBLE) AS budget FROM doms", "r")},
{_fill_sql("la", "SELECT g.*, da.alloc AS budget FROM langs g JOIN da USING (d)", "d")},
{_fill_sql("sa", "SELECT g.*, la.alloc AS budget FROM leaf g JOIN la USING (d, l)", "d, l")},
plan AS (SELECT d, l, s, whole, budget - whole * tokens AS rest FROM (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole FROM (SELECT d, l, s, tokens, floor(alloc + 1e-6)::BIGINT AS budget FROM sa))),
o AS (SELECT t.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM t JOIN plan USING (d, l, s)),
c AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY k RANGE UNBOUNDED PRECEDING) AS until, sum(n) OVER (PARTITION BY d, l, s, k) AS own FROM o),
e AS (SELECT doc_id, lang, source, whole + (rest > 0 AND k <= coalesce(max(CASE WHEN until >= rest AND until - own < rest THEN k END) OVER (PARTITION BY d, l, s), ''))::INT AS taken FROM c)
SELECT doc_id, lang, source, unnest(range(0, taken))::INT AS epoch FROM e WHERE taken > 0
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in the target mix."""
    return mix(docs, **TARGETS)
