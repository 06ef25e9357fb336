"""Readers of conversation exports: one row (id, name, created_at, provider, messages) per conversation.

Files are cut into records where they lie and parsed as VARIANTs (records.py); an export that is damaged is an error. The walk over a
message tree doubles pointers in array functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import coalesce_text, epoch_iso, flatten, role, strings, strip
from .files import listed, shards
from .records import field, present, records

MESSAGE = "struct<role: string, text: string, timestamp: string>"

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(provider: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _READERS[provider] = reader


def providers() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, provider: str, path: str | list[str]) -> DataFrame:
    if provider not in _READERS:
        raise ValueError(f"unknown provider {provider!r}; available: {', '.join(providers())}")
    return _READERS[provider](spark, path)


def _text(v: Column) -> Column:
    """A VARIANT as a string; '' if it is none."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def told(turns: Column, text, at, who: tuple[str, str] = ("sender", "role")) -> Column:
    """Trimmed non-blank messages of flat turns, by functions of a turn; a key that is missing, not one that is empty, gives way to the next."""

    def one(t):
        said = strip(text(t))
        return F.struct(role(_text(present(t, *who))).alias("role"), said.alias("text"), at(t).alias("timestamp"))

    return F.filter(F.transform(turns, one), lambda m: m["text"] != "")


def _began(t: Column) -> Column:
    """When a turn was made: its own date, else the first of its parts that has one, else its timestamp."""
    starts = F.transform(_list(present(t, "content")), lambda c: field(c, "start_timestamp"))
    return coalesce_text(field(t, "created_at"), F.get(F.filter(starts, lambda x: x != ""), 0), field(t, "timestamp"))


def read_claude(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Conversations of a JSON array of any size. A conversation without a name is 'Untitled', one without an id has the id ''."""
    return claude(records(spark, listed(path)))


def claude(found: DataFrame) -> DataFrame:
    """Conversations of records (v)."""
    v = F.col("v")
    messages = told(_list(present(v, "chat_messages", "messages")), lambda t: flatten(present(t, "text", "content")), _began)
    out = found.select(_text(present(v, "uuid", "id")).alias("id"), coalesce_text(_text(present(v, "name", "title")), F.lit("Untitled")).alias("name"), _text(present(v, "created_at", "create_time")).alias("created_at"), F.lit("claude").alias("provider"), messages.alias("messages"))
    return out.where(F.size("messages") > 0)


def read_abacus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An object with a list of conversations, or the bare list; turns may also stand under `messages`. Conversations without an id are skipped."""
    return abacus(records(spark, listed(path)))


def abacus(found: DataFrame) -> DataFrame:
    """Conversations of records (v)."""
    v = F.col("v")
    id_ = coalesce_text(field(v, "conversation_id"), field(v, "uuid"))
    messages = told(_list(present(v, "chat_messages", "messages")), lambda t: strings(present(t, "text")), lambda t: _text(present(t, "created_at")))
    out = found.select(id_.alias("own"), F.concat(F.lit("abacus_"), id_).alias("id"), coalesce_text(field(v, "name"), F.lit("Abacus chat")).alias("name"), _text(present(v, "created_at")).alias("created_at"), F.lit("abacus").alias("provider"), messages.alias("messages"))
    return out.where((F.col("own") != "") & (F.size("messages") > 0)).drop("own")


_NODE = "struct<parent: string, message: struct<author: struct<role: string>, content: struct<content_type: string, parts: array<variant>>, create_time: double, weight: double>>"

TREES = f"id string, title string, create_time double, current_node string, mapping map<string, {_NODE}>"


def read_chatgpt(spark: SparkSession, path: str | list[str], max_conversations: int | None = None) -> DataFrame:
    """The branch from current_node to the root, oldest first; the first shard of an id wins. With max_conversations, the first
    so many of all shards, in their order."""
    return linearise(trees(records(spark, shards(spark, path))), "chatgpt", max_conversations)


def trees(found: DataFrame) -> DataFrame:
    """Records (path, pos, text) as message trees."""
    return found.select(F.from_json("text", TREES).alias("t"), F.col("path").alias("shard"), "pos").select("t.*", "shard", "pos")


def _branches(df: DataFrame) -> DataFrame:
    """Message trees with `nodes`, the entries of the mapping, and `branch`, the places (from 1) in it from the root to current_node.

    Pointer doubling: a round appends to the path of 2^k nodes the 2^k-th ancestor of each, so there are log2(n) rounds of array operations. A parent
    that is missing ends the branch, and so does a node that was met before.
    """
    keys, place = F.map_keys("mapping"), lambda key: F.coalesce(F.array_position("keys", key), F.lit(0)).cast("int")
    df = df.withColumn("nodes", F.map_entries("mapping")).withColumn("keys", keys)
    df = df.withColumn("up", F.concat(F.array(F.lit(0)), F.transform("nodes", lambda e: place(e["value"]["parent"]))))  # places of parents, 0 for none
    met = lambda places: F.filter(places, lambda i: i > 0)

    def doubled(s, _):
        beyond = lambda places: F.transform(places, lambda i: F.get(s["up"], i))
        return F.struct(F.concat(s["path"], met(beyond(s["path"]))).alias("path"), beyond(s["up"]).alias("up"))

    start = F.struct(met(F.array(place(F.col("current_node")))).alias("path"), F.col("up").alias("up"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("nodes") + 1)).cast("int"))
    return df.withColumn("branch", F.aggregate(rounds, start, doubled, lambda s: F.reverse(F.array_distinct(s["path"]))))


def linearise(df: DataFrame, provider: str, most: int | None = None) -> DataFrame:
    """Conversations of message trees (TREES, shard and pos); rows without an id are skipped. Of the parts of a message the strings count,
    and a message counts whose first part is one."""
    df = df.where(F.coalesce("id", F.lit("")) != "")

    told = F.transform("branch", lambda i: F.get("nodes", i - 1)["value"]["message"])
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    first = lambda m: plain(F.get(m["content"]["parts"], 0))
    fit = lambda m: m["author"]["role"].isin("user", "assistant") & (m["content"]["content_type"] == "text") & (strip(first(m)) != "") & (F.coalesce(m["weight"], F.lit(1.0)) != 0)
    text = lambda m: strip(F.array_join(F.transform(m["content"]["parts"], plain), " "))
    messages = F.transform(F.filter(told, fit), lambda m: F.struct(role(m["author"]["role"]).alias("role"), text(m).alias("text"), epoch_iso(m["create_time"]).alias("timestamp")))
    once = F.explode(F.array(messages))  # a generator: the filter on messages below would otherwise compute them a second time
    title = strip(F.coalesce("title", F.lit("")))
    out = _branches(df).select("id", F.when(title.isin("", "New chat"), "Untitled").otherwise(title).alias("name"), epoch_iso(F.col("create_time")).alias("created_at"), F.lit(provider).alias("provider"), once.alias("messages"), "shard", "pos")
    w = Window.partitionBy("id").orderBy("shard", "pos")
    out = out.where(F.size("messages") > 0).withColumn("r", F.row_number().over(w)).where("r = 1")
    return (out if most is None else out.orderBy("shard", "pos").limit(most)).drop("r", "shard", "pos")


def unite(*sources: DataFrame) -> DataFrame:
    """Conversations of several sources, one after the other; an id that two of them have stays twice."""
    return reduce(DataFrame.unionByName, (s.select("id", "name", "created_at", "provider", "messages") for s in sources))


for _name, _reader in (("claude", read_claude), ("chatgpt", read_chatgpt), ("abacus", read_abacus)):
    register(_name, _reader)
