"""Readers of exports whose files are conversations: session logs, notebook pages, prompt files, activity logs, archives.

A file is one row, as is the conversation it holds; VARIANT columns carry JSON whose shape differs between files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.common import small_join, written
from ..streaming.sessions import sessionise
from .exports import MESSAGE, linearise, register, told, trees
from .files import files, listed, text_of
from .records import present, records

COLUMNS = ["id", "name", "created_at", "provider", "messages"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _message(who: Column, text: Column, at: Column) -> Column:
    return F.struct(who.alias("role"), text.alias("text"), at.alias("timestamp"))


def _first(df: DataFrame) -> DataFrame:
    """The conversation of the first path of each id."""
    w = Window.partitionBy("id").orderBy("path")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "path")


def read_sessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Coding sessions: a *.jsonl file is a conversation.

    Lines that do not parse, meta and side-chain records and blank texts are skipped; the last title record names
    it, else its first user text; files without a message give no row.
    """
    return sessions(files(spark, path, "*.jsonl").select("path", text_of(F.col("content")).alias("text")))


def sessions(texts: DataFrame) -> DataFrame:
    """Conversations of files (path, text)."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    v = F.col("v")
    rows = lines.select("path", "n", F.try_parse_json(F.trim("line")).alias("v")).where("v is not null").select(
        "path", "n", _get(v, "$.type").alias("type"), T.coalesce_text(_get(v, "$.aiTitle"), _get(v, "$.title")).alias("title"),
        F.coalesce(_get(v, "$.isMeta", "boolean"), F.lit(False)).alias("meta"), F.coalesce(_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("side"),
        T.strip(T.flatten(_get(v, "$.message.content", "variant"))).alias("text"), F.coalesce(_get(v, "$.timestamp"), F.lit("")).alias("at"),
    )
    told = F.col("type").isin("user", "assistant") & ~F.col("meta") & ~F.col("side") & (F.col("text") != "")
    said = F.array_sort(F.collect_list(F.when(told, F.struct("n", _message(F.col("type"), F.col("text"), F.col("at")).alias("m")))))
    named = F.max(F.when((F.col("type") == "ai-title") & (F.col("title") != ""), F.struct("n", "title")))["title"]
    out = rows.groupBy("path").agg(F.transform(said, lambda x: x["m"]).alias("messages"), named.alias("named")).where(F.size("messages") > 0)
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), 0)["text"]
    began = F.array_min(F.filter(F.transform("messages", lambda m: m["timestamp"]), lambda x: x != ""))
    name = T.coalesce_text(F.col("named"), T.title(F.coalesce(asked, F.get("messages", 0)["text"])))
    return out.select(F.concat(F.lit("local_"), T.file_stem(F.col("path"))).alias("id"), name.alias("name"), F.coalesce(began, F.lit("")).alias("created_at"), F.lit("claude-code").alias("provider"), "messages")


def read_notebooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Notebook chats: pages named "Chat Session - <id>.html"; turns begin at lines of USER: or MODEL:; the folder above names it."""
    glob = "*.html" if all(p.endswith(".html") for p in listed(path)) else "Chat Session*.html"
    return notebooks(files(spark, path, glob).select("path", text_of(F.col("content")).alias("text")))


def notebooks(df: DataFrame) -> DataFrame:
    """Conversations of pages (path, text)."""
    turn = r"(?md)^(?:USER|MODEL):[ \t]?"
    who, said = F.regexp_extract_all("text", F.lit(r"(?md)^(USER|MODEL):[ \t]?"), F.lit(1)), F.split("text", turn)
    turns = df.select("path", F.posexplode(F.zip_with(who, F.slice(said, F.lit(2), F.size(said)), lambda w, s: F.struct(w.alias("who"), s.alias("said")))).alias("n", "t"))
    turns = turns.select("path", "n", F.when(F.col("t.who") == "USER", "user").otherwise("assistant").alias("role"), T.html_clean(F.col("t.said"), entities=True).alias("text")).where("text <> ''")
    out = turns.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", _message(F.col("role"), F.col("text"), F.lit("")).alias("m")))).alias("ms"))
    stem = T.file_stem(F.col("path"))
    session = T.coalesce_text(F.regexp_extract(stem, r"Chat Session\s*-\s*([0-9a-f-]+)", 1), F.regexp_replace(stem, "[^0-9a-zA-Z-]", "_"))
    name = T.coalesce_text(F.try_element_at(F.split("path", "/"), F.lit(-3)), F.lit("NotebookLM Notebook"))
    return _first(out.select(F.concat(F.lit("notebooklm_"), session).alias("id"), name.alias("name"), F.lit("").alias("created_at"), F.lit("notebooklm").alias("provider"), F.transform("ms", lambda x: x["m"]).alias("messages"), "path"))


def _turns(v: Column, text) -> Column:
    """User and model turns of prompt files, thoughts and blank ones dropped."""
    chunks = F.filter(_get(v, "$.chunkedPrompt.chunks", "array<variant>"), lambda c: _get(c, "$.role").isin("user", "model") & ~F.coalesce(_get(c, "$.isThought", "boolean"), F.lit(False)))
    told = F.transform(chunks, lambda c: _message(F.when(_get(c, "$.role") == "user", "user").otherwise("assistant"), T.strip(F.coalesce(text(c), F.lit(""))), F.lit("")))
    return F.coalesce(F.filter(told, lambda m: m["text"] != ""), F.array().cast(f"array<{MESSAGE}>"))


def _parts(v: Column, path: str) -> Column:
    texts = F.transform(_get(v, path, "array<variant>"), lambda p: _get(p, "$.text"))
    return F.array_join(texts, " ")


def read_prompts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prompt files of a studio, with model and system_instruction; only those with a user and a model turn. Other files give no row."""
    return prompts(files(spark, path).select("path", text_of(F.col("content")).alias("text")))


def prompts(texts: DataFrame) -> DataFrame:
    """Conversations of files (path, text)."""
    df = texts.select("path", F.try_parse_json("text").alias("v")).where("v is not null")
    v, stem = F.col("v"), T.file_stem(F.col("path"))
    system = T.strip(T.coalesce_text(_get(v, "$.systemInstruction.text"), _parts(v, "$.systemInstruction.parts")))
    out = df.select(
        T.short_id("aistudio_", stem).alias("id"), stem.alias("name"), F.lit("").alias("created_at"), F.lit("aistudio").alias("provider"), _turns(v, lambda c: _get(c, "$.text")).alias("messages"),
        F.coalesce(_get(v, "$.runSettings.model"), F.lit("")).alias("model"), system.alias("system_instruction"), "path",
    )
    return _first(out.where(F.exists("messages", lambda m: m["role"] == "user") & F.exists("messages", lambda m: m["role"] == "assistant")))


#: Extensions of files that are attachments, not chats.
ATTACHMENTS = (
    "pdf", "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "mp4", "mov", "avi", "wav", "mp3", "ogg", "flac", "dmg", "zip", "tar", "gz", "rar",
    "7z", "py", "js", "ts", "tsx", "jsx", "css", "html", "htm", "json", "md", "txt", "rtf", "docx", "doc", "xlsx", "csv", "c", "cpp", "h", "java",
    "go", "rs", "rb", "php", "yaml", "yml", "toml", "xml", "ini", "cfg", "sh", "bash", "zsh", "bat", "ps1", "exe", "dll", "so", "dylib", "pem", "key",
    "crt", "cer", "sqlite", "db",
)


def read_prompt_folder(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The older layout of prompt files in one folder: texts in parts, the file's time as the date; not registered."""
    name = T.file_name(F.col("path"))
    ending = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    df = files(spark, path, deep=False).where(~ending.isin(*ATTACHMENTS)).select("path", "modificationTime", text.alias("text"))
    head = F.substring("text", 1, 2000)
    df = df.where(F.contains(head, F.lit('"chunkedPrompt"')) | F.contains(head, F.lit('"runSettings"'))).withColumn("v", F.try_parse_json("text"))
    sha, cut = F.sha2(name, 256), [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    title = F.when(F.length(name) > 100, F.concat(F.substring(name, 1, 97), F.lit("..."))).otherwise(name)
    out = df.select(
        F.concat_ws("-", *(F.substring(sha, a, n) for a, n in cut)).alias("id"), T.coalesce_text(F.when(F.trim(title) != "", title), F.lit("Untitled")).alias("name"),
        T.epoch_iso(F.col("modificationTime").cast("double")).alias("created_at"), F.lit("gemini").alias("provider"), _turns(F.col("v"), lambda c: _parts(c, "$.parts")).alias("messages"),
    )
    return out.where(F.size("messages") > 0)


def read_activity_page(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Activity entries (at, tz, prompt, response) of the HTML layout; entries without a prompt or a date are dropped."""
    return activity_of_pages(files(spark, path).select("path", text_of(F.col("content")).alias("text")))


def activity_of_pages(pages: DataFrame) -> DataFrame:
    """Activity entries of pages (text)."""
    cells = pages.select(F.explode(F.split("text", '<div class="outer-cell')).alias("cell"))
    asked = F.get(F.split("cell", "Prompted", 2), 1)
    stamp = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2})(?U:\s*)(AM|PM)(?U:\s*)([A-Z]{2,4})"
    df = cells.select(asked.alias("rest")).where("rest is not null").select("*", *(F.regexp_extract("rest", stamp, k).alias(x) for k, x in ((1, "day"), (2, "half"), (3, "tz"))), F.split("rest", stamp, 2).alias("sides"))
    tail = F.split(F.get("sides", 1), 'class="caption', 2)
    body = F.when((F.size(tail) == 2) & F.contains(tail[0], F.lit("<")), F.regexp_replace(tail[0], "(?s)<[^<]*$", "")).otherwise(F.get("sides", 1))
    response = T.strip(F.split(T.html_clean(body, entities=True), r"Products:\s*Gemini Apps", 2)[0])
    at = F.try_to_timestamp(F.concat_ws(" ", "day", "half"), F.lit("MMM d, yyyy, h:mm:ss a"))
    return df.select(at.alias("at"), "tz", T.html_clean(F.get("sides", 0), entities=True).alias("prompt"), response.alias("response")).where("prompt <> '' and at is not null")


def read_activity(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Activity entries (at, tz, prompt, response) of the JSON layout, an array of any size."""
    return activity_of_records(records(spark, listed(path)))


def activity_of_records(found: DataFrame) -> DataFrame:
    """Activity entries of records (text)."""
    df = found.select(F.from_json("text", "title string, time string, safeHtmlItem array<struct<html: string>>").alias("e")).select("e.*")
    prompt = T.strip(F.regexp_replace("title", "^(Prompted|Said) ", ""))
    response = T.html_clean(F.array_join(F.transform("safeHtmlItem", lambda x: x["html"]), " "), entities=True)
    return df.select(F.try_to_timestamp(F.regexp_replace("time", "Z$", "")).alias("at"), F.lit("UTC").alias("tz"), prompt.alias("prompt"), F.coalesce(response, F.lit("")).alias("response")).where("prompt <> '' and at is not null")


def group_activity(entries: DataFrame, since: str = "2023-03-01", minutes: int = 30) -> DataFrame:
    """Conversations of entries from `since` on: a gap over `minutes` begins a new one; the first entry names it.

    One account's entries share one timeline, so they are sorted in one window unless they carry a user_id.
    """
    df = entries.where(F.col("at") >= F.lit(since).cast("timestamp"))
    df = df if "user_id" in df.columns else df.withColumn("user_id", F.lit(0))
    iso = F.when(F.date_format("at", "SSSSSS") == "000000", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    df = sessionise(df.select("user_id", F.col("at").alias("ts"), F.xxhash64("prompt", "response").alias("event_id"), "prompt", "response", iso.alias("iso")), minutes)
    out = df.groupBy("user_id", "session").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "iso", "prompt", "response"))).alias("es"))
    turn = lambda e: F.array(_message(F.lit("user"), e["prompt"], e["iso"]), _message(F.lit("assistant"), e["response"], e["iso"]))
    said = F.filter(F.flatten(F.transform("es", turn)), lambda m: m["text"] != "")
    first = F.get("es", 0)
    return out.select(T.short_id("gemini_", F.concat_ws("|", first["iso"], first["prompt"])).alias("id"), T.title(first["prompt"]).alias("name"), first["iso"].alias("created_at"), F.lit("gemini").alias("provider"), said.alias("messages"))


def read_gemini(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Conversations of an activity log, HTML or JSON by its ending."""
    return group_activity((read_activity if listed(path)[0].endswith(".json") else read_activity_page)(spark, path))


def read_grok(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Conversations of JSON files and zip archives of any size; the first record of a file tells message trees from flat
    turns; files of another shape give no row. Of a list that stands for a text the strings count."""
    return grok(records(spark, listed(path)))


def grok(found: DataFrame) -> DataFrame:
    """Conversations of records (path, pos, text, v)."""
    v = F.col("v")
    first = found.groupBy("path").agg(F.min(F.struct("pos", present(v, "mapping").isNotNull().alias("trees"), present(v, "messages", "chat_messages").isNotNull().alias("flat"))).alias("f"))
    shaped = small_join(found, written(first.select("path", F.when(F.col("f.trees"), "trees").when(F.col("f.flat"), "flat").alias("shape"))), ["path"])
    get = lambda *keys: F.coalesce(_get(present(v, *keys), "$"), F.lit(""))
    turns = _get(present(v, "messages", "chat_messages"), "$", "array<variant>")
    messages = told(turns, lambda t: T.strings(present(t, "text", "content")), lambda t: F.coalesce(_get(present(t, "created_at", "timestamp"), "$"), F.lit("")), ("role", "sender"))
    flat = shaped.where("shape = 'flat'").select(get("id", "uuid").alias("id"), T.coalesce_text(get("title", "name"), F.lit("Untitled")).alias("name"), get("created_at", "create_time").alias("created_at"), F.lit("grok").alias("provider"), messages.alias("messages"))
    return linearise(trees(shaped.where("shape = 'trees'")), "grok").unionByName(flat.where((F.col("id") != "") & (F.size("messages") > 0)))


for _name, _reader in (("claude-code", read_sessions), ("notebooklm", read_notebooks), ("aistudio", read_prompts), ("gemini", read_gemini), ("grok", read_grok)):
    register(_name, _reader)
