"""Column functions over message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+"
#: Words that never count as terms.
STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "this", "that", "was", "are", "be",
    "has", "had", "have", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "not", "no", "so", "if", "then", "than",
    "too", "very", "just", "about", "up", "out", "how", "what", "when", "where", "who", "which", "why", "all", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "only", "own", "same", "also", "into", "over", "after", "before", "between", "under", "again", "once", "here",
    "there", "any", "your", "my", "his", "her", "its", "our", "their", "me", "him", "them", "we", "you", "he", "she", "they", "i", "been", "being",
    "were", "am", "as", "well", "like", "even", "still", "now", "get", "got", "let", "make", "made", "want", "need", "use", "used", "using", "know",
    "think", "see", "way", "go", "going", "one", "two", "new", "first", "last", "long", "great", "much", "sure", "yes", "okay", "ok", "thanks",
    "thank", "please", "help", "right", "good", "really", "don", "doesn", "didn", "won", "something", "things", "thing", "work", "working", "code",
    "file", "example", "look", "take",
)


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def role(sender: Column) -> Column:
    return F.when(sender.isin("human", "user"), "user").otherwise("assistant")


def coalesce_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def flatten(content: Column) -> Column:
    """Text of a VARIANT: a string as it is; of an array its strings and the texts of its text parts; else ''."""
    items = F.try_variant_get(content, "$", "array<variant>")
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    part = lambda v: F.coalesce(plain(v), F.when(F.try_variant_get(v, "$.type", "string") == "text", F.try_variant_get(v, "$.text", "string")))
    return F.coalesce(F.when(items.isNotNull(), F.array_join(F.transform(items, part), " ")), plain(content), F.lit(""))


def strings(content: Column) -> Column:
    """Text of a VARIANT: of an array its strings alone, of an object nothing, of another value its form as a string."""
    items = F.try_variant_get(content, "$", "array<variant>")
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    other = F.when(~F.startswith(F.schema_of_variant(content), F.lit("OBJECT")), F.try_variant_get(content, "$", "string"))
    return F.coalesce(F.when(items.isNotNull(), F.array_join(F.transform(items, plain), " ")), other, F.lit(""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def short_id(prefix: str, text: Column) -> Column:
    """prefix and twelve hexadecimal digits that depend on text alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, 12))


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def excerpt(text: Column, size: int = 800) -> Column:
    cut = F.substring(text, 1, size)
    return F.when(F.length(cut) == size, F.concat(cut, F.lit("..."))).otherwise(cut)


def title(text: Column, size: int = 60) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


@F.pandas_udf(StringType())
def _unescape(text):
    from html import unescape

    return text.map(unescape, na_action="ignore")


def html_clean(html: Column, entities: bool = False) -> Column:
    """Text without scripts, styles and tags; white space collapsed.

    Common entities are decoded by built-in functions; with `entities`, all of them, in Arrow batches.
    """
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char)) if not entities else out
    if entities:
        return strip(F.regexp_replace(_unescape(out), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def chunk_words(text: Column, size: int = 150) -> Column:
    """Windows of `size` words; one chunk if the text has no more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= size, F.array(text)).otherwise(
        F.transform(F.array(words), lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / size).cast("int")), lambda k: F.array_join(F.slice(ws, k * size + 1, F.lit(size)), " ")))[0]
    )


def chunk_paragraphs(text: Column, size: int = 150) -> Column:
    """Paragraphs (split at blank lines) packed greedily into chunks of at most `size` words; a longer paragraph is
    cut in word windows; a text that fits is one chunk."""
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: strip(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, p):
        both = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        closed = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return (
            F.when(count(p) > size, F.struct(F.concat(closed, chunk_words(p, size)).alias("done"), F.lit("").alias("open")))
            .when(count(both) <= size, F.struct(a["done"].alias("done"), both.alias("open")))
            .otherwise(F.struct(closed.alias("done"), p.alias("open")))
        )

    packed = F.aggregate(paragraphs, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(count(text) <= size, F.array(text)).when(F.size(paragraphs) <= 1, chunk_words(text, size)).otherwise(packed)


def epoch_iso(seconds: Column) -> Column:
    """ISO-8601 UTC of epoch seconds; '' for null and zero; six fraction digits unless they are zero."""
    micros = F.round(seconds * 1e6).cast("long")
    at = F.timestamp_micros(micros)
    form = F.when(micros % 1000000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.when(seconds.isNull() | (seconds == 0), F.lit("")).otherwise(F.concat(form, F.lit("+00:00")))


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """text with each place of a query word of over two characters marked, whatever its case; words are marked one after the other."""
    for word in (w for w in query.split() if len(w) > 2):
        plain = word.replace("\\E", "\\E\\\\E\\Q")
        text = F.regexp_replace(text, f"(?iu)(\\Q{plain}\\E)", f"{before}$1{after}")
    return text


def inline_json(text: Column) -> Column:
    """JSON that can stand inside a page: '<' escaped."""
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))
