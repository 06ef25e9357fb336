"""Files as rows: whole files, export listings, archive members, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import file_name

ARCHIVE = r"data-\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}-batch-\d{4}\.zip$"


FILE = "path string, modificationTime timestamp, length long, content binary"


def listed(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def listing(spark: SparkSession, path: str, glob: str | None = None, deep: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files; their content is not read. Names with a leading '.' or '_' are hidden."""
    return files(spark, path, glob, deep).select("path", "modificationTime", "length")


def files(spark: SparkSession, path: str | list[str], glob: str | None = None, deep: bool = True) -> DataFrame:
    """Whole files: path, modificationTime, length and content; only selected columns are read. Empty files give no row."""
    options = {"recursiveFileLookup": deep} | ({"pathGlobFilter": glob} if glob else {})
    return spark.read.format("binaryFile").options(**options).load(path)


def text_of(content: Column) -> Column:
    """UTF-8 text; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def shards(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Paths of one export: the shards of a folder if there are any, also where conversations.json is named beside
    them; else the file itself. A glob stays a glob. Only names come to the driver, as they do in any listing."""
    if not isinstance(path, str):
        return path
    folder, _, last = path.rstrip("/").rpartition("/")
    if last.endswith(".json") and last != "conversations.json" or any(c in path for c in "*?["):
        return [path]
    folder = folder if last == "conversations.json" else path.rstrip("/")
    found = [r.path for r in listing(spark, folder, "conversations-*.json", deep=False).orderBy("path").collect()]
    return found or [path if last == "conversations.json" else f"{folder}/conversations.json"]


def find_exports(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, path, modificationTime): archives with an export's name that hold conversations.json, and
    conversations.json in the folder or one level under it; newest first."""
    top, below = listing(spark, folder, deep=False), listing(spark, f"{folder}/*", "conversations.json", deep=False)
    archives = files(spark, folder, "*.zip", deep=False).where(file_name(F.col("path")).rlike(f"^{ARCHIVE}"))
    zips = archives.where(F.array_contains(members(F.col("content")), "conversations.json")).select(F.lit("zip").alias("kind"), "path", "modificationTime")
    plain = top.where(file_name(F.col("path")) == "conversations.json").union(below).distinct()
    return zips.union(plain.select(F.lit("json"), "path", "modificationTime")).orderBy(F.desc("modificationTime"), "path")


def find_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of *.jsonl at any depth, without those named agent-*."""
    return listing(spark, folder, "*.jsonl").where(~F.startswith(file_name(F.col("path")), F.lit("agent-")))


def hashed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, sha) of whole files."""
    return files(spark, path, glob).select("path", F.sha2("content", 256).alias("sha"))


@F.pandas_udf(ArrayType(StringType()))
def members(content):
    """Names in a zip archive, in its order; null if it is none."""
    import io
    import zipfile

    def names(data):
        try:
            return zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, TypeError):
            return None

    return content.map(names)


def read_log(spark: SparkSession, path: str, n: int = 50, level: str | None = None) -> DataFrame:
    """(pos, level, message, line): the last n lines of a JSON-lines log, oldest first.

    Lines that are no JSON objects have the level RAW and pass any level filter. Places in the file order the lines, so no
    task sorts them all.
    """
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(at.alias("pos"), F.trim("value").alias("line")).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    get = lambda k: F.when(good, F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")))
    rows = lines.select("pos", F.coalesce(get("level"), F.lit("RAW")).alias("level"), F.coalesce(get("message"), F.col("line")).alias("message"), "line", good.alias("good"))
    if level:
        rows = rows.where(~F.col("good") | (F.col("level") == level))
    return rows.drop("good").orderBy(F.desc("pos")).limit(n).orderBy("pos")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names right under a folder, none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
