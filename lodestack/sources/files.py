"""Files as tables: text trees, JSON-lines logs, blobs by hash."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Folders that hold no text of their own, and suffixes of text.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build")
TEXT = (".md", ".txt", ".py", ".sh", ".js", ".ts", ".json", ".yaml", ".yml", ".toml", ".bash", ".rst", ".env")


def text_files(spark: SparkSession, root: str, largest: int = 1_000_000, suffixes: Sequence[str] = TEXT) -> DataFrame:
    """(path, length, text, skipped) of every file under root; path is relative to it.

    skipped says why text is null: "folder" (a skipped folder below root), "type", "size" (over largest) or "encoding"
    (not UTF-8). Files are listed without their contents first; contents are read of files with a suffix of text and
    at most `largest` bytes only. Spark's file sources list no names that begin with . or _, so such files (__init__.py,
    .env) have no row here: rename or copy them before an audit that must see them.
    """
    letters = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    texts = files.option("pathGlobFilter", "*{" + ",".join(map(letters, suffixes)) + "}").load(root).where(F.col("length") <= largest)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    depth = len(root.rstrip("/").split("://")[-1].strip("/").split("/"))

    def described(df: DataFrame) -> DataFrame:
        tail = F.slice(F.filter(F.split("path", "/", -1), lambda x: (x != F.lit("")) & ~x.endswith(":")), depth + 1, 1 << 20)
        folders = F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))
        typed = F.regexp_extract(F.lower(F.element_at(tail, -1)), r"(\.[a-z0-9]+)$", 1).isin(list(suffixes))
        why = F.when(F.exists(folders, lambda x: x.isin(list(SKIPPED))), "folder").when(~typed, "type").when(F.col("length") > largest, "size")
        return df.withColumn("_why", why).withColumn("path", F.array_join(tail, "/"))

    read = described(texts).where("_why IS NULL").select("path", "length", F.col("content").cast("string").alias("text"))
    good = F.is_valid_utf8(F.col("text"))
    read = read.select("path", "length", F.when(good, F.col("text")).alias("text"), F.when(~good, "encoding").alias("skipped"))
    return read.unionByName(described(listed).where("_why IS NOT NULL").select("path", "length", F.lit(None).cast("string").alias("text"), F.col("_why").alias("skipped")))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, malformed: str | None = None) -> DataFrame:
    """Rows of a JSON-lines log; blank lines are left out, and fields that schema has not are dropped.

    A line is malformed if it is no JSON object or one of its fields is not of its type. Such lines are left out too, or, with a name
    for it in `malformed`, are rows of nulls with the line in that column, which is null in all others.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("value", StructType([*fields.fields, StructField("_bad", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select("value", parsed.alias("r"))
    good = F.ltrim("value").startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    named = [F.when(F.col("_good"), F.col("r")[f.name]).alias(f.name) for f in fields.fields]
    if malformed is None:
        return rows.where("_good").select(*named)
    return rows.select(*named, F.when(~F.col("_good"), F.col("value")).alias(malformed))


def store_blobs(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Append the contents that path has not, partitioned by the hash's first two digits; returns what was new."""
    spark = docs.sparkSession
    new = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("content")).distinct().withColumn("hash", F.sha2("content", 256)).withColumn("prefix", F.left("hash", F.lit(2)))
    try:
        known = spark.read.parquet(path).select("hash")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(known, "hash", "left_anti")
    new.write.partitionBy("prefix").mode("append").parquet(path)
    return new
