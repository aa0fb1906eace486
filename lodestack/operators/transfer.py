"""Import of archives into a catalogue."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import manifests
from lodestack.sources.archives import read_archives
from lodestack.sources.tables import new_folder

#: Errors of a manifest that keep an entry out; where its content lies is of no matter, since archives bring their own.
_FATAL = ("E_NO_MANIFEST", "E_INVALID_YAML", "E_MANIFEST_FIELDS")
_INDEX = "array<struct<name: string, version: string>>"


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, f"import-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def import_archives(members: DataFrame, known: DataFrame, api_version: str, section: str) -> DataFrame:
    """(archive, name, version, status, error, content, manifest): a row for each entry of each archive's index, or one for an archive that is refused.

    members are rows of sources.archives; known has (name, version) of what the catalogue holds. An archive with an unsafe
    member, that can't be read to its end, or without a readable index.json is refused as a whole. An entry without
    skill.yaml or SKILL.md, or whose manifest can't be loaded, is an error; one whose manifest's name and version are known, or are those of an
    earlier entry (by archive, then place in the index), is skipped; all others are imported. Members are read once.
    """
    members = _saved(members, "members")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    archives = members.groupBy("archive").agg(
        F.max(F.col("status") == "corrupt").alias("corrupt"), F.max(F.col("status") == "unsafe").alias("unsafe"), F.max(F.when(F.col("member") == "index.json", text)).alias("index"),
    )
    entries = F.when(F.ltrim("index").startswith("["), F.from_json("index", _INDEX))
    why = F.when(F.col("corrupt"), "corrupt").when(F.col("unsafe"), "unsafe path").when(F.col("index").isNull(), "no index.json").when(F.col("entries").isNull(), "bad index.json")
    archives = archives.withColumn("entries", entries).withColumn("why", why)
    refused = archives.where("why IS NOT NULL").select("archive", F.concat(F.lit("E_INVALID_ARCHIVE: "), "why").alias("error"))
    listed = archives.where("why IS NULL").select("archive", F.posexplode("entries").alias("pos", "e"))
    listed = listed.select("archive", "pos", F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.version", F.lit("")).alias("version"))
    listed = listed.withColumn("_folder", F.concat("archive", F.lit("!skills/"), "name", F.lit("@"), "version"))

    pattern = r"^(skills/.+)/(SKILL\.md|skill\.yaml)$"
    files = members.where((F.col("status") == "ok") & F.col("member").rlike(pattern)).select(
        F.concat("archive", F.lit("!"), F.regexp_extract("member", pattern, 1)).alias("folder"), F.regexp_extract("member", pattern, 2).alias("name"), "content", text.alias("text"),
    )
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("content")))
    held = files.groupBy(F.col("folder").alias("_f")).agg(of("SKILL.md").alias("content"), of("skill.yaml").alias("manifest"))
    read = _saved(manifests.load(files.where("name = 'skill.yaml'"), api_version, section).select(F.col("folder").alias("_m"), F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("error").alias("_bad")), "manifests")
    rows = listed.join(held, F.col("_folder") == F.col("_f"), "left").join(read, F.col("_folder") == F.col("_m"), "left")
    missing = F.when(F.col("manifest").isNull(), "skill.yaml not found in archive").when(F.col("content").isNull(), "SKILL.md not found in archive")
    rows = rows.withColumn("error", F.coalesce(missing, F.when(F.col("_bad").isin(*_FATAL), F.col("_bad"))))
    # of entries with one key the first counts: a minimum, so that a key with many entries is no task's alone
    first = rows.where("error IS NULL").groupBy(F.col("_name").alias("_n"), F.col("_version").alias("_v")).agg(F.min(F.struct("archive", "pos")).alias("_first"))
    there = known.select(F.col("name").alias("_kn"), F.col("version").alias("_kv")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(first, (F.col("_name") == F.col("_n")) & (F.col("_version") == F.col("_v")), "left").join(there, (F.col("_name") == F.col("_kn")) & (F.col("_version") == F.col("_kv")), "left")
    again = F.col("_known").isNotNull() | (F.col("_first") != F.struct("archive", "pos"))
    status = F.when(F.col("error").isNotNull(), "error").when(again, "skipped").otherwise("imported")
    out = rows.select("archive", F.coalesce("_name", "name").alias("name"), F.coalesce("_version", "version").alias("version"), status.alias("status"), "error", "content", "manifest")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("version", "string"))]
    blobs = [F.lit(None).cast("binary").alias(c) for c in ("content", "manifest")]
    return out.unionByName(refused.select("archive", *none, F.lit("refused").alias("status"), "error", *blobs))


def import_path(spark, path: str, known: DataFrame, api_version: str, section: str, **options) -> DataFrame:
    return import_archives(read_archives(spark, path, **options), known, api_version, section)
