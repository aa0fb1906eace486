"""Catalogue verbs as queries: push, pull, revocation, gates, listings, differences, states of files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import skill_rules as S
from lodestack.functions.scalars import BREAKS, escape_message, escape_parameter


def push(index: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new with status: added, or E_ALREADY_EXISTS where the index has its key. Keys of new are unique."""
    known = index.select(*key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, list(key), "left").withColumn("status", F.when(F.col("_known"), "E_ALREADY_EXISTS").otherwise("added")).drop("_known")


def pull(index: DataFrame, blobs: DataFrame, digest: str, content: str) -> DataFrame:
    """index with content and status: E_NOT_FOUND without a blob, E_INTEGRITY where the blob's hash is another, ok."""
    held = blobs.select(F.col(digest), F.col(content).alias("_content"), F.lit(True).alias("_held"))
    status = F.when(F.col("_held").isNull(), "E_NOT_FOUND").when(~F.sha2("_content", 256).eqNullSafe(F.col(digest)), "E_INTEGRITY").otherwise("ok")
    return index.join(held, digest, "left").withColumn("status", status).withColumn(content, F.col("_content")).drop("_held", "_content")


def revoke(tokens: DataFrame, revoked: DataFrame, key: str, at: str) -> DataFrame:
    """tokens with revoked_at filled for keys in revoked that have none, and changed: whether that happened."""
    asked = revoked.select(key).distinct().withColumn("_asked", F.lit(True))
    changed = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("revoked_at").isNull()
    out = tokens.join(asked, key, "left").withColumn("changed", changed)
    return out.withColumn("revoked_at", F.when(F.col("changed"), at).otherwise(F.col("revoked_at"))).drop("_asked")


def allowed_namespaces(permissions: Column) -> Column:
    """Namespaces that permissions name; null stands for all, an empty array for none."""
    every = F.arrays_overlap(permissions, F.array(F.lit("admin"), F.lit("read:*"), F.lit("write:*")))
    return F.when(~every, F.array_distinct(F.transform(permissions, lambda p: F.substring_index(p, ":", -1))))


def first_failed(gates: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition holds; null where all pass."""
    return F.coalesce(*[F.when(c, name) for name, c in gates])


def listing(
    rows: DataFrame, prefix: tuple[str, str] | None = None, tag: tuple[str, str] | None = None, order: Sequence[str] = (), limit: int = 100, offset: int = 0, most: int = 500,
) -> DataFrame:
    """A page of rows by a prefix of one column and a member of another (without case); limit is held to 1..most, offset to 0..100000."""
    if prefix:
        rows = rows.where(F.col(prefix[0]).startswith(prefix[1]))
    if tag:
        rows = rows.where(F.exists(F.col(tag[0]), lambda t: F.lower(t) == tag[1].lower()))
    return rows.orderBy(*order).offset(min(max(offset, 0), 100_000)).limit(min(max(limit, 1), most))


def metadata_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new) of keys whose values differ; a missing key has a null."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def lifecycle(fingerprint: Column, last: Column) -> Column:
    return F.when(last.isNull(), "initial").when(last == fingerprint, "unchanged").otherwise("changed")


def regression_passed(new_critical: Column, score: Column, baseline: Column, allowed: int = 5) -> Column:
    return (new_critical == 0) & (score >= baseline - allowed)


def install_states(tracked: DataFrame, there: DataFrame, key: str, recorded: str, found: str) -> DataFrame:
    """(key, state) of files that are recorded or there: missing, untracked, modified or unchanged."""
    both = tracked.withColumn("_t", F.lit(True)).join(there.withColumn("_f", F.lit(True)), key, "full_outer")
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_t").isNull(), "untracked").when(~F.col(recorded).eqNullSafe(F.col(found)), "modified").otherwise("unchanged")
    return both.select(key, state.alias("state"))


def file_flags(files: DataFrame, by: str, path: Column) -> DataFrame:
    """(by, generic, languages, many_languages, readme): counts of generic names and of languages of example files."""
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    example = F.when(name.startswith("example") & suffix.isin(*S.CODE_SUFFIXES), suffix)
    out = files.groupBy(by).agg(F.count_if(name.rlike(S.GENERIC_FILE)).alias("generic"), F.count_distinct(example).alias("languages"), F.bool_or(name == "README.md").alias("readme"))
    return out.withColumn("many_languages", F.col("languages") >= 3)


def payload_findings(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, number, severity) of lines of scripts: a decoder (critical with eval or exec on the line), or a long base64 string with one near."""
    near = Window.partitionBy(file).orderBy(number).rowsBetween(-1, 2)
    text = F.col(line)
    called = text.rlike(S.EVAL)
    decoded = [F.when(text.rlike(p), F.when(called, "CRITICAL").otherwise("WARNING")) for p in S.DECODERS]
    hidden = F.when(text.rlike(S.LONG_BASE64) & F.col("_near").rlike(S.EVAL), "CRITICAL")
    framed = lines.withColumn("_near", F.array_join(F.collect_list(line).over(near), "\n"))
    return framed.select(file, number, F.explode(F.array_compact(F.array(*decoded, hidden))).alias("severity"))


def log_page(log: DataFrame, at: str, since: str | None = None, until: str | None = None, action: tuple[str, str] | None = None, holds: tuple[str, str] | None = None, order: str = "seq", first: int = 100) -> DataFrame:
    """The first entries, in file order, whose time (as text) is in a range, with an action and a part of a resource."""
    for bound, c in ((since, F.col(at) >= since if since else None), (until, F.col(at) <= until if until else None)):
        log = log.where(c) if bound else log
    if action:
        log = log.where(F.col(action[0]) == action[1])
    if holds:
        log = log.where(F.contains(F.col(holds[0]), F.lit(holds[1])))
    return log.orderBy(order).limit(first)


def resolved_targets(asked: Column, aliases: dict[str, str], every: Sequence[str]) -> Column:
    """Targets of an array of names: all stands for every, aliases for their target; sorted, each once."""
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    one = lambda t: F.when(t == "all", F.array(*map(F.lit, every))).otherwise(F.array(F.coalesce(F.try_element_at(names, t), t)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(asked, one))))


def import_status(path: Column, known: Column, has_manifest: Column, has_text: Column) -> Column:
    """unsafe (an absolute path or one with two dots), error (a file is missing), skipped (the name and version are known) or imported."""
    return F.when(path.startswith("/") | F.contains(path, F.lit("..")), "unsafe").when(~has_manifest | ~has_text, "error").when(known, "skipped").otherwise("imported")


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column taken from changes where those have the key; keys of changes are unique."""
    new = changes.select(F.col(key), F.col(column).alias("_new"), F.lit(True).alias("_changed"))
    return rows.join(new, key, "left").withColumn(column, F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_changed")


def annotations(found: DataFrame, by: str) -> DataFrame:
    """(by, level, message): a line for each finding that is no INFO, and one notice with the number and codes of those left out."""
    loud = found.where("severity <> 'INFO'").select(by, F.when(F.col("severity") == "CRITICAL", "error").otherwise("warning").alias("level"), F.col("code").alias("message"))
    n = F.count(F.lit(1))
    codes = F.array_join(F.array_sort(F.collect_set("code")), ", ")
    message = F.concat(n.cast("string"), F.when(n == 1, " INFO finding").otherwise(" INFO findings"), F.lit(" suppressed ("), codes, F.lit(")"))
    quiet = found.where("severity = 'INFO'").groupBy(by).agg(message.alias("message")).select(by, F.lit("notice").alias("level"), "message")
    return loud.unionByName(quiet)


def workflow_line(level: Column, file: Column, line: Column, title: Column, body: Column) -> Column:
    """A command line of a continuous-integration log: ::level file=...,line=...,title=...::body, escaped. A line stands only with a file and above 0."""
    named = F.coalesce(file, F.lit("")) != ""
    where = F.concat_ws(",", F.when(named, F.concat(F.lit("file="), escape_parameter(file))), F.when(named & (line > 0), F.concat(F.lit("line="), line.cast("string"))), F.concat(F.lit("title="), escape_parameter(title)))
    return F.concat(F.lit("::"), level, F.lit(" "), where, F.lit("::"), escape_message(body))


def report(found: DataFrame, by: str) -> DataFrame:
    """(by, text): the findings of each as lines under their severity, the worst first, then by line number, code and title; a heading counts its own."""
    rank = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}
    order = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in rank.items()], F.lit(len(rank)))
    one = F.struct(order.alias("r"), "severity", F.coalesce("line_number", F.lit(0).cast("long")).alias("at"), "code", "title")
    rows = found.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("f"))  # findings of one text
    part = lambda s: F.filter("f", lambda x: x["severity"] == s)
    text = lambda x: F.concat(F.lit("  "), x["code"], F.when(x["at"] > 0, F.concat(F.lit(" line "), x["at"].cast("string"))).otherwise(""), F.lit(": "), x["title"])
    blocks = [F.when(F.size(part(s)) > 0, F.concat(F.lit(f"{s} ("), F.size(part(s)).cast("string"), F.lit(")\n"), F.array_join(F.transform(part(s), text), "\n"))) for s in rank]
    return rows.select(by, F.concat_ws("\n", *blocks).alias("text"))


def broken_links(docs: DataFrame, files: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, target, problem) of relative Markdown links: broken without such a file, deep over two parts of path."""
    link = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1)).alias("_l"))
    link = link.where(~F.col("_l").rlike("^(?:https?://|mailto:|#)")).select(key, F.regexp_extract("_l", r"^([^#?]*)", 1).alias("target")).where("target <> ''")
    there = files.select(key, F.col(path).alias("target")).distinct().withColumn("_there", F.lit(True))
    problem = F.when(F.col("_there").isNull(), "broken").when(F.size(F.split("target", "/", -1)) > 2, "deep")
    return link.join(there, [key, "target"], "left").select(key, "target", problem.alias("problem")).where("problem IS NOT NULL")


def file_findings(files: DataFrame, keep: Sequence[str], path: Column, text: Column, referenced: Column) -> DataFrame:
    """(keep, code) of files beside a skill's own: a readme (STR-016), scripts without a first line that names an interpreter (STR-017),
    and long referenced Markdown files without a table of contents in their first lines (QLT-008). A null text breaks no rule of content."""
    script = path.startswith("scripts/") & path.rlike(r"\.(?:py|sh)$")
    head = F.array_join(F.slice(F.split(text, rf"\r\n|{BREAKS}", S.HEAD_LINES + 1), 1, S.HEAD_LINES), "\n")
    long = path.rlike(r"(?i)\.md$") & (F.regexp_count(text, F.lit("\n")) > S.LONG_REFERENCE)
    checks = [("STR-016", path == "README.md"), ("STR-017", script & ~text.startswith("#!")), ("QLT-008", referenced & long & ~head.rlike(S.CONTENTS))]
    return files.select(*keep, F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in checks]))).alias("code"))


def nearest_config(folders: DataFrame, configs: DataFrame, key: str, folder: str, levels: int = 20) -> DataFrame:
    """folders with config: that of the nearest folder on the way up, itself included, at most `levels` folders; null without.
    Paths are parts between slashes; configs (folder, config) has a row a folder. A folder gives a row for each of its own parents only."""
    parts = F.split(folder, "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(levels)) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - i), "/").alias("_at"), i.alias("_up")))
    each = folders.select(key, F.inline(up))
    found = each.join(configs.select(F.col(folder).alias("_at"), "config"), "_at").groupBy(key).agg(F.min_by("config", "_up").alias("config"))
    return folders.join(found, key, "left")
