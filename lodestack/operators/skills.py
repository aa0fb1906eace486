"""Rules over skills (front matter, body, files, manifest): a row for each rule that a skill breaks, without a join or shuffle of its own."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import skill_rules as S

Check = tuple[str, str, Column]


def broken(rows: DataFrame, checks: Sequence[Check], keep: Sequence[str]) -> DataFrame:
    """(keep, code, severity) for each (code, severity, condition) that holds; a null condition does not."""
    found = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in checks]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keep, "_f.code", "_f.severity")


def any_in(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def structure_checks(name: Column, folder: Column, description: Column, compatibility: Column, metadata: Column, body: Column) -> list[Check]:
    """Checks of front matter and body. Columns are text; metadata is a map as JSON text."""
    some, told = F.coalesce(name, F.lit("")) != "", F.coalesce(description, F.lit("")) != ""
    words = F.regexp_count(body, F.lit(r"[^\s]+"))
    return [
        ("STR-005", "CRITICAL", ~some), ("STR-006", "WARNING", some & (F.length(name) > 64)), ("STR-007", "WARNING", some & ~name.rlike(S.NAME)),
        ("STR-008", "INFO", some & (name != folder)), ("STR-018", "WARNING", some & any_in(name, S.RESERVED)),
        ("STR-009", "CRITICAL", ~told), ("STR-010", "WARNING", told & (F.length(description) > 1024)), ("STR-011", "WARNING", told & (F.length(description) < 20)),
        ("STR-019", "WARNING", told & description.rlike(S.TAG)), ("STR-020", "INFO", told & (description.rlike(S.FIRST_PERSON) | description.rlike(S.SECOND_PERSON))),
        ("STR-012", "WARNING", F.length(compatibility) > 500),
        ("STR-013", "WARNING", metadata.isNotNull() & ~F.coalesce(F.trim(metadata).startswith("{") & F.get_json_object(metadata, "$").isNotNull(), F.lit(False))),
        ("STR-014", "INFO", F.size(F.split(body, "\n", -1)) > 500), ("STR-015", "INFO", F.floor(F.length(body) / 4) > 5000),
        ("STR-021", "INFO", F.floor(words * 1.3) > 4000),
    ]


def strip_code(text: Column) -> Column:
    """Text without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`]*`", "")


def quality_checks(name: Column, folder: Column, description: Column, tools: Column, body: Column) -> list[Check]:
    told = F.trim(description) != ""
    bare = F.filter(F.regexp_extract_all(body, F.lit("(" + S.BARE_TOOL + ")"), 1), lambda x: F.size(F.split(x, "__", -1)) < 3)
    entries = F.filter(F.split(F.trim(tools), r"\s+", -1), lambda x: (x != "") & ~x.rlike(S.TOOL_ENTRY))
    generic = F.arrays_overlap(F.split(F.lower(name), "-+", -1), F.array(*map(F.lit, S.GENERIC_WORDS)))
    return [
        ("QLT-001", "INFO", told & ~description.rlike(r"(?i)^\s*Use when\b")), ("QLT-002", "WARNING", told & (F.length(F.trim(description)) < 60)),
        ("QLT-003", "WARNING", told & (F.regexp_count(description, F.lit(S.WORKFLOW)) >= 3)),
        ("QLT-004", "INFO", (name != "") & generic), ("QLT-005", "INFO", folder.contains("_")),
        ("QLT-007", "WARNING", body.rlike(S.WINDOWS_PATH)), ("QLT-013", "INFO", F.size(bare) > 0), ("QLT-014", "WARNING", F.size(entries) > 0),
        ("QLT-016", "WARNING", any_in(F.lower(strip_code(body)), S.TEMPLATE_MARKERS)),
        ("QLT-017", "INFO", ~body.contains("```") & ~body.rlike(r"(?im)^#+\s*(?:example|examples)\b")),
        ("QLT-018", "WARNING", F.trim(F.regexp_replace(body, r"\s+", " ")) == ""),
    ]


def tool_scope(tools: Column) -> Column:
    """(unscoped, high, n) of an allowed-tools text: tools that give a whole shell, other tools of high risk, and all."""
    each = F.filter(F.split(F.coalesce(tools, F.lit("")), r"\s+", -1), lambda x: x != "")
    unscoped = F.filter(each, lambda x: x.isin(*S.SHELLS))
    high = F.filter(each, lambda x: x.isin(*[t for t, r in S.TOOL_RISKS.items() if r == "high"]))
    return F.struct(F.size(unscoped).alias("unscoped"), F.size(F.array_except(high, unscoped)).alias("high"), F.size(each).alias("n"))


def permission_checks(tools: Column) -> list[Check]:
    t = tool_scope(tools)
    return [("PERM-001", "WARNING", t["unscoped"] > 0), ("PERM-002", "INFO", (t["unscoped"] == 0) & (t["high"] > 0)), ("PERM-003", "INFO", t["n"] > 15)]


def manifest_issues(m: DataFrame, keep: Sequence[str], api_version: str) -> DataFrame:
    """(keep, code, severity, path) of manifests with columns api_version, kind, name, version, description, category, content_path,
    content_inline, params array<struct<name,type,values>>, capabilities array<string>."""
    c = F.col
    issue = lambda code, severity, path: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"))
    at = F.lit
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    named = ~blank(c("name")) & ~c("name").rlike(S.NAMESPACED)
    one = [
        F.when(~c("api_version").eqNullSafe(api_version), issue("VAL-APIVERSION", "error", at("apiVersion"))), F.when(~c("kind").eqNullSafe("Skill"), issue("VAL-KIND", "error", at("kind"))),
        F.when(blank(c("name")), issue("VAL-NAME-REQUIRED", "error", at("metadata.name"))), F.when(blank(c("description")), issue("VAL-DESC-REQUIRED", "error", at("metadata.description"))),
        F.when(~F.coalesce(c("version"), F.lit("")).rlike(S.SEMVER), issue("VAL-SEMVER", "error", at("metadata.version"))),
        F.when(named & ~c("name").rlike(S.BARE_NAME), issue("VAL-NAME-FORMAT", "error", at("metadata.name"))),
        F.when(named & c("name").rlike(S.BARE_NAME), issue("VAL-NAME-NO-NAMESPACE", "warning", at("metadata.name"))),
        F.when(~c("category").isin(*S.CATEGORIES), issue("VAL-CAT-UNKNOWN", "warning", at("metadata.category"))),
        F.when(~blank(c("content_path")) & ~blank(c("content_inline")), issue("VAL-CONTENT-BOTH", "error", at("spec.content"))),
        F.when(blank(c("content_path")) & blank(c("content_inline")), issue("VAL-CONTENT-EMPTY", "error", at("spec.content"))),
    ]
    place = lambda i, field: F.concat(F.lit("spec.parameters["), i.cast("string"), F.lit(f"].{field}"))
    types = F.transform("params", lambda p, i: F.when(~p["type"].isin(*S.PARAM_TYPES), issue("VAL-PARAM-TYPE", "error", place(i, "type"))))
    enums = F.transform("params", lambda p, i: F.when((p["type"] == "enum") & (F.coalesce(F.size(p["values"]), F.lit(0)) <= 0), issue("VAL-PARAM-ENUM", "error", place(i, "values"))))
    caps = F.transform("capabilities", lambda x, i: F.when(~x.isin(*S.CAPABILITIES), issue("VAL-CAP-UNKNOWN", "warning", F.concat(F.lit("spec.capabilities["), i.cast("string"), F.lit("]")))))
    found = F.array_compact(F.concat(F.array(*one), types, enums, caps))
    return m.select(*keep, F.explode(found).alias("_i")).select(*keep, "_i.code", "_i.severity", "_i.path")


def capability_hints(content: Column, declared: Column) -> Column:
    """Capabilities that the content suggests and the manifest doesn't declare, each once."""
    return F.array_compact(F.array(*[
        F.when(reduce(Column.__or__, [content.rlike(p) for p in ps]) & ~F.array_contains(declared, cap), cap) for cap, ps in S.CAPABILITY_HINTS.items()
    ]))


def magic_number(line: Column) -> Column:
    """Whether a line of code sets a number of two digits or more whose name and comment don't explain it."""
    part = lambda i: F.regexp_extract(line, S.ASSIGNED_NUMBER, i)
    return line.rlike(S.ASSIGNED_NUMBER) & (F.length(part(2)) >= 2) & ~part(1).rlike(S.EXPLAINING_NAME) & ~any_in(F.lower(part(3)), S.EXPLAINING_WORDS)


def prefix_counts(found: DataFrame, by: str, prefixes: Sequence[str] = ("STR-", "SEC-", "PERM-", "QLT-")) -> DataFrame:
    return found.groupBy(by).agg(*[F.count_if(F.col("code").startswith(p)).alias(p.rstrip("-").lower()) for p in prefixes])


def explained(found: DataFrame, exact: Mapping[str, str], by_prefix: Mapping[str, str]) -> DataFrame:
    """found with explanation: that of its code, else that of the code's part before the first hyphen (mappings of a few codes)."""
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return found.withColumn("explanation", F.coalesce(F.try_element_at(lookup(exact), F.col("code")), F.try_element_at(lookup(by_prefix), F.substring_index("code", "-", 1))))


def exit_code(worst: Column, warnings: Column, strict: bool = False) -> Column:
    """2 for a critical finding, 1 for a warning under strict rules, else 0."""
    return F.when(worst > 0, 2).when(F.lit(strict) & (warnings > 0), 1).otherwise(0)
