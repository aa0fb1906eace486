"""Audits of texts: line rules to findings, findings to scores and grades. No step but explode changes the row count."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.rules import EXEMPT, EXEMPT_OF, FENCE, FENCED, NEEDED, SAFE_DOMAINS, Rule

WEIGHTS = {"CRITICAL": 25, "WARNING": 10, "INFO": 2}


def any_of(patterns: Sequence[str]) -> str:
    """One pattern that matches where any does."""
    return "|".join(f"(?:{p})" for p in patterns)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hit(line: Column, rule: Rule) -> Column:
    found = line.rlike(rule.pattern)
    but = EXEMPT_OF.get(rule.name) or EXEMPT.get(rule.code)
    return found & ~line.rlike(any_of(but)) if but else found


def may_hit(low: Column, rule: Rule) -> Column:
    """Whether a lower-cased text holds one of the literals that every match of the rule has."""
    return reduce(Column.__or__, [low.contains(x) for x in NEEDED[rule.name]]) if rule.name in NEEDED else F.lit(True)


def findings(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_number, code, severity, title): one row for each rule that a line breaks.

    Only texts and lines with a literal that some rule needs are matched against patterns. Null texts have no findings.
    """
    low = docs.select(id_col, F.col(text_col).alias("_text"), F.lower(text_col).alias("_low"))
    some = low.where(reduce(Column.__or__, [may_hit(F.col("_low"), r) for r in rules]))
    cut = some.select(id_col, F.posexplode(lines(F.col("_text"))).alias("at", "line")).select(id_col, "at", "line", F.lower("line").alias("_low"))
    broken = [F.when(may_hit(F.col("_low"), r) & hit(F.col("line"), r), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("title"))) for r in rules]
    out = cut.select(id_col, (F.col("at") + 1).cast("long").alias("line_number"), F.explode(F.array_compact(F.array(*broken))).alias("f"))
    return out.select(id_col, "line_number", "f.code", "f.severity", "f.title")


def count_hits(cut: Column, low: Column, rules: Sequence[Rule]) -> Column:
    """How many (line, rule) pairs of an array of lines break a rule; low: the lower-cased text. No explode, no shuffle."""

    def broken(rule: Rule) -> Column:
        return F.when(may_hit(low, rule), F.size(F.filter(cut, lambda x: hit(x, rule)))).otherwise(0)

    return F.coalesce(reduce(Column.__add__, map(broken, rules)), F.lit(0)).cast("long")


def fenced(text: Column) -> Column:
    """Numbers of the lines inside fenced blocks that break the rule for them, computed in the row."""
    seen = F.transform(lines(text), lambda x, i: F.struct(x.rlike(FENCE).alias("fence"), x.rlike(FENCED.pattern).alias("hit"), (i + 1).cast("long").alias("at")))
    none = F.array().cast("array<long>")

    def step(a: Column, x: Column) -> Column:
        hits = F.when(a["open"] & x["hit"] & ~x["fence"], F.concat(a["hits"], F.array(x["at"]))).otherwise(a["hits"])
        return F.struct((a["open"] != x["fence"]).alias("open"), hits.alias("hits"))

    found = F.aggregate(seen, F.struct(F.lit(False).alias("open"), none.alias("hits")), step, lambda a: a["hits"])
    return F.when(text.contains("```") & text.rlike(FENCED.pattern), found).otherwise(none)


def fenced_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = docs.select(id_col, F.explode(fenced(F.col(text_col))).alias("line_number"))
    return out.select(id_col, "line_number", *[F.lit(v).alias(k) for k, v in (("code", FENCED.code), ("severity", FENCED.severity), ("title", FENCED.name))])


def dated_section(text: Column, dated: str, old: str) -> Column:
    """Heading of the first section with a dated phrase; null if there is none. Sections with an old heading, and what is before the first, don't count."""
    sections = F.split(text, r"(?md)^#+\s+", -1)
    heading = lambda x: F.substring_index(x, "\n", 1)
    found = F.filter(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))), lambda x: x.rlike(dated) & ~heading(x).rlike(old))
    return F.when(F.size(found) > 0, F.trim(heading(found[0])))


def severity_score(critical: Column, warning: Column, info: Column) -> Column:
    return F.greatest(F.lit(0), 100 - WEIGHTS["CRITICAL"] * critical - WEIGHTS["WARNING"] * warning - WEIGHTS["INFO"] * info).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def audit(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text", fences: bool = False) -> DataFrame:
    """docs' id and (critical, warning, info, score, grade, passed); a text without findings scores 100. fences: with the rule for fenced blocks."""
    by = {s: [r for r in rules if r.severity == s] for s in WEIGHTS}
    more = {FENCED.severity: F.size(fenced(F.col(text_col))).cast("long")} if fences else {}
    counts = [((count_hits(F.col("_lines"), F.col("_low"), by[s]) if by[s] else F.lit(0).cast("long")) + more.get(s, F.lit(0).cast("long"))).alias(s.lower()) for s in WEIGHTS]
    out = docs.withColumn("_lines", lines(F.col(text_col))).withColumn("_low", F.lower(text_col)).select(*[c for c in docs.columns if c != text_col], *counts)
    out = out.withColumn("score", severity_score(F.col("critical"), F.col("warning"), F.col("info")))
    return out.withColumn("grade", grade(F.col("score"))).withColumn("passed", F.col("critical") == 0)


def configure(found: DataFrame, ignore: Sequence[str] = (), severities: Mapping[str, str] | None = None) -> DataFrame:
    """Findings without ignored codes, and with overridden severities (a mapping of a few codes)."""
    out = found.where(~F.col("code").isin(list(ignore))) if ignore else found
    for code, severity in (severities or {}).items():
        out = out.withColumn("severity", F.when(F.col("code") == code, severity).otherwise(F.col("severity")))
    return out


def url_inventory(pages: DataFrame, url_col: str = "url", safe: Sequence[str] = SAFE_DOMAINS) -> DataFrame:
    """(url, domain) of every distinct URL outside the safe domains and their sub-domains."""
    found = pages.select(F.explode(F.regexp_extract_all(F.col(url_col), F.lit(r"""(?i)https?://[^\s'")>\]]+"""), 0)).alias("u"))
    url = F.regexp_replace("u", r"""[.,;:)\]}'"]+$""", "")
    out = found.select(url.alias("url")).distinct().withColumn("domain", F.lower(F.regexp_extract("url", "^(?i)https?://([^/:]+)", 1)))
    unsafe = [(F.col("domain") != s) & ~F.col("domain").endswith("." + s) for s in safe]
    return out.where((F.col("domain") != "") & reduce(Column.__and__, unsafe))


def window_flags(docs: DataFrame, outer: str, inner: str, before: int = 1, after: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_number) of lines that match outer with a line matching inner from `before` above to `after` below."""
    some = docs.where(F.col(text_col).rlike(outer) & F.col(text_col).rlike(inner)).select(id_col, lines(F.col(text_col)).alias("ls"))
    near = lambda x, i: F.exists(F.slice("ls", F.greatest(i + 1 - before, F.lit(1)), before + after + 1 - F.greatest(before - i, F.lit(0))), lambda y: y.rlike(inner))
    at = F.transform("ls", lambda x, i: F.when(x.rlike(outer) & near(x, i), i + 1))
    return some.select(id_col, F.explode(F.array_compact(at).cast("array<long>")).alias("line_number"))
