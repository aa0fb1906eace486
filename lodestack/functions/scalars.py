"""Scalar functions of catalogues and reports, as expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line, beside carriage return and line feed together.
BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parse_ref(ref: Column) -> Column:
    """(name, version) of name@version, split at the last @; null where one is missing."""
    pattern = r"^(.+)@([^@]+)$"
    return F.when(ref.rlike(pattern), F.struct(F.regexp_extract(ref, pattern, 1).alias("name"), F.regexp_extract(ref, pattern, 2).alias("version")))


def escape_message(text: Column) -> Column:
    return _replaced(text, (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")))


def escape_parameter(text: Column) -> Column:
    return _replaced(escape_message(text), ((":", "%3A"), (",", "%2C")))


def escape_html(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))


def line_count(text: Column) -> Column:
    """Lines as Python's splitlines counts them: an end of line at the end begins no line."""
    ends = F.regexp_count(text, F.lit(rf"\r\n|{BREAKS}"))
    return (ends + F.when((text == "") | text.rlike(rf"{BREAKS}\z"), 0).otherwise(1)).cast("long")


def bar(share: Column, block: str = "█") -> Column:
    return F.repeat(F.lit(block), F.round(share * 10).cast("int"))


def format_cost(dollars: Column) -> Column:
    """Dollars to four places below a cent, else to two; ties go by the shortest decimal form of the number, away from zero."""
    return F.when(dollars < 0.01, F.format_string("$%.4f", dollars)).otherwise(F.format_string("$%.2f", dollars))


def media_type(blob: Column) -> Column:
    magic = F.hex(F.substring(blob, 1, 2))
    return F.when(magic == "504B", "application/zip").when(magic == "1F8B", "application/gzip").otherwise("text/markdown")


def front_matter(text: Column) -> Column:
    """(head, body_start): the lines between a first line of three hyphens and the next such line, and the number of lines up to the body; null and 0 without."""
    lines = F.split(text, "\n", -1)
    end = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) == "---"), True).cast("int")
    has = (F.get(lines, F.lit(0)) == "---") & (end > 0)
    head = F.array_join(F.slice(lines, 2, F.greatest(end - 1, F.lit(0))), "\n")
    return F.struct(F.when(has, head).alias("head"), F.when(has, end + 1).otherwise(0).alias("body_start"))


def named(text: Column) -> Column:
    """What follows the first `name:` that begins a line; null without."""
    found = F.regexp_extract(text, r"(?m)^\s*name:[ \t]*(.*)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def fenced_answer(text: Column) -> Column:
    """What a fenced block (plain, markdown or md) holds, or the whole text without one; trimmed of white space."""
    pattern = r"(?s)```(?:markdown|md)?\s*\n(.*?)```"
    body = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.regexp_replace(body, r"^\s+|\s+\z", "")


def bracketed(text: Column) -> Column:
    """From the first [ to the last ], where a JSON array in noisy text may stand; null without."""
    start, end = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((start > 0) & F.contains(text, F.lit("]")) & (end > start), F.substring(text, start, end - start + 1))


def slug(name: Column) -> Column:
    """The last part of a name as lower-case letters, digits and hyphens."""
    s = F.regexp_replace(F.lower(F.substring_index(name, "/", -1)), "[^a-z0-9-]", "-")
    return F.when(s.isin("", "-"), "downloaded-skill").otherwise(s)


def section_score(section: Column) -> Column:
    """The first of normalized, overall and pass_rate of a JSON section; null if it has an error or was skipped."""
    at = lambda k: F.get_json_object(section, f"$.{k}")
    void = at("error").isNotNull() | (F.coalesce(at("skipped"), F.lit("false")) == "true")
    return F.when(~void, F.coalesce(*[at(k).try_cast("double") for k in ("normalized", "overall", "pass_rate")]))
