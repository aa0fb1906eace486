"""Front matter translated to what other tools read: fields renamed, left out or derived by rules, as text."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.yaml import yaml_json
from lodestack.operators.manifests import head_and_body, is_mapping
from lodestack.sources.tables import spread

#: How a tool says when a text applies: as the fields stand; by globs and a switch; by a trigger; by an inclusion and a pattern; by paths alone.
STYLES = ("plain", "switch", "trigger", "inclusion", "paths")
# The fields with a part in that, and what styles make of them.
PATHS, OFF = "paths", "disable-model-invocation"
_DEFAULTS = {"switch": ("alwaysApply", "true"), "trigger": ("trigger", "always_on"), "inclusion": ("inclusion", "always")}
_TRIGGERS = {"trigger": ("glob", "manual", "model_decision"), "inclusion": ("fileMatch", "manual", "auto")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _text(v: Column) -> Column:
    """A value as it stands after its key: words as they are, nothing as None, mappings as JSON."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "None").when(kind.startswith("OBJECT"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _items(v: Column) -> Column:
    """A list's items as text; a single value is a list of one."""
    return F.when(_is_list(v), F.transform(F.try_variant_get(v, "$", "array<variant>"), _text)).otherwise(F.array(_text(v)))


def _field(key: Column | str, text: Column | str) -> Column:
    key, text = (F.lit(x) if isinstance(x, str) else x for x in (key, text))
    return F.struct(key.alias("k"), F.concat(key, F.lit(": "), text).alias("line"))


def _listed(key: Column | str, items: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias("k"), F.concat(key, F.lit(":"), F.array_join(F.transform(items, lambda x: F.concat(F.lit('\n  - "'), x, F.lit('"'))), "")).alias("line"))


def _quoted(items: Column) -> Column:
    return F.concat(F.lit('"'), F.array_join(items, ","), F.lit('"'))


def _given(k: Column, v: Column, style: str) -> Column:
    """The fields that a style has for one of a text's."""
    own = F.array(F.when(_is_list(v), _listed(k, _items(v))).otherwise(_field(k, _text(v))))
    if style == "plain":
        return own
    if style == "switch":
        return F.when(k == PATHS, F.array(_listed("globs", _items(v)))).when(k == OFF, F.array(_field("alwaysApply", "false"))).otherwise(own)
    on_paths, on, off = _TRIGGERS[style]
    pattern = _listed("globs", _items(v)) if style == "trigger" else _field("fileMatchPattern", _quoted(_items(v)))
    true = F.coalesce(F.try_variant_get(v, "$", "boolean"), ~F.coalesce(_text(v), F.lit("")).isin("", "None"))
    said = F.array(_field(style, F.when(true, on).otherwise(off)))
    return F.when(k == PATHS, F.array(_field(style, on_paths), pattern)).when(k == OFF, said).otherwise(own)


def translated(fields: Column, body: Column, name: Column, style: str, own: Sequence[str]) -> Column:
    """A text with the front matter of a style. fields are those of a mapping in its own order, as (k, v: variant); own are fields that only the first style has.

    A field that is given twice stands where it was given first, with what it was given last.
    """
    if style not in STYLES:
        raise ValueError(f"no such style: {style}")
    if style == "paths":

        def with_paths(paths: Column) -> Column:
            some = paths.isNotNull() & ~F.schema_of_variant(paths).isin("VOID") & (F.array_join(_items(paths), "") != "")
            return F.when(some, _whole(F.array(_field("applyTo", _quoted(_items(paths)))), body)).otherwise(F.concat(body, F.lit("\n")))

        return let(F.get(F.filter(fields, lambda f: f["k"] == PATHS), F.lit(0))["v"], with_paths)
    kept = fields if style == "plain" or not own else F.filter(fields, lambda f: ~f["k"].isin(*own))
    given = F.flatten(F.transform(kept, lambda f: _given(f["k"], f["v"], style)))
    if style == "inclusion":
        given = F.concat(F.array(_field("name", name)), given)
    if style not in _DEFAULTS:
        return _whole(given, body)
    key, value = _DEFAULTS[style]

    def with_default(given: Column) -> Column:
        default = F.when(F.exists(given, lambda f: f["k"] == "globs"), "false").otherwise(value) if style == "switch" else F.lit(value)
        return F.when(F.exists(given, lambda f: f["k"] == key), given).otherwise(F.array_append(given, _field(key, default)))

    return _whole(let(given, with_default), body)


def _whole(fields: Column, body: Column) -> Column:
    def lines(fields: Column) -> Column:
        firsts = F.array_distinct(F.transform(fields, lambda f: f["k"]))
        return F.transform(firsts, lambda k: F.element_at(F.filter(fields, lambda f: f["k"] == k), -1)["line"])

    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), let(fields, lines), F.array(F.lit("---"))), "\n"), F.lit("\n\n"), body, F.lit("\n"))


def translate(texts: DataFrame, name: str, text: str, own: Sequence[str], styles: Sequence[str] = STYLES) -> DataFrame:
    """texts with (style, translated): a row for each style. A text without front matter that is a mapping has none; a null one is empty."""
    head, body = head_and_body(F.col(text))
    # generators of one row, so that what is derived from them does not parse a head again
    rows = spread(texts).select("*", F.explode(F.array(yaml_json(head))).alias("_json"), body.alias("_rest"))
    rows = rows.select("*", F.explode(F.array(F.try_parse_json("_json"))).alias("_v"))
    good = is_mapping(F.col("_v"))
    m = F.try_variant_get("_v", "$", "map<string, variant>")
    fields = F.when(good, let(m, lambda m: F.transform(F.json_object_keys("_json"), lambda k: F.struct(k.alias("k"), F.try_element_at(m, k).alias("v")))))
    rows = rows.select(*texts.columns, F.explode(F.array(F.coalesce(fields, F.array()))).alias("_fields"), F.when(good, F.col("_rest")).otherwise(F.coalesce(text, F.lit(""))).alias("_body"))
    each = F.array(*[F.struct(F.lit(s).alias("style"), translated(F.col("_fields"), F.col("_body"), F.col(name), s, own).alias("translated")) for s in styles])
    return rows.select(*texts.columns, F.inline(each))
