"""Evaluation statistics: scores of two arms, trigger recall, costs, trade-offs, gates."""
from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.rules import DEFAULT_MODEL, PRICES
from lodestack.functions.scalars import line_count


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def spread(x: Column) -> Column:
    """Sample standard deviation, 0 for less than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def efficiency(p_with: Column, t_with: Column, p_without: Column, t_without: Column) -> Column:
    """Pass rate per token of one arm against the other, 0 to 1; a mean of no tokens counts as one token."""
    one = lambda t: F.when(t == 0, 1.0).otherwise(t)
    own, other = p_with / one(t_with), F.when(p_without > 0, p_without / one(t_without)).otherwise(0.0)
    ratio = own / F.nullif(other, F.lit(0.0))
    return F.when(other == 0, F.when(own > 0, 1.0).otherwise(0.5)).otherwise(F.least(F.lit(1.0), 2 * ratio / (1 + ratio)))


def trade_off(quality: Column, cost: Column, threshold: float = -0.05) -> Column:
    """Class of a change in quality and cost; the order of the cases matters."""
    return (
        F.when(quality <= threshold, "REJECT").when((quality >= 0) & (cost <= 0), "PARETO_BETTER").when((quality > 0) & (cost > 0), "TRADEOFF")
        .when((quality <= 0) & (cost < 0), "CHEAPER_BUT_WEAKER").otherwise("PARETO_WORSE")
    )


def winner(a: Column, b: Column, name_a: str, name_b: str, margin: float = 1.05) -> Column:
    """Whose tokens per passing assertion are fewer by the margin; null stands for none passing."""
    ratio = a / F.nullif(b, F.lit(0.0))
    return (
        F.when(a.isNull() & b.isNull(), "tie").when(a.isNull(), name_b).when(b.isNull(), name_a)
        .when(ratio.isNull() | (ratio > margin), name_b).when(ratio < 1 / margin, name_a).otherwise("tie")
    )


def weighted(scores: Sequence[tuple[Column, float]]) -> Column:
    """Mean of scores with weights renormalised over those that are not null; 0 without any."""
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in scores), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scores), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def with_cost(rows: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """rows with input_cost, output_cost and total_cost; unknown models are priced as the default one."""
    prices = rows.sparkSession.createDataFrame(list(PRICES), "_model string, _in double, _out double")
    default = next(p for p in PRICES if p[0] == DEFAULT_MODEL)
    out = rows.join(F.broadcast(prices), F.lower(F.col(model)) == F.col("_model"), "left")  # a handful of rows
    a, b = F.col(tokens_in) * F.coalesce("_in", F.lit(default[1])), F.col(tokens_out) * F.coalesce("_out", F.lit(default[2]))
    dollars = lambda micro: F.round(micro) / 1e6  # noqa: E731  whole millionths, so ties are exact
    return out.select(*rows.columns, dollars(a).alias("input_cost"), dollars(b).alias("output_cost"), dollars(a + b).alias("total_cost"))


def assertion(kind: Column, text: Column, value: Column) -> Column:
    """A deterministic assertion on a text: contains, absent, starts, ends (case does not count), lines (at least)."""
    low, needle = F.lower(F.coalesce(text, F.lit(""))), F.lower(value)
    return (
        F.when(kind == "contains", low.contains(needle)).when(kind == "absent", ~low.contains(needle)).when(kind == "starts", low.startswith(needle))
        .when(kind == "ends", low.endswith(needle)).when(kind == "lines", F.size(F.split(low, "\n", -1)) >= value.try_cast("int"))
    )


#: How assertions begin that a text alone can decide.
STATED = r"^(?:contains |does not contain |starts with |ends with |matches regex |matches pattern |has at least |is valid json|output is valid json)"


_REGEX = r"^matches\s+(?:regex|pattern)\s+/(.+)/$"


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def regex_hits(text: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether each of the patterns, which stand in the data, is found in the text; one that is no pattern is not, and null has none."""

    @functools.lru_cache(1000)
    def compiled(p: str) -> re.Pattern | None:
        try:
            return re.compile(p)
        except (re.error, OverflowError, RecursionError):
            return None

    def found(t: str | None, p: str | None) -> bool | None:
        return None if p is None else bool((c := compiled(p)) and c.search(t or ""))

    return pd.Series([None if ps is None else [found(t, p) for p in ps] for t, ps in zip(text, patterns, strict=True)], dtype=object)


def stated(text: Column, assertion: Column) -> Column:
    """An assertion in words on a text: contains, does not contain, starts with, ends with (case does not count), is valid json,
    has at least N lines, matches regex /.../, or several of these joined by or. Null where it is none of them."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(said: Column, raw: Column, found: Column) -> Column:
        def needle(start: str) -> Column:
            quoted = rf"""^{start}\s+["'](.+?)["']$"""
            return F.when(said.rlike(quoted), F.regexp_extract(said, quoted, 1)).otherwise(F.regexp_extract(said, rf"^{start}\s+(.+)$", 1))

        least = F.regexp_extract(said, r"^has at least (\d+) lines?$", 1).try_cast("int")
        return (
            F.when(said.rlike(r"^contains\s+."), low.contains(needle("contains"))).when(said.rlike(r"^does not contain\s+."), ~low.contains(needle("does not contain")))
            .when(said.isin("is valid json", "output is valid json"), F.try_parse_json(text).isNotNull()).when(least.isNotNull(), line_count(F.coalesce(text, F.lit(""))) >= least)
            .when(said.rlike(r"^starts with\s+."), F.ltrim(low).startswith(needle("starts with"))).when(said.rlike(r"^ends with\s+."), F.rtrim(low).endswith(needle("ends with")))
            .when(raw.rlike(_REGEX), found)
        )

    said = F.lower(F.trim(assertion))
    parts = F.split(said, r"\s+or\s+", -1)
    several = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(STATED))
    patterns = F.transform(F.when(several, parts).otherwise(F.array(F.trim(assertion))), lambda p: F.when(p.rlike(_REGEX), F.regexp_extract(p, _REGEX, 1)))
    # a lambda can't hold a Python function, so what it found is laid beside the parts
    none = F.transform(patterns, lambda p: F.lit(None).cast("boolean"))
    hits = F.coalesce(F.when(F.exists(patterns, lambda p: p.isNotNull()), regex_hits(text, patterns)), none)
    each = F.transform(F.arrays_zip(parts, hits), lambda z: F.coalesce(one(z["0"], z["0"], z["1"]), F.lit(False)))
    return F.when(several, F.exists(each, lambda x: x)).otherwise(one(said, F.trim(assertion), F.get(hits, F.lit(0))))


def permitted(permissions: Column, action: str, namespace: Column) -> Column:
    """admin grants all; write grants read; a star grants every namespace."""
    grants = [F.lit("admin"), F.concat(F.lit(f"{action}:"), namespace), F.lit(f"{action}:*")]
    if action == "read":
        grants += [F.concat(F.lit("write:"), namespace), F.lit("write:*")]
    return F.arrays_overlap(permissions, F.array(*grants))
