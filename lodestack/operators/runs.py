"""Recorded runs: agent events, triggers, verdicts, and what an optimiser reads from them."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import evaluation as E

EVENT = (
    "type string, message struct<content array<struct<type string, name string, text string>>, usage struct<input_tokens long, output_tokens long>>, "
    "content_block struct<type string, name string>, usage struct<input_tokens long, output_tokens long>"
)
#: Scores below which a dimension fails; others fail below 0.7.
LEAST = {"trigger": 0.8}


def event_totals(lines: DataFrame, run: str, line: str) -> DataFrame:
    """(run, events, tool_calls, input_tokens, output_tokens) of event lines in either wire format; other lines are skipped. Sums combine before the shuffle."""
    e = lines.withColumn("_whole", F.get_json_object(line, "$")).where("_whole IS NOT NULL").withColumn("_e", F.from_json("_whole", EVENT))
    kind = F.col("_e.type")
    said = F.size(F.filter(F.coalesce("_e.message.content", F.array().cast("array<struct<type:string,name:string,text:string>>")), lambda c: c["type"] == "tool_use"))
    tools = F.when(kind == "assistant", said).when((kind == "content_block_start") & (F.col("_e.content_block.type") == "tool_use"), 1).otherwise(0)
    used = lambda n: F.when(kind == "assistant", F.col(f"_e.message.usage.{n}")).when(kind == "message_delta", F.col(f"_e.usage.{n}"))
    total = lambda n: F.coalesce(F.sum(used(n)), F.lit(0)).alias(n)
    return e.groupBy(run).agg(F.count(F.lit(1)).alias("events"), F.sum(tools).cast("long").alias("tool_calls"), total("input_tokens"), total("output_tokens"))


def process_score(tools_with: Column, tools_without: Column) -> Column:
    return F.least(F.lit(1.0), tools_with / F.greatest(F.lit(1.0), tools_without))


def trigger_rates(runs: DataFrame, query: str, should: str, signal: str, ok: str, tokens: str) -> DataFrame:
    """(query, rate, tokens, passed). A query that should trigger counts tool and text signals, another the tool only."""
    fired = F.when(F.col(should), F.col(signal) != "none").otherwise(F.col(signal) == "tool")
    by = runs.groupBy(query, should).agg(F.avg(fired.cast("int")).alias("_rate"), F.coalesce(F.avg(F.when(F.col(ok), F.col(tokens))), F.lit(0.0)).alias("_tokens"))
    passed = F.when(F.col(should), F.col("_rate") >= 0.5).otherwise(F.col("_rate") < 0.5)
    return by.select(query, F.round("_rate", 6).alias("rate"), F.round("_tokens", 4).alias("tokens"), passed.alias("passed"))


def failing(scores: Column, least: Mapping[str, float] = LEAST, otherwise: float = 0.7) -> Column:
    """The scores of a map that are below what their dimension needs."""
    needed = lambda name: F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in least.items()], F.lit(otherwise))
    return F.map_filter(scores, lambda k, v: v < needed(k))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def round_robin(place: Column, n: int) -> Column:
    return F.pmod(place, F.lit(n))


def with_verdicts(assertions: DataFrame, verdicts: DataFrame, key: Sequence[str], unsure: float = 0.5) -> DataFrame:
    """assertions with passed and uncertain; one without a verdict has failed, without confidence."""
    out = assertions.join(verdicts, list(key), "left")
    uncertain = F.coalesce(F.col("confidence"), F.lit(0.0)) < unsure
    return out.select(*assertions.columns, F.coalesce("passed", F.lit(False)).alias("passed"), uncertain.alias("uncertain"))


WEAKNESS = "weaknesses array<struct<category string, description string, severity string, hypothesis string>>"


def weaknesses(reply: Column) -> Column:
    """Weaknesses of a reply's JSON, with defaults for what they lack; one of high severity for a reply that has none or can't be read."""
    given = F.from_json(reply, WEAKNESS)["weaknesses"]
    filled = F.transform(given, lambda w: F.struct(
        F.coalesce(w["category"], F.lit("functional")).alias("category"), F.coalesce(w["severity"], F.lit("medium")).alias("severity"),
        F.coalesce(w["description"], F.lit("Unknown weakness")).alias("description")))
    none = F.array(F.struct(F.lit("functional").alias("category"), F.lit("high").alias("severity"), F.lit("Unable to parse structured failure analysis").alias("description")))
    return F.when(F.size(given) > 0, filled).otherwise(none)


def case_errors(item: Column, fields: Sequence[str]) -> Column:
    """Required fields that an object of an evaluation file (JSON text) lacks; null if it is no object."""
    thing = F.trim(item).startswith("{") & F.get_json_object(item, "$").isNotNull()
    keys = F.json_object_keys(item)
    return F.when(thing, F.array_compact(F.array(*[F.when(~F.array_contains(keys, f), f) for f in fields])))


def _units(x: Column, places: int) -> Column:
    """A number that was rounded to places, as a whole number of its last place: sums of these don't depend on their order."""
    return F.round(x * 10**places).cast("long")


def side_by_side(runs: DataFrame, case: str, side: str, value: str, a: str, b: str) -> DataFrame:
    """(case, a, b): the mean of each side, and in one row without a case the means of those means, each rounded first, ties away from zero."""
    mean = lambda s: F.round(F.avg(F.when(F.col(side) == s, F.col(value))), 4).alias(s)
    by = runs.groupBy(case).agg(mean(a), mean(b))
    sums = by.agg(*[f(_units(F.col(s), 4)).alias(f"{s}_{n}") for s in (a, b) for n, f in (("sum", F.sum), ("n", F.count))])
    whole = lambda s: F.when(F.col(f"{s}_n") > 0, F.expr(f"sign(`{s}_sum`) * ((2 * abs(`{s}_sum`) + `{s}_n`) div greatest(2 * `{s}_n`, 1))") / 10000).cast("double").alias(s)
    total = sums.select(F.lit(None).cast(runs.schema[case].dataType).alias(case), whole(a), whole(b))
    return by.unionByName(total)


def compare_summary(runs: DataFrame, case: str, side: str, a: str, b: str, rate: str, tokens: str, assertions: str) -> DataFrame:
    """One row that compares two sides: means of each case's rounded means, the sum of its mean passed assertions, tokens for each, and the winner.

    Tokens per assertion are null for a side that passes none; a case without runs of a side counts 0 there."""
    own = lambda s, x: F.avg(F.when(F.col(side) == s, F.col(x)))
    by = runs.groupBy(case).agg(*[
        F.round(F.coalesce(own(s, x), F.lit(0.0)), places).alias(f"{n}_{x_}") for n, s in (("a", a), ("b", b)) for x_, x, places in (("rate", rate, 4), ("tokens", tokens, 1), ("passed", assertions, 1))])
    mean = lambda c, places: F.coalesce(F.sum(_units(F.col(c), places)).cast("double") / F.nullif(F.count(c), F.lit(0)) / 10.0**places, F.lit(0.0)).alias(c)
    total = by.agg(*[f for n in "ab" for f in (
        mean(f"{n}_rate", 4), mean(f"{n}_tokens", 1), F.coalesce(F.sum(_units(F.col(f"{n}_passed"), 1)).cast("double") / 10.0, F.lit(0.0)).alias(f"{n}_passed"))])
    each = lambda n: F.when(F.col(f"{n}_passed") > 0, F.col(f"{n}_tokens") / F.col(f"{n}_passed"))
    ratio = F.when(F.col("a_tokens") > 0, F.col("b_tokens") / F.col("a_tokens")).otherwise(0.0)
    return total.select(
        *[F.round(x, places).alias(c) for n in "ab" for x, places, c in (
            (F.col(f"{n}_rate"), 4, f"{n}_rate"), (F.col(f"{n}_tokens"), 1, f"{n}_tokens"), (F.col(f"{n}_passed"), 1, f"{n}_passed"), (each(n), 1, f"{n}_tokens_each"))],
        F.round(ratio, 4).alias("token_ratio"), E.winner(each("a"), each("b"), "a", "b").alias("winner"))


def benchmark_summary(runs: DataFrame, skill: str, arm: Column, rate: str, tokens: str, tools: str) -> DataFrame:
    """Of each skill: means and deviations of runs with and without it (arm: true, false), the four scores and their mean, and whether it passed.

    A skill without runs of an arm has efficiency 0.5; without runs of the second, process 1."""
    of = lambda want, x: F.when(arm == want, F.col(x))
    by = runs.groupBy(skill).agg(*[f.alias(f"{c}_{n}") for n, want in (("with", True), ("without", False)) for f, c in (
        (F.count(of(want, rate)), "n"), (E.mean(of(want, rate)), "p"), (E.spread(of(want, rate)), "s"), (E.mean(of(want, tokens)), "t"), (E.mean(of(want, tools)), "c"))])
    process = F.when(F.col("n_without") > 0, process_score(F.col("c_with"), F.col("c_without"))).otherwise(1.0)
    paid = F.when((F.col("n_with") > 0) & (F.col("n_without") > 0), E.efficiency(*map(F.col, ("p_with", "t_with", "p_without", "t_without")))).otherwise(0.5)
    cost = (F.col("t_with") - F.col("t_without")) / F.nullif(F.col("t_without"), F.lit(0.0)) * 100
    delta = F.col("p_with") - F.col("p_without")
    return by.select(
        skill, F.round("p_with", 4).alias("rate_with"), F.round("s_with", 4).alias("deviation_with"), F.round("p_without", 4).alias("rate_without"), F.round("s_without", 4).alias("deviation_without"),
        F.round(delta, 4).alias("rate_delta"), F.round(F.col("t_with") - F.col("t_without"), 1).alias("tokens_delta"), F.round(F.col("c_with") - F.col("c_without"), 1).alias("tools_delta"),
        F.round("p_with", 4).alias("outcome"), F.round(process, 4).alias("process"), F.round("p_with", 4).alias("style"), F.round(paid, 4).alias("efficiency"),
        F.round((F.col("p_with") * 2 + process + paid) / 4, 4).alias("overall"), F.when(F.col("t_without") > 0, E.trade_off(delta, cost)).alias("trade"),
        ((delta >= 0) & (F.col("p_with") >= 0.5)).alias("passed"))
