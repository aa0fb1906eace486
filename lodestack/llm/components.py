"""Connected components of distributed links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.workspace import Workspace


def connected_components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) for each id in links (a, b): component is the smallest id reachable.

    Each round takes the smallest label among neighbours, then the label of that label (pointer jumping),
    until nothing changes. Minima are combined before the shuffle, so hubs do not gather in one task;
    labels are written to the shared folder each round. Empty links give an empty result.
    """
    both = ws.save(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        )
        step = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("component")
        )
        jump = labels.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        step = step.join(jump, F.col("component") == F.col("_i"), "left").select(
            "id", "old", F.least("component", "_c").alias("component")
        )
        step = ws.save(step, "labels")
        changed = step.where("component <> old").limit(1).count()
        previous, labels = labels, step.select("id", "component")
        ws.drop(previous)
        if not changed:
            ws.drop(both)
            return labels


def merge_components(labels: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """labels (id, component) after adding links (a, b) between its ids.

    Links are first mapped to the components of their ends, and those inside one are dropped: what is left
    to connect shrinks from call to call, and labels stand for a star of each component.
    """
    end = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
    between = links.select("a", "b").join(end("a"), "a").join(end("b"), "b").where("_a <> _b")
    between = ws.save(between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "contracted")
    if between.limit(1).count() == 0:
        return labels
    joined = connected_components(between, ws).select(F.col("id").alias("_old"), F.col("component").alias("_new"))
    out = labels.join(joined, F.col("component") == F.col("_old"), "left").select("id", F.coalesce("_new", "component").alias("component"))
    return ws.save(out, "components")
