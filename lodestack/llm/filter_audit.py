"""Interaction audit of five document filters from a histogram of failure masks.

Every document gets a mask of the filters that it fails, built by native expressions; bit i is letter i of FILTERS.
Whatever the order in which the filters are applied, what each removes depends on the masks alone, so the documents
are counted once by part and mask (32 cells a part) and all 120 orders are enumerated from the cells.

- A: fewer than MIN_WORDS words.
- B: less than MIN_DISTINCT percent of the words are distinct.
- C: more than MAX_CAPITALS percent of the code points are A-Z.
- D: holds one of SYMBOLS.
- E: the text is that of a document with a smaller id.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A null
text is empty. A row without an id never fails E, and no other row fails E because of it; rows repeated in full don't
fail E against each other. A null part is the empty string. Labels without an id are ignored; where an id has several
labels, one that says good (or toxic) is enough. An empty table gives an empty result.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.workspace import Workspace, attach

FILTERS = "ABCDE"
#: Bounds of the filters A, B and C, and the characters of D.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(text: Column, words: Column) -> Column:
    """The mask of A to D, which the text alone decides. words: its words as an array."""
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * MAX_CAPITALS,
        text.rlike(f"[{SYMBOLS}]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(_id, part, mask) of every row.

    Texts are grouped by their SHA-256, which gives each group's smallest id; rows of a text that only one row has
    are not joined with anything. Groups of a thousandth of all rows or more are broadcast, so no group of copies
    gathers in one task.
    """
    ws = Workspace(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("_text"))
    words = F.filter(F.split("_text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = ws.save(
        rows.select(
            "_id", "part", own_failures(F.col("_text"), words).alias("own"), F.unhex(F.sha2("_text", 256)).alias("digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "rows",
    )
    groups = rows.groupBy("digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = ws.save(groups.where("copies > 1"), "groups")
    found = attach(rows, groups, "digest", "copies", rows.count(), "_row")
    later = F.coalesce(F.col("_id") > F.col("first"), F.lit(False))
    return found.select("_id", "part", (F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good and toxic, by part and mask."""
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic")
    )
    # rows without an id have no label: they are counted apart from the join, where they would meet in one task
    known = masked.where(F.col("_id").isNotNull()).join(by_id, F.col("_id") == F.col("_labelled"), "left").select("part", "mask", "_good", "_toxic")
    unknown = masked.where(F.col("_id").isNull()).select("part", "mask", F.lit(False).alias("_good"), F.lit(False).alias("_toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic")
    )


def enumerate_orders(counted: DataFrame) -> DataFrame:
    """For each part, order and step: what is kept after the step and what its filter removes, from the cells.

    Of the documents of a cell with k failures, each of the k filters removes them in 120 / k of the 120 orders,
    which gives a filter's removals over all orders (shapley).
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    rows = parts.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    rows = rows.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda m, x: m + F.when(x == "", 0).otherwise(bit(x)))
    rows = rows.select("part", "cells", "filter_order", "step", bit(letter).alias("_own"), earlier.alias("_earlier"))

    def total(value: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(where(c["mask"]), c[value]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("_own")) != 0
    met = lambda m: m.bitwiseAND(F.col("_earlier")) == 0
    removed = lambda m: fails(m) & met(m)
    share = lambda c: c["n"] * len(ORDERS) / F.bit_count(c["mask"])
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: met(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~met(m)).alias("redundant"), total("n", lambda m: m == F.col("_own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(fails(c["mask"]), share(c).cast("long")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    return enumerate_orders(cells(masks(docs, id_col, text_col, part_col), labels, id_col))
