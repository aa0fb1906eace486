"""Functions of texts that Spark has no expression for, on Arrow batches."""
from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def compatibility_folded(text: pd.Series) -> pd.Series:
    """Unicode's NFKC form: full-width and mathematical letters become plain ones. Letters of other scripts that look alike stay. Null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The unified difference of two texts by lines, with three lines around each change; empty where they are equal. Null counts as empty."""

    def one(a: str | None, b: str | None) -> str:
        return "".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), "old", "new"))

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)], dtype="object")
