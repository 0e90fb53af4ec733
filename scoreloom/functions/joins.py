"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which has exactly one row, to every row.

    The broadcast is bounded by construction: ``row`` must come from an aggregation
    without grouping keys.
    """
    return df.join(F.broadcast(row), how="left")


def join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of an aggregate over ``keys``; rows with NULL keys meet the NULL group.

    Nothing is run while the plan is built: adaptive execution broadcasts the aggregate when it turns out
    small and splits hot keys when it does not.
    """
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    renamed = summary.withColumnsRenamed(names)
    match = F.lit(True)
    for k, n in names.items():
        match = match & df[k].eqNullSafe(renamed[n])
    return df.join(renamed, match, how).drop(*names.values())
