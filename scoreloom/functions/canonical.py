"""Canonical JSON and content digests.

Canonical text needs Python's shortest float form and a defined key order, which no
built-in expression gives, so one Arrow-batched function does it; hashing is built in.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIALECTS = ("ascii", "unicode", "unicode_strict")


def _plain(value):
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value.tolist()]
    if isinstance(value, np.generic):
        return _plain(value.item())
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical_text(value, dialect: str = "ascii") -> str:
    """Sorted keys and compact separators; the dialects differ in non-ASCII and NaN handling."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    return json.dumps(
        _plain(value),
        sort_keys=True,
        separators=(",", ":"),
        ensure_ascii=dialect == "ascii",
        allow_nan=dialect != "unicode_strict",
    )


def canonical_json(payload: Column, dialect: str = "ascii") -> Column:
    """Canonical text of a JSON string column (parse, reorder, re-serialise); NULL for a text that is not JSON."""

    def one(text):
        try:
            return None if text is None else canonical_text(json.loads(text), dialect)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(payload)


def canonical_row(df: DataFrame, cols: Sequence[str], dialect: str = "ascii") -> Column:
    """Canonical text of selected columns as one JSON object."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        # Arrow values, so that a row's text does not depend on its neighbours: integers stay integers next to NULL.
        return pa.array([canonical_text(r, dialect) for r in rows.to_pylist(maps_as_pydicts="strict")], pa.string())

    return run(F.struct(*[F.col(c) for c in cols]))


def canonical_sha256(df: DataFrame, cols: Sequence[str], dialect: str = "ascii",
                     name: str = "digest") -> DataFrame:
    """F-02: content digest of the named columns of every row."""
    return df.withColumn(name, F.sha2(canonical_row(df, cols, dialect), 256))


def decision_id(df: DataFrame, cols: Sequence[str], domain: str, name: str = "decision_id") -> DataFrame:
    """F-01: digest of a domain prefix and the canonical payload."""
    text = canonical_row(df, cols, "unicode_strict")
    return df.withColumn(name, F.sha2(F.concat(F.lit(domain), text), 256))


def is_finite_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
