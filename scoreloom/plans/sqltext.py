"""Small SQL text builders for the check queries (DuckDB dialect)."""

from __future__ import annotations


def ct(cond: str) -> str:
    """Count of rows meeting a condition."""
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def r6(e: str, digits: int = 6) -> str:
    return f"(ROUND(CAST({e} AS DOUBLE), {digits}) + 0.0)"


def rate(n: str, d: str, empty: str = "0.0") -> str:
    return f"(CASE WHEN ({d}) <> 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE {empty} END)"


def wilson(w: str, n: str, side: str, z: str = "1.96", empty: tuple[str, str] = ("0.0", "0.0")) -> str:
    """Wilson bound, side 'lo' or 'hi'."""
    N = f"CAST({n} AS DOUBLE)"
    p = f"(CAST({w} AS DOUBLE) / {N})"
    z2 = f"({z}*{z})"
    center = f"({p} + {z2}/(2*{N}))"
    margin = f"({z}*sqrt(({p}*(1-{p}) + {z2}/(4*{N}))/{N}))"
    denom = f"(1.0 + {z2}/{N})"
    if side == "lo":
        return f"(CASE WHEN ({n}) > 0 THEN greatest(0.0, ({center} - {margin})/{denom}) ELSE {empty[0]} END)"
    return f"(CASE WHEN ({n}) > 0 THEN least(1.0, ({center} + {margin})/{denom}) ELSE {empty[1]} END)"
