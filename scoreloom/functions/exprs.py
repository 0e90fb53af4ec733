"""Column expressions shared by all operators. All of them stay inside the JVM.

Where the same name has several meanings (interval on empty input, rate with a zero
denominator, ...) the meaning is a parameter and never a silent default elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles used for the interval variants.
Z95 = 1.96
Z95_EXACT = 1.959963984540054
# Fixed value: Student t quantile (four degrees of freedom, two-sided 95 %).
T95_DF4 = 2.7764451051977987


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for presentation and comparison; adding 0.0 removes a negative zero."""
    return F.round(dbl(c), digits) + F.lit(0.0)


def rate(n: Column | str, d: Column | str, empty: float | None = 0.0) -> Column:
    """n/d; ``empty`` is the value for d = 0 (0.0, None or infinity)."""
    return F.when(col(d) != 0, dbl(n) / dbl(d)).otherwise(F.lit(empty).cast("double"))


def wilson(
    wins: Column | str,
    total: Column | str,
    z: float = Z95,
    empty: tuple[float, float] | None = (0.0, 0.0),
) -> tuple[Column, Column]:
    """Wilson score bounds. ``empty`` is the interval for total = 0; None leaves NULL."""
    n = F.when(col(total) > 0, dbl(total))
    p = dbl(wins) / n
    z2 = z * z
    denom = 1.0 + F.lit(z2) / n
    center = p + F.lit(z2) / (2 * n)
    margin = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z2) / (4 * n)) / n)
    low = F.greatest(F.lit(0.0), (center - margin) / denom)
    high = F.least(F.lit(1.0), (center + margin) / denom)
    # greatest/least skip NULL operands, so the empty case is decided explicitly.
    lo_empty, hi_empty = empty if empty is not None else (None, None)
    has = col(total) > 0
    return (
        F.when(has, low).otherwise(F.lit(lo_empty).cast("double")),
        F.when(has, high).otherwise(F.lit(hi_empty).cast("double")),
    )


def mean_ci(mean: Column, sd: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Normal interval of a mean from aggregates; fewer than two values degenerate to the mean."""
    half = F.when(n >= 2, F.lit(z) * sd / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))
    return mean - half, mean + half


def count_true(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def all_true(condition: Column) -> Column:
    """bool_and with NULL counted as failure."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def poisoned_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL (and on empty input)."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.sum(col(c)))


def finite(c: Column | str) -> Column:
    x = dbl(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


# ---------------------------------------------------------------- arrays


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """Bind a value for use inside lambdas.

    An outer expression captured by a lambda is evaluated again for every element; a
    lambda variable is evaluated once. Arrays of length n stay O(n) this way.
    """
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def doubles(a: Column | str) -> Column:
    return F.transform(col(a), lambda x: x.cast("double"))


def array_sum(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def first_argmax(a: Column | str) -> Column:
    """Zero-based index of the first maximum."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def normalised(a: Column | str) -> Column:
    """Array divided by its sum; NULL when the sum is zero."""
    return let(
        F.struct(doubles(a).alias("v"), array_sum(a).alias("s")),
        lambda t: F.when(t["s"] > 0, F.transform(t["v"], lambda x: x / t["s"])),
    )


def _with_top(a: Column | str, body: Callable[[Column, Column], Column], tau: float = 1.0) -> Column:
    """Bind the array as doubles (over ``tau``) together with its maximum."""
    v = F.transform(col(a), lambda x: x.cast("double") / F.lit(tau)) if tau != 1.0 else doubles(a)
    return let(v, lambda w: let(F.struct(w.alias("v"), F.array_max(w).alias("m")), lambda t: body(t["v"], t["m"])))


def log_sum_exp_array(a: Column | str) -> Column:
    return _with_top(
        a, lambda v, m: m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    )


def softmax(a: Column | str, tau: float = 1.0) -> Column:
    return normalised(_with_top(a, lambda v, m: F.transform(v, lambda x: F.exp(x - m)), tau))


def log_softmax(a: Column | str) -> Column:
    return let(
        F.struct(doubles(a).alias("v"), log_sum_exp_array(a).alias("z")),
        lambda t: F.transform(t["v"], lambda x: x - t["z"]),
    )


def entropy(p: Column | str) -> Column:
    """Shannon entropy in nats, 0·log 0 = 0."""
    return F.aggregate(
        col(p), F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    )


def kl_divergence(p: Column | str, q: Column | str, floor: float | None = None) -> Column:
    """KL(p||q) over the support of p. ``floor`` adds a smoothing constant to both before normalising."""
    p, q = col(p), col(q)
    if floor is not None:
        p = normalised(F.transform(p, lambda x: x.cast("double") + floor))
        q = normalised(F.transform(q, lambda x: x.cast("double") + floor))
    terms = F.zip_with(
        p, q, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def js_divergence(p: Column | str, q: Column | str) -> Column:
    def term(x, m):
        return F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(
        col(p), col(q), lambda x, y: (term(x, (x + y) / 2.0) + term(y, (x + y) / 2.0)) / 2.0
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def l1_distance(p: Column | str, q: Column | str) -> Column:
    return array_sum(F.zip_with(col(p), col(q), lambda x, y: F.abs(x - y)))


def json_escape_free(c: Column) -> Column:
    """Quoted JSON string of a value known to hold printable ASCII without quotes or backslashes."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def named_rows(**columns: Column) -> Column:
    """Array of (metric, value) structs, for turning a wide aggregate into rows."""
    return F.array(
        *[F.struct(F.lit(k).alias("metric"), dbl(v).alias("value")) for k, v in columns.items()]
    )


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
