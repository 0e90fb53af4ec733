"""Ordered computations that survive a hot key.

A Spark window partitioned by ``user`` puts all rows of one user in one task. When a
single user holds a third of the data that task never ends. The functions here split
each key's sequence into chunks that hold at most ``width`` rows (the sequence column is
integral and unique in its key), run the window inside ``(key, chunk)``, and stitch
the chunks together with a summary that has one row per chunk. Rows are shuffled once, by
``(key, chunk)``; the summary is smaller by the factor ``width``.

Ranks and exact quantiles use the same idea on values instead of sequence numbers:
equal values are first collapsed into a count, values are mapped to order-preserving
buckets, and only bucket totals are accumulated per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from scoreloom.functions.joins import join_back

CHUNK = 65536


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _chunked(df: DataFrame, seq: str, width: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(seq) / F.lit(width)))


def _up_to_here(keys: Sequence[str], seq: str, peers: bool) -> WindowSpec:
    """The rows of a chunk up to this one; with ``peers`` all rows of its place (equal places share a chunk)."""
    inside = W.partitionBy(*keys, "__chunk").orderBy(seq)
    return inside.rangeBetween(W.unboundedPreceding, 0) if peers else inside.rowsBetween(W.unboundedPreceding, 0)


def _edge_join(df: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on (keys, chunk); the shuffle of ``df`` is the one of its window."""
    return df.join(edge, [*keys, "__chunk"], "left")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    columns: Mapping[str, str],
    direction: str = "lag",
    width: int = CHUNK,
) -> DataFrame:
    """lag/lead by one row over ``keys`` ordered by ``seq`` for {new name: source column}.

    Keys must not be NULL (filter first). Adds NULL columns at a key's start (or end).
    """
    lag = direction == "lag"
    fields = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    d = _chunked(df, seq, width)
    inside = W.partitionBy(*keys, "__chunk").orderBy(seq)
    d = d.withColumn("__near", F.lag(fields).over(inside) if lag else F.lead(fields).over(inside))
    pick = F.max_by if lag else F.min_by
    edge = (
        _chunked(df, seq, width)
        .groupBy(*keys, "__chunk")
        .agg(pick(fields, F.col(seq)).alias("__edge"))
    )
    across = W.partitionBy(*keys).orderBy("__chunk")
    edge = edge.withColumn(
        "__carry", F.lag("__edge").over(across) if lag else F.lead("__edge").over(across)
    ).drop("__edge")
    joined = _edge_join(d, edge, keys)
    out = [F.coalesce("__near", "__carry").getField(new).alias(new) for new in columns]
    return joined.select(*df.columns, *out)


def running(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    sums: Mapping[str, Column | str],
    width: int = CHUNK,
    peers: bool = False,
) -> DataFrame:
    """Inclusive running sums {new name: summand} over ``keys`` ordered by ``seq``.

    With ``peers`` the sequence may repeat: rows of one place share the sum up to the last of them.
    """
    named = {new: (F.col(c) if isinstance(c, str) else c) for new, c in sums.items()}
    base = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__v_{n}") for n, c in named.items()])
    d = _chunked(base, seq, width)
    inside = _up_to_here(keys, seq, peers)
    for n in named:
        d = d.withColumn(f"__w_{n}", F.sum(f"__v_{n}").over(inside))
    edge = (
        _chunked(base, seq, width)
        .groupBy(*keys, "__chunk")
        .agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in named])
    )
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.select(
        *keys, "__chunk", *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in named]
    )
    joined = _edge_join(d, edge, keys)
    out = [(F.col(f"__w_{n}") + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in named]
    return joined.select(*df.columns, *out)


def running_max(
    df: DataFrame, keys: Sequence[str], seq: str, columns: Mapping[str, str], width: int = CHUNK, peers: bool = False
) -> DataFrame:
    """Inclusive running maximum; NULL inputs are skipped. ``peers`` as in ``running``."""
    d = _chunked(df, seq, width)
    inside = _up_to_here(keys, seq, peers)
    for n, c in columns.items():
        d = d.withColumn(f"__w_{n}", F.max(c).over(inside))
    edge = _chunked(df, seq, width).groupBy(*keys, "__chunk").agg(
        *[F.max(c).alias(f"__t_{n}") for n, c in columns.items()]
    )
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.select(
        *keys, "__chunk", *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in columns]
    )
    joined = _edge_join(d, edge, keys)
    out = [F.greatest(f"__w_{n}", f"__o_{n}").alias(n) for n in columns]
    return joined.select(*df.columns, *out)


def row_numbers(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "rn", width: int = CHUNK
) -> DataFrame:
    return running(df, keys, seq, {name: F.lit(1).cast("bigint")}, width)


def islands(
    df: DataFrame, keys: Sequence[str], seq: str, same: Sequence[str], name: str = "island",
    width: int = CHUNK,
) -> DataFrame:
    """Number the maximal runs in which the columns ``same`` do not change (NULL-safe)."""
    prev = neighbour(df, keys, seq, {"__ps": seq, **{f"__p_{c}": c for c in same}}, width=width)
    unchanged = F.col("__ps").isNotNull()
    for c in same:
        unchanged = unchanged & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    flagged = prev.withColumn("__new", F.when(unchanged, 0).otherwise(1).cast("bigint"))
    return running(flagged, keys, seq, {name: "__new"}, width).select(*df.columns, name)


def _starts(marks: np.ndarray, last: int | None) -> np.ndarray:
    """Rows of a sorted batch that begin a group; ``last`` is the mark of the row before the batch."""
    new = np.ones(len(marks), dtype=bool)
    new[1:] = marks[1:] != marks[:-1]
    if len(marks) and last is not None:
        new[0] = marks[0] != last
    return np.flatnonzero(new)


def _fold_maps(keys: list[str]):
    """Each group's composed map (m, a) with x before the group = a + m·(x after it); rows come last first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, m, a = None, None, 1.0, 0.0
        names = [*keys, "__m", "__a"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head.columns, pa.array([m]), pa.array([a])], names)

        for batch in batches:
            marks = batch.column("__g").to_numpy()
            ms, gains = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("__m", "__a"))
            starts = set(_starts(marks, last).tolist())
            for i in range(len(ms)):
                if i in starts:
                    if head is not None:
                        yield out()
                    head, m, a = batch.select(keys).slice(i, 1), 1.0, 0.0
                a = gains[i] + ms[i] * a
                m = ms[i] * m
            if len(marks):
                last = marks[-1]
        if head is not None:
            yield out()

    return run


def _solve(columns: list[str], name: str):
    """Rows come last first; each group begins with its ``__entry``, the value after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, 0.0
        for batch in batches:
            marks = batch.column("__g").to_numpy()
            ms, gains, entry = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("__m", "__a", "__entry"))
            starts = set(_starts(marks, last).tolist())
            values = np.empty(len(ms))
            for i in range(len(ms)):
                if i in starts:
                    x = entry[i]
                x = gains[i] + ms[i] * x
                values[i] = x
            if len(marks):
                last = marks[-1]
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, pa.array(values, mask=np.isnan(values))], [*columns, name])

    return run


def affine_scan_back(
    df: DataFrame, keys: Sequence[str], seq: str, mult: str, add: str, name: str,
    width: int = 1 << 20,
) -> DataFrame:
    """Solve x[t] = add[t] + mult[t]·x[t+1] backwards over ``seq``, with x after the end = 0; NULL where an input is missing.

    Affine maps compose, so each chunk of ``width`` sequence numbers is folded into one map, the maps of a key's
    chunks give the value after each chunk, and the chunks are then solved side by side. Rows are
    streamed in order, one Arrow batch at a time; ``seq`` is integral and unique in its key.
    """
    group = [*keys, "__chunk"]
    d = df.withColumns({"__chunk": F.floor(F.col(seq) / F.lit(width)), "__m": F.col(mult).cast("double"), "__a": F.col(add).cast("double")})
    d = d.withColumn("__g", F.xxhash64(*group))
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def schema(columns: Sequence[str], *more: str) -> str:
        return ", ".join([*(f"`{c}` {types[c]}" for c in columns), *more])

    maps = (
        d.select(*group, seq, "__m", "__a", "__g").repartition(*group).sortWithinPartitions("__g", *group, F.col(seq).desc())
        .mapInArrow(_fold_maps(group), schema(group, "__m double", "__a double"))
    )
    # The value before a chunk is the value after the one before it.
    chained = (
        maps.withColumn("__g", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")).withColumn("__entry", F.lit(0.0))
        .repartition(*(keys or ["__g"])).sortWithinPartitions("__g", *keys, F.col("__chunk").desc())
        .mapInArrow(_solve(group, "__before"), schema(group, "__before double"))
    )
    later = W.partitionBy(*keys).orderBy("__chunk") if keys else W.partitionBy(F.lit(0)).orderBy("__chunk")
    entry = chained.select(*group, F.coalesce(F.lead("__before").over(later), F.lit(0.0)).alias("__entry"))
    return (
        join_back(d, entry, group, "left").repartition(*group).sortWithinPartitions("__g", *group, F.col(seq).desc())
        .mapInArrow(_solve(df.columns, name), schema(df.columns, f"`{name}` double"))
    )


# ---------------------------------------------------------------- ranks and quantiles

# Steps per factor two in the first bucket number, and buckets between its smallest and largest value in the second.
LOG_STEPS = 1024
LINEAR_STEPS = 1 << 21


def _log_bucket(x: Column) -> Column:
    """A bucket number that never falls as the value grows; NaN comes last.

    Magnitudes are cut at LOG_STEPS per factor two, so a bucket lies between two neighbouring powers of
    two, where doubles are evenly spaced.
    """
    size = F.lit(1200 * LOG_STEPS) + F.floor(F.log2(F.abs(x)) * LOG_STEPS)
    return (
        F.when(F.isnan(x), 9_000_000).when(x == float("inf"), 8_000_000).when(x == float("-inf"), -8_000_000)
        .when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("bigint")
    )


def _values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __x, __n, __b): distinct values with counts, combined before the shuffle, and their log bucket."""
    x = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    counted = x.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"))
    return counted.withColumn("__b", _log_bucket(F.col("__x")))


def _log_totals(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, __b): smallest and largest value, rows before the bucket, rows up to its end, rows of the key."""
    sums = values.groupBy(*keys, "__b").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.sum("__n").alias("__bn"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = F.sum("__bn").over(whole.orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    return sums.select(
        *keys, "__b", "__lo", "__hi", (upto - F.col("__bn")).alias("__start"), upto.alias("__end"), F.sum("__bn").over(whole).alias("__total"))


def _ranked(values: DataFrame, buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the given buckets with ``__below``, the rows of their key that are strictly smaller.

    A log bucket is cut into LINEAR_STEPS parts of equal width. As doubles are evenly spaced there, a part has
    at most 2^52 / LOG_STEPS / LINEAR_STEPS (about two million) distinct ones: no distribution of values can put more
    into a window.
    """
    part = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * LINEAR_STEPS))
    d = join_back(values, buckets, [*keys, "__b"]).withColumn("__c", F.coalesce(part.cast("bigint"), F.lit(0)))
    cell = [*keys, "__b", "__c"]
    sums = d.groupBy(*cell).agg(F.sum("__n").alias("__cn"))
    order = W.partitionBy(*keys, "__b").orderBy("__c").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select(*cell, (F.sum("__cn").over(order) - F.col("__cn")).alias("__before"))
    inside = W.partitionBy(*cell).orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__in", F.sum("__n").over(inside) - F.col("__n"))
    return join_back(d, sums, cell).withColumn("__below", F.col("__start") + F.col("__before") + F.col("__in"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n`` copies, ``below`` rows strictly smaller, ``total`` rows."""
    values = _values(df, keys, value)
    return _ranked(values, _log_totals(values, keys), keys).select(
        *keys, F.col("__x").alias(value), F.col("__n").alias("n"), F.col("__below").alias("below"), F.col("__total").alias("total"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    kind: str = "linear",
) -> DataFrame:
    """Exact quantiles {column name: probability}, one row per key; NULL values are skipped, NULL keys are a group.

    ``kind``: ``linear`` interpolates between neighbours, ``nearest_rank`` takes element
    ceil(q·n), ``rounded`` takes index round((n-1)·q) with ties to even.

    Values are counted once; bucket totals tell which buckets hold a wanted rank, and only the values of those
    are ranked.
    """
    n1 = F.col("__total") - 1
    wanted = []
    for name, q in probs.items():
        if kind == "linear":
            pos = n1.cast("double") * F.lit(float(q))
            pairs = [("lo", F.floor(pos)), ("hi", F.least(F.ceil(pos), n1))]
        elif kind == "nearest_rank":
            at = F.ceil(F.col("__total") * F.lit(float(q))) - 1
            pairs = [("lo", F.greatest(F.least(at, n1), F.lit(0)))]
        elif kind == "rounded":
            pairs = [("lo", F.bround(n1.cast("double") * F.lit(float(q)), 0).cast("bigint"))]
        else:
            raise ValueError(f"unknown quantile kind {kind!r}")
        for side, rank in pairs:
            wanted.append(
                F.struct(
                    F.lit(name).alias("q"), F.lit(side).alias("side"), rank.cast("bigint").alias("r")
                )
            )
    values = _values(df, keys, value)
    buckets = (
        _log_totals(values, keys).withColumn("__want", F.array(*wanted))
        .withColumn(
            "__want",
            F.filter("__want", lambda s: (s["r"] >= F.col("__start")) & (s["r"] < F.col("__end"))),
        )
        .filter(F.size("__want") > 0).drop("__end")
    )
    found = (
        _ranked(values, buckets, keys)
        .withColumn(
            "__got",
            F.filter("__want", lambda s: (s["r"] >= F.col("__below")) & (s["r"] < F.col("__below") + F.col("__n"))),
        )
        .filter(F.size("__got") > 0)
        .select(*keys, "__x", "__total", F.explode("__got").alias("__hit"))
    )
    outs = []
    for name, q in probs.items():
        lo = F.max(F.when((F.col("__hit.q") == name) & (F.col("__hit.side") == "lo"), F.col("__x")))
        if kind == "linear":
            hi = F.max(F.when((F.col("__hit.q") == name) & (F.col("__hit.side") == "hi"), F.col("__x")))
            pos = (F.max("__total") - 1).cast("double") * F.lit(float(q))
            share = pos - F.floor(pos)
            # Equal neighbours are not subtracted: two infinities would give NaN.
            outs.append(F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share).alias(name))
        else:
            outs.append(lo.alias(name))
    return found.groupBy(*keys).agg(*outs)


def small_percentile(value: Column | str, q: float) -> Column:
    """Built-in exact percentile, for groups whose size a contract bounds (seeds, repeats, replicates)."""
    return F.percentile(F.col(value) if isinstance(value, str) else value, F.lit(float(q)))
