"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled inside their source by a hash. Each gets a virtual finish time: the words of its source up to
and including it, divided by the source's target. The documents of all sources, repeats included, are
then ordered by finish time and cut at the total budget. A source may hold any share of all rows, so neither running
sum is taken over a whole source or the whole table: keys are cut into ranges, sums of ranges are added up,
and only inside a range do rows wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.joins import attach_row
from scoreloom.llm.tables import free_names, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
# Parts of one unit of finish time that are summed together.
PARTS = 4096


def text_size(text: str = "text") -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight; a
    target stops at ``repeats`` times its source's size and what is left over goes to the others by weight, which is
    the level at which min(cap, level * weight) adds up to the budget.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = each.select(
        "source", "source_size", (F.col("source_size") * repeats).alias("cap"),
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).alias("weight"),
    ).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    budget = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share
    stepped = weighed.select(
        "*", F.row_number().over(order).alias("step"), budget.alias("budget"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    level = stepped.where("level <= full_at").agg(F.min_by("level", "step").alias("fair"))
    return attach_row(stepped.select("source", "source_size", "cap", "weight"), level).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("fair") * F.col("weight")), F.col("cap").cast("double")).alias("target")
    )


def _range_of(finish: Column) -> Column:
    """Ranges of finish times in ascending order; their number is bounded, whatever the times are."""
    return F.when(finish < 2, F.floor(finish * PARTS)).otherwise(2 * PARTS + F.floor(F.log2(finish) * 64)).cast("long")


def _place(seed: str) -> Column:
    """Where a row stands in its source's shuffle: a digest of its id or, where it has none, of its text."""
    no_id = F.concat(F.lit("text-"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col("doc_id").cast("long").cast("string"), no_id)).cast("binary"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, times of every row of ``docs`` (doc_id, text, source).

    ``times`` (0 to ``repeats``) is how often the mix takes the row; the rows taken are those of the
    earliest finish times whose sizes together stay within the budget. Ties of the hash are ordered by doc_id. Rows without
    words are never taken. Repeated rows finish together, after the last of them, so they are taken alike. Rows without a doc_id
    are told apart by their text. An empty table gives no rows.
    """
    return _placed_counts(docs, weights, share, repeats, seed).drop("place")


def _placed_counts(docs: DataFrame, weights: tuple[int, ...], share: float, repeats: int, seed: str) -> DataFrame:
    """The rows of ``mix_counts`` with their place in the shuffle."""
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size().alias("size"), _place(seed).alias("place"))
        .withColumn("part", F.substring("place", 1, 3))
    )
    targets = source_targets(rows.select("source", "size"), weights, share, repeats)
    parts = (
        rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
        .withColumn("ahead", F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size"))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "ahead")
    )
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)
    timed = (
        rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("upto", F.col("ahead") + F.sum("size").over(inside)).drop("s", "p", "ahead", "part")
    )
    timed = written(
        timed.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    )
    turns = (
        timed.where("size > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .select("place", "doc_id", "size", "turn", F.try_divide(F.col("turn") * F.col("source_size") + F.col("upto"), F.col("target")).alias("finish"))
        .withColumn("range", _range_of(F.col("finish")))
    )
    budget = targets.agg((F.sum("source_size") * share).alias("budget"))
    sums = turns.groupBy("range").agg(F.sum("size").alias("words"))
    running = sums.withColumn("upto_range", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    edge = attach_row(running, budget).where("upto_range > budget").agg(
        F.min("range").alias("edge"), F.min_by(F.col("upto_range") - F.col("words"), "range").alias("before"), F.first("budget").alias("budget"))
    edge = written(edge)
    close = attach_row(turns, edge).where("range = edge")
    line = Window.partitionBy("range").orderBy("finish", "place", "doc_id", "turn", "size").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        close.withColumn("taken_by", F.col("before") + F.sum("size").over(line)).where("taken_by <= budget")
        .agg(F.max(F.struct("finish", "place", "doc_id", "turn")).alias("last"))
    )
    cut = attach_row(edge, last)
    decided = attach_row(timed, cut)
    times = F.lit(0)
    for turn in range(repeats):
        finish = F.try_divide(turn * F.col("source_size") + F.col("upto"), F.col("target"))  # null in a source without words
        at = _range_of(finish)
        here = F.struct(finish.alias("finish"), F.col("place"), F.col("doc_id"), F.lit(turn).alias("turn"))
        taken = F.col("edge").isNull() | (at < F.col("edge")) | ((at == F.col("edge")) & F.coalesce(here <= F.col("last"), F.lit(False)))
        times = times + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    return decided.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), "place")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix"
) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    Rows without an id are told apart by their text. Columns of ``docs`` may have any names.
    """
    place, source, size, times, turn, my_place, my_source, my_size = free_names(
        docs, "__place", "__source", "__size", "__times", "__turn", "__my_place", "__my_source", "__my_size")
    counts = (
        _placed_counts(docs, weights, share, repeats, seed).where("times > 0")
        .groupBy(F.col("place").alias(place), F.col("source").alias(source), F.col("size").alias(size)).agg(F.max("times").alias(times))
    )
    keyed = docs.select("*", _place(seed).alias(my_place), F.col("source").cast("string").alias(my_source), text_size().alias(my_size))
    match = (F.col(my_place) == F.col(place)) & (F.col(my_size) == F.col(size)) & F.col(my_source).eqNullSafe(F.col(source))
    return keyed.join(counts, match).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


ORACLE = r"""
WITH r AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-' || doc_id) AS place
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (
    SELECT *, source_size * 2 AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
           (SELECT sum(size) FROM r)::DOUBLE * 1.5 AS budget FROM s),
f AS (
    SELECT *, row_number() OVER o AS step,
           (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
t AS (
    SELECT source, source_size, budget,
           coalesce(least(cap::DOUBLE, (SELECT arg_min(level, step) FROM f WHERE level <= cap::DOUBLE / weight) * weight), cap::DOUBLE) AS target
    FROM f),
q AS (
    SELECT r.*, t.source_size, t.target, t.budget,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY place, doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
u AS (
    SELECT doc_id, place, size, turn, (turn * source_size + upto)::DOUBLE / target AS finish, budget
    FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, doc_id, turn ROWS UNBOUNDED PRECEDING) AS total FROM u),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""
