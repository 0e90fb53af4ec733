"""B-ops and P-04/P-05: possible-world tables, beliefs over them and their transport.

Tables: ``pools`` (space_id, hand_size, pool map<string,int>), ``worlds`` (space_id,
world_index, hand map<string,int>, hand_key, weight decimal(38,0)), ``beliefs`` (space_id,
world_index, hand, hand_key, log_p, and optionally model_id). log_p may be -infinity for
a world without mass; it is a value, not NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.operators.sequences import violation, world_rank
from scoreloom.session import cut_lineage

NEG_INF = float("-inf")
# Names expanded before the partial hands are spread over the cluster.
SPREAD_AFTER = 3


# ------------------------------------------------------------------ predicates


@dataclass(frozen=True)
class WorldQuery:
    """A declared predicate: kind is true, has (>= n), lacks (< n), exactly or not_exactly."""

    query_id: str
    kind: str
    card: str = ""
    count: int = 0


def hand_count(hand: Column | str, card: Column | str) -> Column:
    """Copies of a card in a hand map; a missing name counts as zero."""
    c = F.lit(card) if isinstance(card, str) else card
    return F.coalesce(F.try_element_at(E.col(hand), c), F.lit(0))


def world_predicate(q: WorldQuery, hand: Column | str = "hand") -> Column:
    """P-04: whether a hand satisfies a query."""
    n = hand_count(hand, q.card)
    table = {
        "true": F.lit(True), "empty": F.lit(False), "has": n >= q.count, "lacks": n < q.count,
        "exactly": n == q.count, "not_exactly": n != q.count,
    }
    return table[q.kind]


def negation(q: WorldQuery) -> WorldQuery:
    opposite = {
        "has": "lacks", "lacks": "has", "exactly": "not_exactly", "not_exactly": "exactly", "true": "empty", "empty": "true",
    }
    return WorldQuery(f"not({q.query_id})", opposite[q.kind], q.card, q.count)


def canonical_predicates(pools: DataFrame, queries: Sequence[WorldQuery]) -> DataFrame:
    """P-05: per space the canonical form of each declared query against the pool.

    The largest possible count is min(copies in the pool, hand size). Tautologies fold to
    'true', impossible queries to 'empty', exactly 0 to lacks 1 and not exactly 0 to has 1.
    """
    rows = F.array(
        *[F.struct(F.lit(q.query_id).alias("query_id"), F.lit(q.kind).alias("kind"), F.lit(q.card).alias("card"), F.lit(q.count).alias("count")) for q in queries]
    )
    d = pools.select("space_id", "pool", "hand_size", F.explode(rows).alias("q")).select("space_id", "pool", "hand_size", "q.*")
    top = F.least(hand_count("pool", F.col("card")), F.col("hand_size"))
    k, n = F.col("kind"), F.col("count")
    kind = (
        F.when(k.isin("true", "empty"), k)
        .when(k == "has", F.when(n == 0, "true").when(n > top, "empty").otherwise("has"))
        .when(k == "lacks", F.when(n == 0, "empty").when(n > top, "true").otherwise("lacks"))
        .when(k == "exactly", F.when(n > top, "empty").when(n == 0, "lacks").otherwise("exactly"))
        .otherwise(F.when(n > top, "true").when(n == 0, "has").otherwise("not_exactly"))
    )
    folded = kind.isin("true", "empty")
    count = F.when(folded, F.lit(None)).when(k.isin("exactly", "not_exactly") & (n == 0), F.lit(1)).otherwise(n)
    return d.select(
        "space_id", "query_id", kind.alias("canonical_kind"), F.when(~folded, F.col("card")).alias("card"), count.cast("int").alias("count")
    )


# ------------------------------------------------------------------ enumeration


def hand_key(hand: Column | str) -> Column:
    """Canonical text of a hand: names in order with positive counts."""
    entries = F.array_sort(F.map_entries(F.map_filter(E.col(hand), lambda k, v: v > 0)))
    return F.concat_ws(";", F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))


def binomial(n: Column, k: Column) -> Column:
    """Exact C(n, k) in 64-bit integers; ANSI arithmetic fails on overflow instead of wrapping."""
    steps = F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return E.let(
        n.cast("bigint"),
        lambda m: F.aggregate(
            steps, F.lit(1).cast("bigint"), lambda acc, i: F.call_function("div", acc * (m - i), (i + 1).cast("bigint"))
        ),
    )


def _suffix_counts() -> Column:
    """ways[i][r]: number of multisets of size r from the names i.. within their caps."""
    size = F.sequence(F.lit(0), F.col("hand_size"))
    none = F.transform(size, lambda r: F.when(r == 0, 1).otherwise(0).cast("bigint"))

    def prepend(acc, cap):
        later = acc[0]
        level = F.transform(
            size,
            lambda r: F.aggregate(
                F.sequence(F.lit(0), F.least(cap, r)), F.lit(0).cast("bigint"), lambda s, k: s + F.get(later, r - k)
            ),
        )
        return F.concat(F.array(level), acc)

    return F.aggregate(F.reverse("caps"), F.array(none), prepend)


def enumerate_worlds(pools: DataFrame) -> DataFrame:
    """B-01: every hand of the given size within the pool, in lexicographic order of its counts.

    Names are expanded one after another (a narrow explode per name, dead ends cut by the
    table of possible completions). The index of a hand is the number of hands before it,
    which the same table gives, so no sort, window or shuffle of worlds is needed; partial hands are
    spread once so that a single large space is shared by many tasks.
    """
    entries = F.array_sort(F.map_entries(F.map_filter("pool", lambda k, v: v > 0)))
    d = pools.withColumn("__e", entries).select(
        "space_id", F.col("hand_size").cast("int").alias("hand_size"),
        F.transform("__e", lambda e: e["key"]).alias("names"), F.transform("__e", lambda e: e["value"].cast("int")).alias("caps"),
    )
    # Pools and their tables are evaluated once, spread and written: every level reads them.
    d = cut_lineage(d.withColumn("ways", _suffix_counts()).filter("ways[0][hand_size] > 0").repartition("space_id"))
    longest = d.agg(F.max(F.size("caps")).alias("n")).first()["n"] or 0
    d = d.selectExpr(
        "space_id", "names", "caps", "ways", "hand_size AS rest", "0L AS world_index",
        "CAST(1 AS DECIMAL(38,0)) AS weight", "CAST(array() AS ARRAY<INT>) AS ks",
    )
    for i in range(longest):
        here, cap = f"{i} < size(caps)", f"get(caps, {i})"
        options = f"filter(sequence(0, least({cap}, rest)), j -> get(get(ways, {i + 1}), rest - j) > 0)"
        before = f"aggregate(slice(get(ways, {i + 1}), rest - k + 2, k), 0L, (s, x) -> s + x)"
        choose = f"aggregate(sequence(1, k), 1L, (c, j) -> (c * ({cap} - j + 1)) div j)"
        d = d.selectExpr("*", f"explode(CASE WHEN {here} THEN {options} ELSE array(0) END) AS k").selectExpr(
            "space_id", "names", "caps", "ways", "rest - k AS rest",
            f"CASE WHEN {here} AND k > 0 THEN world_index + {before} ELSE world_index END AS world_index",
            f"CASE WHEN k > 0 THEN CAST(weight * CAST({choose} AS DECIMAL(20,0)) AS DECIMAL(38,0)) ELSE weight END AS weight",
            f"CASE WHEN {here} THEN concat(ks, array(k)) ELSE ks END AS ks",
        )
        if i + 1 == SPREAD_AFTER and longest > SPREAD_AFTER:
            d = d.repartition("space_id", "world_index")
    pairs = "filter(arrays_zip(names, ks), p -> p.ks > 0)"
    # The names are sorted, so the canonical key needs no further sort.
    return d.selectExpr(
        "space_id", "world_index", f"map_from_entries({pairs}) AS hand", "weight",
        f"concat_ws(';', transform({pairs}, p -> concat_ws('=', p.names, CAST(p.ks AS STRING)))) AS hand_key",
    )


def total_weights(pools: DataFrame) -> DataFrame:
    """B-01: per space C(N, H), the total deal weight."""
    n = F.aggregate(F.map_values("pool"), F.lit(0), lambda a, x: a + x.cast("int"))
    return pools.select("space_id", binomial(n, F.col("hand_size")).alias("total_weight"))


# ------------------------------------------------------------------ conditioning


def support(worlds: DataFrame, queries: Sequence[WorldQuery]) -> DataFrame:
    """B-02: size and total weight of the worlds satisfying each query (zero allowed), in one pass."""
    aggs = []
    for i, q in enumerate(queries):
        hit = world_predicate(q)
        aggs.append(E.count_true(hit).alias(f"n{i}"))
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0)).cast("decimal(38,0)").alias(f"w{i}"))
    wide = worlds.groupBy("space_id").agg(*aggs)
    rows = [
        F.struct(F.lit(q.query_id).alias("query_id"), F.col(f"n{i}").alias("support_size"), F.col(f"w{i}").alias("total_weight"))
        for i, q in enumerate(queries)
    ]
    return wide.select("space_id", F.explode(F.array(*rows)).alias("r")).select("space_id", "r.*")


def conditions(worlds: DataFrame, queries: Sequence[WorldQuery]) -> tuple[DataFrame, DataFrame]:
    """B-03/B-04: (matching worlds with normalised weight and mass per query, empty-support violations).

    A world is repeated once per query it satisfies; the query list is declared.
    """
    tags = F.array_compact(F.array(*[F.when(world_predicate(q), F.lit(q.query_id)) for q in queries]))
    rows = worlds.select("space_id", "world_index", "hand_key", F.col("weight").cast("double").alias("weight"), F.explode(tags).alias("condition"))
    mass = rows.groupBy("space_id", "condition").agg(F.sum("weight").alias("mass"), F.count(F.lit(1)).alias("support_size"))
    total = worlds.groupBy("space_id").agg(F.sum(F.col("weight").cast("double")).alias("__all"))
    out = rows.join(mass, ["space_id", "condition"]).join(total, "space_id").select(
        "space_id", "condition", "world_index", "hand_key", (F.col("weight") / F.col("mass")).alias("p"),
        (F.col("mass") / F.col("__all")).alias("condition_mass"), "support_size",
    )
    want = total.select("space_id", F.explode(F.array(*[F.lit(q.query_id) for q in queries])).alias("condition"))
    empty = want.join(mass, ["space_id", "condition"], "left_anti").select(
        *violation("empty_support", F.concat_ws("/", F.col("space_id").cast("string"), "condition"))
    )
    return out, empty


def query_plan(has: WorldQuery, q: WorldQuery) -> list[WorldQuery]:
    """B-04: the five aligned conditions True, Has, not Has, Q, not Q."""
    return [WorldQuery("true", "true"), has, negation(has), q, negation(q)]


# ------------------------------------------------------------------ beliefs


def log_normalise(df: DataFrame, keys: Sequence[str], column: str = "log_p") -> tuple[DataFrame, DataFrame]:
    """Subtract the log of the summed mass per key; keys without finite mass are violations.

    Maximum and shifted sum are two partial aggregations joined back, so a large space
    is normalised by many tasks.
    """
    finite = F.col(column) > F.lit(NEG_INF)
    top = df.groupBy(*keys).agg(F.max(F.when(finite, F.col(column))).alias("__m"))
    shifted = df.join(top, list(keys))
    z = shifted.groupBy(*keys).agg(
        F.max("__m").alias("__m"), F.sum(F.when(finite, F.exp(F.col(column) - F.col("__m")))).alias("__s")
    )
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bad = top.filter(F.col("__m").isNull()).select(*violation("no_finite_mass", text))
    norm = z.filter(F.col("__m").isNotNull()).select(*keys, (F.col("__m") + F.log("__s")).alias("__z"))
    out = df.join(norm, list(keys)).withColumn(column, F.col(column) - F.col("__z")).drop("__z")
    return out, bad


def prior(worlds: DataFrame) -> DataFrame:
    """B-05: compatible prior, log weight minus log total weight."""
    total = worlds.groupBy("space_id").agg(F.sum(F.col("weight").cast("double")).alias("__t"))
    return worlds.join(total, "space_id").select(
        "space_id", "world_index", "hand", "hand_key",
        (F.log(F.col("weight").cast("double")) - F.log("__t")).alias("log_p"),
    )


def from_weights(df: DataFrame, keys: Sequence[str] = ("space_id",), weight: str = "w") -> tuple[DataFrame, DataFrame]:
    """B-05: belief from non-negative weights; zero weight becomes -infinity."""
    total = df.groupBy(*keys).agg(F.sum(weight).alias("__t"), E.all_true(E.finite(weight) & (F.col(weight) >= 0)).alias("__ok"))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    good = F.col("__ok") & (F.col("__t") > 0)
    bad = total.filter(~F.coalesce(good, F.lit(False))).select(*violation("invalid_weights", text, F.col("__t")))
    w = F.col(weight).cast("double")
    out = df.join(total.filter(good), list(keys)).withColumn(
        "log_p", F.when(w > 0, F.log(F.when(w > 0, w) / F.col("__t"))).otherwise(F.lit(NEG_INF))
    )
    return out.drop("__t", "__ok"), bad


def update(beliefs: DataFrame, likelihoods: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """B-06: condition on one commitment: mixed = (1-e)·L + e·matching/legal where both counts are
    positive, else 0; renormalised. Violations: ranges, missing rows, spaces without mass.

    A space with any violation ends: none of its worlds is returned.
    """
    if not 0.0 <= epsilon < 1.0:
        raise ValueError("epsilon must be in [0, 1)")
    key = ["space_id", "world_index"]
    j = beliefs.join(likelihoods, key, "left")
    like, legal, match = F.col("likelihood"), F.col("legal"), F.col("matching")
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    rules = [
        F.when(like.isNull(), F.lit("missing_likelihood")),
        F.when(like.isNotNull() & ~(E.finite("likelihood") & like.between(0, 1)), F.lit("likelihood_range")),
        F.when((legal < 0) | (match < 0), F.lit("negative_count")), F.when(match > legal, F.lit("matching_exceeds_legal")),
    ]
    broken = F.array_compact(F.array(*rules))
    bad = j.select(F.explode(broken).alias("rule"), text.alias("key"), F.lit("").alias("detail"))
    ended = j.filter(F.size(broken) > 0).select("space_id").distinct()
    share = match.cast("double") / F.when(legal > 0, legal)
    mixed = F.when((legal > 0) & (match > 0), (1.0 - epsilon) * like + epsilon * share).otherwise(0.0)
    new = j.join(ended, "space_id", "left_anti").withColumn("__x", mixed).withColumn(
        "log_p", F.when(F.col("__x") > 0, F.col("log_p") + F.log(F.when(F.col("__x") > 0, F.col("__x")))).otherwise(F.lit(NEG_INF))
    )
    out, empty = log_normalise(new.select(*beliefs.columns), ["space_id"])
    return out, bad.unionByName(empty)


def _merge_hands(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the masses that arrive at the same hand; a hand has at most one source per pool name."""
    g = rows.groupBy(*keys, "hand_key").agg(F.first("hand").alias("hand"), F.collect_list("log_p").alias("__l"))
    return g.withColumn("log_p", E.log_sum_exp_array("__l")).drop("__l")


def _add_card(hand: Column, card: Column, n: int = 1) -> Column:
    current = F.coalesce(F.try_element_at(hand, card), F.lit(0))
    rest = F.map_filter(hand, lambda k, v: k != card)
    grown = F.map_concat(rest, F.map_from_arrays(F.array(card), F.array((current + n).cast("int"))))
    return F.map_filter(grown, lambda k, v: v > 0)


def draw(beliefs: DataFrame, pools: DataFrame) -> DataFrame:
    """B-07: one hidden draw: each world splits over the cards left in the library,
    with probability available / library size. Worlds without mass do not contribute."""
    p = pools.select("space_id", "pool", "hand_size")
    size = F.aggregate(F.map_values("pool"), F.lit(0), lambda a, x: a + x.cast("int")) - F.col("hand_size")
    j = beliefs.filter(F.col("log_p") > F.lit(NEG_INF)).join(p, "space_id").withColumn("__lib", size)
    left = F.map_zip_with("pool", "hand", lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    rows = j.select("space_id", "hand", "log_p", "__lib", F.explode(F.map_filter(left, lambda k, v: v > 0)).alias("card", "avail"))
    rows = rows.select(
        "space_id", _add_card(F.col("hand"), F.col("card")).alias("hand"),
        (F.col("log_p") + F.log(F.col("avail").cast("double") / F.col("__lib"))).alias("log_p"),
    ).withColumn("hand_key", hand_key("hand"))
    return _merge_hands(rows, ["space_id"])


def remove_known(beliefs: DataFrame, facts: DataFrame) -> DataFrame:
    """B-08: one named card leaves the hidden hand; worlds without it lose their mass.

    ``facts``: space_id, card. Different hands stay different, so nothing is merged or shuffled.
    """
    j = beliefs.join(facts.select("space_id", "card"), "space_id").filter(hand_count("hand", F.col("card")) > 0)
    return j.withColumn("hand", _add_card(F.col("hand"), F.col("card"), -1)).withColumn("hand_key", hand_key("hand")).drop("card", "world_index")


def add_known(beliefs: DataFrame, facts: DataFrame) -> DataFrame:
    """B-08: one publicly named card enters the hidden hand."""
    j = beliefs.join(facts.select("space_id", "card"), "space_id")
    return j.withColumn("hand", _add_card(F.col("hand"), F.col("card"))).withColumn("hand_key", hand_key("hand")).drop("card", "world_index")


def _shift(hand: Column, names: Column, step: int) -> Column:
    return F.aggregate(names, hand, lambda acc, c: _add_card(acc, c, step))


def transport(beliefs: DataFrame, pools: DataFrame, facts: DataFrame, target_worlds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-09: exits, then returns, then hidden draws, then the join into the next space (J-09).

    ``facts``: space_id, next_space_id, exits array<string>, returns array<string>, hidden_draws.
    Several spaces move at once; spaces that need fewer draws wait unchanged. A space any of whose mass
    arrives outside the next space's worlds ends with a violation. Facts of spaces without a belief are ignored.
    """
    from scoreloom.operators.comparisons import join_support

    f = facts.select("space_id", "next_space_id", "exits", "returns", "hidden_draws").join(
        beliefs.select("space_id").distinct(), "space_id", "left_semi")
    p = pools.select("space_id", "pool", "hand_size")
    j = beliefs.filter(F.col("log_p") > F.lit(NEG_INF)).join(f, "space_id").join(p, "space_id")
    need = lambda h: F.forall(
        F.array_distinct("exits"), lambda c: F.coalesce(F.try_element_at(h, c), F.lit(0)) >= F.size(F.filter("exits", lambda x: x == c))
    )
    j = j.filter(need(F.col("hand")))
    j = j.select(
        "space_id", "next_space_id", _shift(_shift(F.col("hand"), F.col("exits"), -1), F.col("returns"), 1).alias("hand"),
        _shift(_shift(F.col("pool"), F.col("exits"), -1), F.col("returns"), 1).alias("pool"),
        (F.col("hand_size") - F.size("exits") + F.size("returns")).alias("hand_size"), F.col("hidden_draws").alias("__todo"), "log_p",
    ).withColumn("hand_key", hand_key("hand"))
    most = f.agg(F.max("hidden_draws").alias("n")).first()["n"] or 0
    for _ in range(most):
        waiting = j.filter(F.col("__todo") == 0)
        moving = j.filter(F.col("__todo") > 0)
        lib = F.aggregate(F.map_values("pool"), F.lit(0), lambda a, x: a + x.cast("int")) - F.col("hand_size")
        left = F.map_zip_with("pool", "hand", lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
        rows = moving.withColumn("__lib", lib).select("*", F.explode(F.map_filter(left, lambda k, v: v > 0)).alias("card", "avail"))
        rows = rows.select(
            "space_id", "next_space_id", "pool", "hand_size", "__todo", _add_card(F.col("hand"), F.col("card")).alias("hand"),
            (F.col("log_p") + F.log(F.col("avail").cast("double") / F.col("__lib"))).alias("log_p"),
        ).withColumn("hand_key", hand_key("hand"))
        merged = rows.groupBy("space_id", "next_space_id", "hand_key").agg(
            F.first("hand").alias("hand"), F.first("pool").alias("pool"), F.first("hand_size").alias("hand_size"),
            F.first("__todo").alias("__todo"), F.collect_list("log_p").alias("__l"),
        ).withColumn("log_p", E.log_sum_exp_array("__l")).drop("__l")
        merged = merged.withColumns({"hand_size": F.col("hand_size") + 1, "__todo": F.col("__todo") - 1})
        j = waiting.unionByName(merged.select(*waiting.columns))
    # Written once: the joins below and each pass of the normalisation would draw again.
    moved = cut_lineage(j.select(F.col("next_space_id").alias("space_id"), "hand_key", "log_p"))
    target = target_worlds.join(f.select(F.col("next_space_id").alias("space_id")).distinct(), "space_id", "left_semi")
    target = target.select("space_id", "world_index", "hand", "hand_key")
    joined, lost = join_support(moved, target)
    ended = moved.join(target, ["space_id", "hand_key"], "left_anti").select("space_id").distinct()
    out, empty = log_normalise(cut_lineage(joined.join(ended, "space_id", "left_anti")), ["space_id"])
    return out, lost.unionByName(empty)


# ------------------------------------------------------------------ diagnostics and scoring


def belief_stats(beliefs: DataFrame, keys: Sequence[str] = ("space_id",)) -> DataFrame:
    """B-10: support, positive support, normalisation error, effective size 1/Σp², top mass."""
    p = F.exp("log_p")
    return beliefs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support_size"), E.count_true(F.col("log_p") > F.lit(NEG_INF)).alias("positive_support"),
        F.abs(F.sum(p) - 1.0).alias("normalisation_error"), (1.0 / F.sum(p * p)).alias("effective_size"), F.max(p).alias("top_mass"),
    )


def inclusion(beliefs: DataFrame, pools: DataFrame, keys: Sequence[str] = ("space_id",)) -> DataFrame:
    """B-11: probability that the hand holds each pool card; a card in no world has probability 0."""
    held = beliefs.select(*keys, F.explode(F.map_keys("hand")).alias("card"), F.exp("log_p").alias("p")).groupBy(*keys, "card").agg(F.sum("p").alias("p"))
    cards = pools.select("space_id", F.explode(F.map_keys("pool")).alias("card"))
    spine = cards if list(keys) == ["space_id"] else beliefs.select(*keys).distinct().join(cards, "space_id")
    return spine.join(held, [*keys, "card"], "left").select(*keys, "card", F.coalesce("p", F.lit(0.0)).alias("p"))


def sample_worlds(beliefs: DataFrame, uniforms: DataFrame, keys: Sequence[str] = ("space_id",), buckets: int = 64, salts: int = 32) -> DataFrame:
    """B-12: inverse-CDF samples of every belief with shared uniforms (draw, u).

    Intervals [previous, cumulative) are cut into buckets of the unit interval, so the range
    condition becomes an equi-join on the bucket; the last interval of a belief ends at 1. The uniforms are repeated
    for ``salts`` parts of the spaces, so that buckets × parts tasks can share the work.
    """
    cum = O.running(beliefs.withColumn("__p", F.exp("log_p")), keys, "world_index", {"__hi": "__p"})
    last = beliefs.groupBy(*keys).agg(F.max("world_index").alias("__last"))
    cum = cum.join(last, list(keys))
    # The lower edge is the neighbour's cumulative value, exactly, not a difference.
    cum = O.neighbour(cum, keys, "world_index", {"__prev": "__hi"})
    cum = cum.withColumns(
        {"__lo": F.coalesce("__prev", F.lit(0.0)), "__hi": F.when(F.col("world_index") == F.col("__last"), F.lit(1.0)).otherwise(F.col("__hi"))}
    ).filter(F.col("__hi") > F.col("__lo"))
    cell = lambda c: F.greatest(F.least(F.floor(c * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")
    part = F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias("__part")
    spread = cum.select(*keys, "world_index", "__lo", "__hi", part, F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))).alias("__b"))
    u = uniforms.select("draw", "u", cell(F.col("u")).alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__part"))
    return spread.join(u, ["__b", "__part"]).filter((F.col("u") >= F.col("__lo")) & (F.col("u") < F.col("__hi"))).select(*keys, "draw", "world_index")


def shared_uniforms(spark, count: int, seed: int) -> DataFrame:
    """The declared number of uniforms of one numpy stream."""
    u = np.random.default_rng(seed).random(count)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "draw int, u double")


def score_truth(beliefs: DataFrame, pools: DataFrame, truth: DataFrame) -> DataFrame:
    """B-13: per truth point the index, probability, log loss (infinite at 0), rank, top mass,
    effective size and the card points. ``truth``: point_id, space_id, hand."""
    p = beliefs.withColumn("p", F.exp("log_p"))
    ranked = world_rank(p.select("space_id", "world_index", "hand_key", "p"), ["space_id"])
    stats = belief_stats(beliefs).select("space_id", "top_mass", "effective_size")
    cards = inclusion(beliefs, pools).groupBy("space_id").agg(F.collect_list(F.struct("card", "p")).alias("__c"))
    t = truth.withColumn("hand_key", hand_key("hand"))
    j = t.join(ranked, ["space_id", "hand_key"], "left").join(stats, "space_id").join(cards, "space_id")
    prob = F.coalesce("p", F.lit(0.0))
    hand = F.col("hand")
    points = F.transform(
        "__c", lambda c: F.struct(c["card"].alias("card"), c["p"].alias("predicted"), (F.coalesce(F.try_element_at(hand, c["card"]), F.lit(0)) > 0).alias("present"))
    )
    return j.select(
        "point_id", "space_id", F.col("world_index").alias("true_world_index"), prob.alias("probability"),
        F.when(prob > 0, -F.log(F.when(prob > 0, prob))).otherwise(F.lit(float("inf"))).alias("log_loss"), "rank", "top_mass", "effective_size",
        points.alias("cards"),
    )


def score_paired(posterior: DataFrame, prior_: DataFrame, pools: DataFrame, truth: DataFrame) -> DataFrame:
    """B-14: posterior and prior scored on the same truths: improvement in nats and mass ratio."""
    a = score_truth(posterior, pools, truth)
    b = score_truth(prior_, pools, truth).select("point_id", F.col("log_loss").alias("prior_log_loss"), F.col("probability").alias("prior_probability"))
    j = a.join(b, "point_id")
    ratio = F.when(F.col("prior_probability") > 0, F.col("probability") / F.when(F.col("prior_probability") > 0, F.col("prior_probability")))
    return j.select(
        "point_id", "space_id", F.col("log_loss").alias("posterior_log_loss"), "prior_log_loss",
        (F.col("prior_log_loss") - F.col("log_loss")).alias("improvement"),
        ratio.otherwise(F.lit(float("inf"))).alias("mass_ratio"),
    )


# ------------------------------------------------------------------ commitments


PUBLIC_KINDS = ("pass_priority", "cast", "play_land", "discard", "decline_discard")
CARD_KINDS = ("cast", "play_land", "discard")


def commitment_key(commitment: Column) -> Column:
    """Canonical text of a public commitment map: keys in order, compact JSON."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(commitment))))


def commitment_match(worlds: DataFrame, offers: str = "offers", observed: str = "observed") -> tuple[DataFrame, DataFrame]:
    """B-16: per world the number of legal offers, those with the observed public identity and their
    indexes; observed kinds that are not public, or lack their card, are violations.

    ``offers`` is array<map<string,string>>; a NULL entry has no public identity.
    """
    kind, card = F.try_element_at(observed, F.lit("kind")), F.try_element_at(observed, F.lit("card"))
    known = F.coalesce(kind.isin(*PUBLIC_KINDS), F.lit(False))
    named = ~kind.isin(*CARD_KINDS) | (F.coalesce(card, F.lit("")) != "")
    text = F.concat_ws("/", F.col("space_id").cast("string"), F.col("world_index").cast("string"))
    bad = worlds.filter(~known | ~F.coalesce(named, F.lit(False))).select(*violation("unsupported_commitment", text, F.coalesce(kind, F.lit(""))))
    keys = F.transform(offers, commitment_key)
    hits = E.let(
        F.struct(keys.alias("k"), commitment_key(F.col(observed)).alias("o")),
        lambda t: F.filter(F.transform(t["k"], lambda x, i: F.when(x == t["o"], i)), lambda i: i.isNotNull()),
    )
    out = worlds.filter(known & F.coalesce(named, F.lit(False))).withColumn("matching_indexes", hits)
    return out.withColumns({"matching": F.size("matching_indexes"), "legal": F.size(offers)}), bad


def policy_likelihood(rows: DataFrame, logits: str = "logits", indexes: str = "matching_indexes") -> DataFrame:
    """B-17: summed softmax probability of the matching offers, 0 without a match."""
    return rows.withColumn(
        "likelihood",
        E.let(
            F.struct(E.softmax(logits).alias("p"), F.col(indexes).alias("i")),
            lambda t: F.aggregate(t["i"], F.lit(0.0), lambda acc, k: acc + F.get(t["p"], k)),
        ),
    )


# ------------------------------------------------------------------ tracker fold


def continuity_violations(transitions: DataFrame, starts: DataFrame) -> DataFrame:
    """B-15: transitions whose before-revision or before-space is not the state they meet."""
    key = ["game", "viewer"]
    t = O.neighbour(transitions, key, "sequence", {"__rev": "after_revision", "__space": "after_space"})
    t = t.join(starts.select(*key, F.col("revision").alias("__r0"), F.col("space_id").alias("__s0")), key, "left")
    rev, space = F.coalesce("__rev", "__r0"), F.coalesce("__space", "__s0")
    rules = [
        F.when(~F.col("before_revision").eqNullSafe(rev), F.lit("revision_gap")),
        F.when(~F.col("before_space").eqNullSafe(space), F.lit("space_gap")),
    ]
    text = F.concat_ws("/", F.col("game").cast("string"), F.col("viewer").cast("string"), F.col("sequence").cast("string"))
    return t.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), text.alias("key"), F.lit("").alias("detail"))
