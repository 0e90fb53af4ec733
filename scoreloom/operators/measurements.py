"""A-ops: latency profiles, search statistics, measurement cells, spans, data-set diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.joins import attach_row, join_back

INF = float("inf")


# ------------------------------------------------------------------ search cost and profiles


def search_cost(blocks: DataFrame, by: Sequence[str] = ("player_id",)) -> DataFrame:
    """A-15: totals over worker blocks plus quantiles of the pooled per-decision samples.

    ``blocks``: decisions, seconds, simulations, cap_hits, max_depth_sum, max_depth and
    ``decision_seconds`` (array). Quantiles use the samples, never per-block quantiles.
    """
    totals = blocks.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("decisions", "seconds", "simulations", "cap_hits")],
        F.sum("max_depth_sum").alias("__depth"),
        F.max("max_depth").alias("max_depth_max"),
    )
    samples = blocks.select(*by, F.explode("decision_seconds").alias("s"))
    q = O.exact_quantiles(samples, by, "s", {"p50": 0.5, "p95": 0.95})
    out = join_back(totals, q, by, "left")
    return out.select(
        *by, "decisions", "seconds", "simulations", "cap_hits", "max_depth_max",
        E.rate("seconds", "decisions").alias("mean_seconds_per_decision"),
        F.coalesce("p50", F.lit(0.0)).alias("median_seconds_per_decision"),
        E.rate("simulations", "decisions").alias("mean_sims_per_decision"),
        E.rate("cap_hits", "simulations").alias("cap_rate"),
        (F.col("p50") * 1000).alias("p50_decision_ms"),
        (F.col("p95") * 1000).alias("p95_decision_ms"),
        E.rate("decisions", "seconds", None).alias("labels_per_second"),
        E.rate("__depth", "decisions").alias("mean_max_depth"),
    )


def native_profile(matches: DataFrame) -> DataFrame:
    """A-16: per player decisions, time, games and rates from the per-match latency map.

    The reference keeps the list of per-match quantiles; here it stays rows
    (``native_profile_cells``), because one player's list can be most of the table.
    """
    cells = matches.select("game_seconds", F.explode("latency").alias("player_id", "l"))
    out = cells.groupBy("player_id").agg(
        F.sum("l.count").alias("decisions"),
        F.sum("l.seconds").alias("decision_seconds"),
        F.count(F.lit(1)).alias("games"),
        F.sum("game_seconds").alias("game_seconds"),
        F.count("l.p50").alias("quantile_cells"),
    )
    return out.withColumns(
        {
            "decisions_per_second": E.rate("decisions", "decision_seconds", None),
            "games_per_second": E.rate("games", "game_seconds", None),
        }
    )


def native_profile_cells(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-16: the retained per-match p50 and p95, as rows."""
    return (
        matches.select(*keys, F.explode("latency").alias("player_id", "l"))
        .filter(F.col("l.p50").isNotNull())
        .select(*keys, "player_id", F.col("l.p50").alias("p50"), F.col("l.p95").alias("p95"))
    )


def isolated_profile(samples: DataFrame, by: Sequence[str] = ("player_id",)) -> DataFrame:
    """A-17: isolated latency profile; with no elapsed time decisions/s is infinite, others NULL."""
    t = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("latency_seconds").alias("elapsed"),
        F.sum("simulations").alias("__sims"),
        F.sum("cap_hits").alias("__caps"),
        F.coalesce(F.sum("tree_nodes"), F.lit(0)).alias("__nodes"),
        F.max("peak_rss_bytes").alias("__peak"),
        F.min("baseline_rss_bytes").alias("__base"),
    )
    q = O.exact_quantiles(samples, by, "latency_seconds", {"p50_seconds": 0.5, "p95_seconds": 0.95})
    return join_back(t, q, by, "left").select(
        *by, "samples", "elapsed", "p50_seconds", "p95_seconds",
        E.rate("samples", "elapsed", INF).alias("decisions_per_second"),
        E.rate("__sims", "elapsed", None).alias("simulations_per_second"),
        E.rate("__nodes", "elapsed", None).alias("nodes_per_second"),
        E.rate("elapsed", "samples", None).alias("cpu_seconds_per_label"),
        E.rate("__nodes", "samples", None).alias("nodes_per_label"),
        E.rate("__caps", "__sims").alias("playout_cap_rate"),
        F.greatest(F.lit(0), F.col("__peak") - F.col("__base")).alias("peak_rss_delta_bytes"),
    )


def deck_wins(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-18: (wins and rate per deck with draws, per deck and seat games/wins/rate)."""
    seats = records.select(
        "winner_seat", F.posexplode("seat_decks").alias("seat", "deck")
    ).withColumn("won", F.col("winner_seat") == F.col("seat"))
    per_seat = seats.groupBy("deck", "seat").agg(
        F.count(F.lit(1)).alias("games"), E.count_true(F.col("won")).alias("wins")
    ).withColumn("win_rate", E.rate("wins", "games"))
    # Each record contributes its outcome once: the winning deck or the draw.
    outcome = records.select(
        F.when(F.col("winner_seat").isNull(), F.lit("draw"))
        .otherwise(F.element_at("seat_decks", (F.col("winner_seat") + 1).cast("int"))).alias("deck")
    )
    total = records.agg(F.count(F.lit(1)).alias("records"))
    wins = (
        outcome.groupBy("deck").agg(F.count(F.lit(1)).alias("wins"))
        .transform(attach_row, total)
        .select("deck", "wins", F.when(F.col("deck") != "draw", E.rate("wins", "records")).alias("rate"))
    )
    return wins, per_seat


# ------------------------------------------------------------------ visit distributions


def root_mechanism(samples: DataFrame) -> DataFrame:
    """A-20: entropy of the visit distribution and its distance to the input prior, per root."""
    p = E.normalised("visit_counts")
    d = samples.withColumn("visit_distribution", p)
    n = F.size("visit_counts")
    d = d.withColumn("visit_entropy", E.entropy("visit_distribution"))
    return d.withColumns(
        {
            "normalized_visit_entropy": F.when(
                n > 1, F.col("visit_entropy") / F.log(n.cast("double"))
            ).otherwise(F.lit(0.0)),
            "prior_visit_l1": E.l1_distance("visit_distribution", "input_prior"),
            "prior_visit_jsd": E.js_divergence("visit_distribution", "input_prior"),
            "prior_top_search_top_agreement": F.when(
                E.first_argmax("input_prior") == E.first_argmax("visit_counts"), 1
            ).otherwise(0),
        }
    )


MECHANISM_COLUMNS = (
    "visit_entropy", "normalized_visit_entropy", "prior_visit_l1", "prior_visit_jsd",
    "prior_top_search_top_agreement",
)


def mechanism_summary(samples: DataFrame, by: Sequence[str] = ("player_id",)) -> DataFrame:
    """A-21: means of the root metrics overall and per bucket; players without visits are unavailable."""
    searched = root_mechanism(samples.filter(F.col("visit_counts").isNotNull()))
    bucket = F.concat_ws(
        "__legal-", F.col("action_space_kind"), F.col("legal_action_count").cast("string")
    )
    tagged = searched.withColumn("bucket", F.explode(F.array(F.lit("aggregate"), bucket)))
    means = tagged.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("roots"),
        *[F.avg(c).alias(f"mean_{c}") for c in MECHANISM_COLUMNS],
    )
    none = (
        samples.groupBy(*by).agg(F.max(F.col("visit_counts").isNotNull()).alias("any"))
        .filter(~F.col("any")).select(*by)
    )
    flagged = means.withColumn("available", F.lit(True))
    return flagged.unionByName(none.withColumn("available", F.lit(False)), allowMissingColumns=True)


def teacher_action(visits: Column | str, q_values: Column | str) -> Column:
    """F-05: index of the most visited action; among equals the one with the highest value."""
    v, q = E.col(visits), E.col(q_values)
    pairs = F.zip_with(v, q, lambda x, y: F.struct(x.cast("double").alias("v"), y.cast("double").alias("q")))
    # Structs compare field by field: most visits first, then the largest value.
    return E.first_argmax(pairs)


def repeat_pairs(
    df: DataFrame, keys: Sequence[str], seed: str, seeds: Sequence[int], cols: Sequence[str]
) -> DataFrame:
    """Both sides of every pair of declared repeats, keyed (keys..., left seed, right seed).

    The declared repeat list fixes the fan-out, and every output group holds exactly two
    rows, so no group can grow with the data and no join inside a group is needed.
    """
    pairs = [(a, b) for i, a in enumerate(seeds) for b in seeds[i + 1:]]
    plan = F.array(
        *[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in pairs]
    )
    mine = F.filter(plan, lambda p: (p["l"] == F.col(seed)) | (p["r"] == F.col(seed)))
    payload = F.struct(*cols)
    rows = df.select(*keys, F.explode(mine).alias("p"), F.col(seed).alias("__s"), payload.alias("__v"))
    grouped = rows.groupBy(*keys, F.col("p.l").alias("left_seed"), F.col("p.r").alias("right_seed")).agg(
        F.max(F.when(F.col("__s") == F.col("p.l"), F.col("__v"))).alias("l"),
        F.max(F.when(F.col("__s") == F.col("p.r"), F.col("__v"))).alias("r"),
    )
    return grouped.filter(F.col("l").isNotNull() & F.col("r").isNotNull())


def root_stability(searches: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """A-22: per budget the agreement of repeated searches of one root and means of search shape."""
    d = searches.withColumns(
        {
            "dist": E.normalised("visit_counts"),
            "action": teacher_action("visit_counts", "q_values"),
        }
    )
    pairs = repeat_pairs(d, ["budget", "root_id"], "repeat_seed", seeds, ["dist", "action"])
    scored = pairs.select(
        "budget",
        E.js_divergence("l.dist", "r.dist").alias("js"),
        F.when(F.col("l.action") == F.col("r.action"), 1.0).otherwise(0.0).alias("agree"),
    )
    pair_stats = scored.groupBy("budget").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("agree").alias("top_action_agreement")
    )
    median = O.exact_quantiles(scored, ["budget"], "js", {"median_js_divergence": 0.5})
    positive = F.size(F.filter("dist", lambda x: x > 0))
    per = d.groupBy("budget").agg(
        F.count(F.lit(1)).alias("searches"),
        F.avg(E.entropy("dist")).alias("mean_target_entropy"),
        F.avg(positive / F.size("dist")).alias("mean_visit_coverage"),
        F.avg("tree_nodes").alias("mean_tree_nodes"),
        F.avg("max_depth").alias("mean_max_depth"),
        F.sum("cap_hits").alias("cap_hits"),
    )
    return join_back(join_back(per, pair_stats, ["budget"], "left"), median, ["budget"], "left")


def mechanism_contrast(primary: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """A-23: paired root metrics of two runs aligned on (by..., root_id).

    The drift uses Σ p·log((p+1e-12)/(q+1e-12)) without renormalising.
    """
    keys = [*by, "root_id"]
    a = primary.select(*keys, *[F.col(c).alias(f"l_{c}") for c in ("action", "root_value", "forward_calls", "input_prior")])
    b = other.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("action", "root_value", "forward_calls", "input_prior")])
    j = a.join(b, keys)
    drift = E.array_sum(
        F.zip_with("l_input_prior", "r_input_prior", lambda p, q: p * F.log((p + 1e-12) / (q + 1e-12)))
    )
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("roots"),
        F.avg(F.when(F.col("l_action") == F.col("r_action"), 1.0).otherwise(0.0)).alias("action_agreement"),
        F.avg(F.abs(F.col("l_root_value") - F.col("r_root_value"))).alias("mean_absolute_root_value_delta"),
        F.bool_and(F.col("l_forward_calls") == F.col("r_forward_calls")).alias("forward_count_match"),
        F.avg(drift).alias("mean_prior_kl"),
    )


def guidance_agreement(
    samples: DataFrame, pairs: Mapping[str, tuple[str, str]], player: str = "player_id"
) -> DataFrame:
    """A-24 (agreement part): share of common roots on which two named players act alike.

    The declared comparisons fix the fan-out; each (comparison, root) group has two rows.
    """
    plan = F.array(
        *[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in pairs.items()]
    )
    mine = F.filter(plan, lambda p: (p["a"] == F.col(player)) | (p["b"] == F.col(player)))
    rows = samples.select(F.explode(mine).alias("p"), F.col(player).alias("who"), "root_id", "action")
    per_root = rows.groupBy(F.col("p.n").alias("comparison"), "root_id").agg(
        F.max(F.when(F.col("who") == F.col("p.a"), F.col("action"))).alias("l"),
        F.max(F.when(F.col("who") == F.col("p.b"), F.col("action"))).alias("r"),
    )
    both = per_root.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("roots"),
        E.count_true(F.col("l") == F.col("r")).alias("agreements"),
        F.avg(F.when(F.col("l") == F.col("r"), 1.0).otherwise(0.0)).alias("agreement_rate"),
    )


def guidance_mechanism(samples: DataFrame, variants: DataFrame) -> DataFrame:
    """A-24 (player part): isolated cost and mean root metrics per arm and budget."""
    cost = isolated_profile(samples)
    shape = mechanism_summary(samples).filter(
        (F.col("bucket") == "aggregate") | F.col("bucket").isNull()
    ).drop("bucket")
    return variants.join(cost, "player_id").join(shape, "player_id", "left")


# ------------------------------------------------------------------ measurement cells


def cell_summary(
    workers: DataFrame,
    counters: Sequence[str] = ("allocation_count",),
    peaks: Sequence[str] = ("journal_bytes",),
) -> DataFrame:
    """A-25: two-level summary worker -> repeat -> cell.

    A counter or simultaneous peak is NULL if any worker could not measure it. The barrier
    time and the memory peak belong to the repeat, so they are taken once per repeat.
    """
    repeat = workers.groupBy("cell_id", "repeat").agg(
        F.max("barrier_wall_seconds").alias("barrier"),
        F.max("elapsed_seconds").alias("root_latency"),
        F.max("rss_peak_bytes").alias("rss"),
        F.sum("simulations").alias("sims"),
        F.sum("transitions").alias("trans"),
        F.sum("cap_hits").alias("caps"),
        *[E.poisoned_sum(c).alias(f"c_{c}") for c in counters],
        *[E.poisoned_sum(c).alias(f"p_{c}") for c in peaks],
    )
    out = repeat.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.sum("barrier").alias("barrier_wall_seconds"),
        F.sum("sims").alias("simulations"),
        F.sum("trans").alias("transitions"),
        F.sum("caps").alias("cap_hits"),
        F.max("rss").alias("rss_peak_bytes"),
        *[E.poisoned_sum(f"c_{c}").alias(c) for c in counters],
        *[
            F.when(F.count(f"p_{c}") == F.count(F.lit(1)), F.max(f"p_{c}")).alias(f"{c}_peak")
            for c in peaks
        ],
    )
    q = O.exact_quantiles(
        repeat, ["cell_id"], "root_latency",
        {f"root_latency_seconds_p{p}": p / 100 for p in (50, 95, 99)}, "nearest_rank",
    )
    return join_back(out, q, ["cell_id"], "left").withColumns(
        {
            "simulations_per_second": E.rate("simulations", "barrier_wall_seconds"),
            "transitions_per_second": E.rate("transitions", "barrier_wall_seconds"),
            "cap_rate": E.rate("cap_hits", "simulations"),
        }
    )


def latency_summary(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A-26: count, min, nearest-rank quantiles, max, mean (rounded half to even)."""
    s = samples.groupBy(*by).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.bround(F.avg(E.dbl(value)), 0).alias("mean"),
    )
    q = O.exact_quantiles(samples, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest_rank")
    return join_back(s, q, by, "left")


def _series(rows: DataFrame, by: str, value: str, prefix: str = "", unit: str = "_ms") -> DataFrame:
    """Per level of ``by``: min, max, mean, median and 95th percentile of a series of durations."""
    name = lambda part: f"{prefix}{part}{unit}"
    plain = rows.groupBy(by).agg(F.min(value).alias(name("min")), F.max(value).alias(name("max")), F.avg(value).alias(name("mean")))
    return join_back(plain, O.exact_quantiles(rows, [by], value, {name("p50"): 0.5, name("p95"): 0.95}), [by], "left")


_SERIES = ("min", "max", "mean", "p50", "p95")


def workload_summary(
    games: DataFrame, commands: DataFrame, expected_counters: Sequence[str], by: str = "surface", inner: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A-27: (rates and latency distribution per surface, counter sums, counter key violations).

    ``inner``: durations of the commands inside a protocol command. A surface without any has no such layer, so
    its inner series is that of its commands.
    """
    head = games.groupBy(by).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("commands").alias("commands"),
        F.sum("game_seconds").alias("seconds"),
    )
    out = join_back(head, _series(commands, by, "duration_ms"), [by], "left")
    if inner is not None:
        out = join_back(out, _series(inner, by, "duration_ms", "__inner_"), [by], "left")
        out = out.withColumns(
            {f"inner_{n}_ms": F.when(F.col("__inner_min_ms").isNull(), F.col(f"{n}_ms")).otherwise(F.col(f"__inner_{n}_ms")) for n in _SERIES}
        ).drop(*[f"__inner_{n}_ms" for n in _SERIES])
    out = out.withColumns(
        {
            "steps_per_second": E.rate("commands", "seconds"),
            "games_per_second": E.rate("games", "seconds"),
        }
    )
    wanted = F.array(*[F.lit(n) for n in expected_counters])
    keys = F.map_keys("fallback_counters")
    bad = games.filter(
        (F.size(F.array_except(keys, wanted)) > 0) | (F.size(F.array_except(wanted, keys)) > 0)
    ).select(
        F.lit("counter_keys").alias("rule"), F.col(by).cast("string").alias("key"),
        F.concat_ws(",", F.array_sort(keys)).alias("detail"),
    )
    sums = games.agg(
        *[
            F.coalesce(F.sum(F.try_element_at("fallback_counters", F.lit(n))), F.lit(0)).alias(n)
            for n in expected_counters
        ]
    )
    long = sums.select(F.explode(F.create_map(*[x for n in expected_counters for x in (F.lit(n), F.col(n).cast("bigint"))])).alias("counter", "total"))
    return out, long, bad


def workload_identity(games: DataFrame, expected: str | None = None, by: str = "surface") -> tuple[DataFrame, DataFrame]:
    """A-27: (terminal and trace digest of every surface, violations).

    Repetitions of a surface must end in one state by one trace, all surfaces in the same, and in ``expected`` where
    that is given. A surface that disagrees with itself has no digest.
    """
    names = ("terminal_state_sha256", "logical_trace_sha256")
    spread = games.groupBy(by).agg(
        *[F.min(F.coalesce(n, F.lit(""))).alias(f"__low_{n}") for n in names], *[F.max(F.coalesce(n, F.lit(""))).alias(f"__high_{n}") for n in names],
        F.count(F.lit(1)).alias("games"),
    )
    same = lambda n: F.col(f"__low_{n}") == F.col(f"__high_{n}")
    out = spread.select(by, "games", *[F.when(same(n), F.nullif(F.col(f"__low_{n}"), F.lit(""))).alias(n) for n in names])
    rule = lambda cond, rows, name, key, detail: rows.filter(cond).select(F.lit(name).alias("rule"), key.alias("key"), detail.alias("detail"))
    surface = F.col(by).cast("string")
    bad = [rule(~same(n), spread, f"nondeterministic_{n}", surface, F.col("games").cast("string")) for n in names]
    if expected is not None:
        drifted = games.filter(~F.col(names[0]).eqNullSafe(F.lit(expected))).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
        bad.append(rule(F.lit(True), drifted, "terminal_state_drift", surface, F.col("n").cast("string")))
    across = spread.agg(*[f(F.col(f"__{side}_{n}")).alias(f"__{side}_{n}") for n in names for f, side in ((F.min, "low"), (F.max, "high"))])
    for n in names:
        bad.append(rule(~same(n), across, f"surfaces_differ_in_{n}", F.lit("all"), F.lit("")))
    violations = bad[0]
    for more in bad[1:]:
        violations = violations.unionByName(more)
    return out, violations


def training_summary(
    games: DataFrame, rows: DataFrame, clock: DataFrame, simulations: int, max_decisions: int, by: str = "run"
) -> tuple[DataFrame, DataFrame]:
    """A-27: (training half of the workload summary per run, violations).

    ``games``: run, game, decisions, traversals, cpu_seconds, terminal. ``rows``: one per decision, with run, game,
    puct_ms, command_ms, native_actions. ``clock``: run, wall_seconds. A game must have ended, its decisions lie in
    1..``max_decisions`` and have a row each, and its traversals be ``simulations`` a decision.
    """
    head = games.groupBy(by).agg(
        F.count(F.lit(1)).alias("games"), F.sum("decisions").alias("decisions"), F.sum("traversals").alias("traversals"),
        F.sum("cpu_seconds").alias("worker_cpu_seconds"),
    )
    native = rows.groupBy(by).agg(E.count_true(~F.col("native_actions").eqNullSafe(F.lit(1))).alias("native_apply_mismatches"))
    out = head
    for part in (_series(rows, by, "puct_ms", "puct_"), _series(rows, by, "command_ms", "command_"), native, clock.select(by, "wall_seconds")):
        out = join_back(out, part, [by], "left")
    out = out.withColumns(
        {
            "native_apply_mismatches": F.coalesce("native_apply_mismatches", F.lit(0)),
            "steps_per_second": E.rate("decisions", "wall_seconds", None),
            "traversals_per_second": E.rate("traversals", "wall_seconds", None),
            "games_per_second": E.rate("games", "wall_seconds", None),
        }
    )
    held = rows.groupBy(by, "game").agg(F.count(F.lit(1)).alias("__rows"))
    j = join_back(games, held, [by, "game"], "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    checks = F.array(
        F.when(~F.coalesce("terminal", F.lit(False)), F.lit("nonterminal_game")),
        F.when(~F.coalesce(F.col("decisions").between(1, max_decisions), F.lit(False)), F.lit("decision_count")),
        F.when(~F.col("decisions").eqNullSafe(F.col("__rows")), F.lit("decision_rows")),
        F.when(~F.col("traversals").eqNullSafe(F.col("decisions") * simulations), F.lit("traversal_count")),
    )
    bad = j.select(F.explode(F.array_compact(checks)).alias("rule"), F.concat_ws("/", F.col(by).cast("string"), F.col("game").cast("string")).alias("key"),
                   F.concat_ws(":", F.col("decisions").cast("string"), F.col("__rows").cast("string"), F.col("traversals").cast("string")).alias("detail"))
    return out, bad


def token_census(samples: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A-28: (distributions of two counts plus overflow sums, the row with most tokens).

    Equal maxima go to the first sample (smallest ordinal).
    """
    from scoreloom.operators.aggregates import distribution

    dist = distribution(
        samples,
        {c: c for c in ("visible_object_references", "expanded_semantic_tokens")},
        by, {"p50": 0.5, "p95": 0.95}, full=False,
    )
    top = samples.groupBy(*by).agg(
        F.max_by(
            F.struct("ordinal", "viewer", "visible_object_references", "expanded_semantic_tokens"),
            F.struct(F.col("expanded_semantic_tokens"), -F.col("ordinal")),
        ).alias("m"),
        *[
            F.sum(c).alias(c)
            for c in ("overflow_count", "projection_failures", "unadmitted_visible_definitions")
        ],
    )
    return dist, top.select(*by, "m.*", "overflow_count", "projection_failures", "unadmitted_visible_definitions")


def span_tree(spans: DataFrame) -> DataFrame:
    """A-29: per path totals and sample statistics, with shares of the parent and of all roots."""
    s = spans.groupBy("path").agg(
        F.sum("seconds").alias("total_time"), F.count(F.lit(1)).alias("count"),
        F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.avg("seconds").alias("mean"),
    )
    q = O.exact_quantiles(spans, ["path"], "seconds", {"p5": 0.05, "p95": 0.95})
    s = join_back(s, q, ["path"])
    is_root = ~F.contains(F.col("path"), F.lit("/"))
    overall = s.filter(is_root).agg(F.sum("total_time").alias("__all"))
    parents = s.select(F.col("path").alias("__pp"), F.col("total_time").alias("__pt"))
    child = s.withColumn("__pp", F.regexp_replace("path", "/[^/]*$", ""))
    child = child.withColumn("__pp", F.when(is_root, F.lit(None)).otherwise(F.col("__pp")))
    out = attach_row(child.join(parents, "__pp", "left"), overall)
    parent = F.when(is_root, F.col("__all")).otherwise(F.coalesce("__pt", F.lit(0.0)))
    return out.select(
        "path", "total_time", "count", "min", "max", "mean", "p5", "p95",
        (100 * E.rate("total_time", parent)).alias("pct_of_parent"),
        (100 * E.rate("total_time", "__all")).alias("pct_of_total"),
    )


# ------------------------------------------------------------------ data sets and audits


def dataset_diagnostics(df: DataFrame, by: Sequence[str] = (), signal: str = "visits") -> DataFrame:
    """A-30: counts, mean target entropy and mean top-two margin of a labelled data set.

    ``signal`` selects the policy target: masked visit shares, or the scores themselves
    for the margin with softmax targets.
    """
    valid = F.transform("actions_valid", lambda x: x > 0)
    if signal == "visits":
        masked = F.zip_with(valid, "visit_counts", lambda ok, v: F.when(ok, v.cast("double")).otherwise(0.0))
        target = E.let(
            F.struct(masked.alias("v"), F.greatest(E.array_sum(masked), F.lit(1.0)).alias("s")),
            lambda t: F.transform(t["v"], lambda v: v / t["s"]),
        )
        ranked = F.zip_with(valid, target, lambda ok, v: F.when(ok, v))
    else:
        target = soft_targets("scores")
        ranked = F.transform("scores", lambda v: F.when(v >= 0, v.cast("double")))
    entropy = -E.array_sum(F.transform(target, lambda p: p * F.log(F.greatest(p, F.lit(1e-12)))))
    ordered = F.sort_array(F.filter(ranked, lambda x: x.isNotNull()), asc=False)
    margin = F.when(F.size(ordered) > 1, ordered[0] - ordered[1])
    action = F.col("action").cast("int")
    in_range = (action >= 0) & (action < F.size("actions_valid"))
    legal = F.coalesce(in_range & (F.get("actions_valid", action) > 0), F.lit(False))
    d = df.select(
        *by, "game_index", "num_valid", "winner", "root_value",
        entropy.alias("__e"), margin.alias("__m"), legal.alias("__legal"),
    )
    # Exact distinct games through a first aggregation per game keeps hot groups balanced.
    per_game = d.groupBy(*by, "game_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_valid").alias("nv"), F.sum("__e").alias("e"),
        F.sum("__m").alias("m"), F.count("__m").alias("mc"),
        E.count_true(F.col("winner").isNull()).alias("wl"), E.count_true(~F.col("__legal")).alias("bad"),
        F.sum("root_value").alias("rv"), F.count("root_value").alias("rc"),
    )
    s = per_game.groupBy(*by).agg(
        F.sum("n").alias("decisions"), F.count(F.lit(1)).alias("games"),
        *[F.sum(c).alias(c) for c in ("nv", "e", "m", "mc", "wl", "bad", "rv", "rc")],
    )
    return s.select(
        *by, "decisions", "games",
        E.rate("nv", "decisions", None).alias("mean_valid_actions"),
        E.rate("e", "decisions", None).alias("mean_target_entropy"),
        E.rate("m", "mc", None).alias("mean_top_two_margin"),
        F.col("wl").alias("winnerless_rows"), F.col("bad").alias("invalid_teacher_actions"),
        E.rate("rv", "rc", None).alias("mean_root_value"),
    )


def soft_targets(scores: Column | str, tau: float = 1.0) -> Column:
    """X-04: softmax of score/tau over entries >= 0; padded (negative) entries get 0."""
    top = F.array_max(F.transform(E.col(scores), lambda x: F.when(x >= 0, x.cast("double"))))
    raised = E.let(
        F.struct(E.doubles(scores).alias("v"), top.alias("m")),
        lambda t: F.transform(
            t["v"], lambda x: F.when(x >= 0, F.exp((x - t["m"]) / F.lit(tau))).otherwise(0.0)
        ),
    )
    return E.normalised(raised)


def dataset_checks(df: DataFrame, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """A-31: seven row checks folded to booleans, and their conjunction."""
    finite_all = lambda c: F.forall(c, lambda x: E.finite(x))
    checks = {
        "finite_visits": finite_all("visit_counts"),
        "finite_q_values": finite_all("scores"),
        "finite_root_values": E.finite("root_value"),
        "visit_mass": E.array_sum("visit_counts") == F.lit(float(budget)),
        "visits_within_legal_mask": F.forall(
            F.zip_with("actions_valid", "visit_counts", lambda ok, v: (ok > 0) | (v == 0)),
            lambda x: x,
        ),
        "root_values_in_range": (F.col("root_value") >= 0) & (F.col("root_value") <= 1),
        "terminal_outcomes_present": F.col("winner").isNotNull(),
    }
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("decisions"), *[E.all_true(c).alias(n) for n, c in checks.items()]
    )
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def audit_integrity(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-32: seven violation counts over search audits."""
    v, q = F.col("visit_counts"), F.col("q_values")
    ok_visits = F.forall(v, lambda x: E.finite(x) & (x >= 0)) & (E.array_sum(v) == F.col("simulations"))
    ok_values = F.forall(q, lambda x: E.finite(x) & (x >= 0) & (x <= 1)) & F.col("root_value").between(0, 1)
    legal = F.array_contains("offer_ids", F.col("command"))
    chosen_top = F.get(v, F.col("command").cast("int")) == F.array_max(v)
    shapes = (F.size(v) == F.size(q)) & (F.size(v) == F.size("offer_ids"))
    bad = {
        "invalid_visit_rows": ~F.coalesce(ok_visits, F.lit(False)),
        "invalid_value_rows": ~F.coalesce(ok_values, F.lit(False)),
        "invalid_legal_rows": ~F.coalesce(legal, F.lit(False)),
        "invalid_selected_rows": F.coalesce(legal, F.lit(False)) & ~F.coalesce(chosen_top, F.lit(False)),
        "shape_mismatches": ~shapes,
        "encoded_offer_mismatches": F.col("encoded_legal_count") != F.size("offer_ids"),
        "mutated_authoritative_roots": ~F.coalesce("root_unchanged", F.lit(False)),
    }
    out = decisions.groupBy(*by).agg(*[E.count_true(c).alias(n) for n, c in bad.items()])
    total = F.lit(0)
    for n in bad:
        total = total + F.col(n)
    return out.withColumn("passed", total == 0)


def index_receipt(
    decisions: DataFrame, kinds: Sequence[str], declared: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """A-33: (one-row receipt, zero-filled counts by kind).

    ``decisions``: decision_id, kind, viewer, automatic, n_offers, restored, candidate.
    """
    per_id = decisions.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n"))
    dup = per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_decision_ids"))
    one = decisions.agg(
        F.count(F.lit(1)).alias("decision_count"),
        E.count_true(F.col("automatic")).alias("automatic_decisions"),
        E.count_true(F.col("n_offers") <= 1).alias("forced_decisions"),
        E.count_true(F.col("restored")).alias("restored"),
        E.count_true(F.col("candidate")).alias("eligible_landmark_candidates"),
    ).transform(attach_row, dup)
    n = F.col("decision_count")
    status = (
        F.when(n == 0, "no_recorded_decisions")
        .when(F.col("eligible_landmark_candidates") < 3, "insufficient_supported_landmarks")
        .otherwise("ranked")
    )
    one = one.withColumns(
        {
            "exact_restoration_ratio": E.rate("restored", n, 1.0),
            "completeness_ratio": F.lit(1.0) if declared is None else F.when(
                n == declared, 1.0
            ).otherwise(n.cast("double") / F.lit(max(declared, 1))),
            "ranking_status": status,
        }
    ).drop("restored")
    spine = decisions.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counts = decisions.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    by_kind = spine.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("count"))
    return one, by_kind


# ------------------------------------------------------------------ conditional search


def condition_result(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-34: (Q per condition and action, uncertainty per condition).

    ``cells`` are sparse rows (condition, world, action, visits, value_sum). A world that
    did not visit an action counts with value 0.5; working with deviations from 0.5 makes
    those terms vanish, so the worlds × actions matrix is never densified.
    """
    worlds = cells.select("condition", "world").distinct().groupBy("condition").agg(
        F.count(F.lit(1)).alias("w")
    )
    dev = F.when(F.col("visits") > 0, F.col("value_sum") / F.col("visits") - 0.5).otherwise(0.0)
    per = cells.groupBy("condition", "action").agg(
        F.sum("visits").alias("visits"), F.sum("value_sum").alias("value_sum"),
        F.sum(dev).alias("d1"), F.sum(dev * dev).alias("d2"),
    )
    q = per.select("condition", "action", "visits", E.rate("value_sum", "visits", 0.5).alias("q"), "d1", "d2")
    j = q.join(worlds, "condition")
    w = F.col("w").cast("double")
    var = F.greatest((F.col("d2") - F.col("d1") * F.col("d1") / w) / F.nullif(w - 1, F.lit(0.0)), F.lit(0.0))
    se = F.when(F.col("w") > 1, F.sqrt(var / w)).otherwise(0.0)
    unc = j.groupBy("condition").agg(
        F.max("w").alias("worlds"),
        F.coalesce(F.avg(F.when(F.col("visits") > 0, se)), F.lit(0.0)).alias("uncertainty"),
    )
    return q.select("condition", "action", "visits", "q"), unc


def action_evidence(cells: DataFrame, covered: bool = True) -> DataFrame:
    """A-45: published evidence per condition and action; a quantity without coverage has a reason.

    ``cells``: (condition, world, action, visits, q). Robustness is the share of covered worlds
    in which the action is co-best among visited actions within 1e-12.
    """
    tol = F.greatest(F.abs(F.col("q")), F.abs(F.col("best"))) * 1e-9
    best = cells.filter(F.col("visits") > 0).groupBy("condition", "world").agg(F.max("q").alias("best"))
    j = cells.join(best, ["condition", "world"], "left")
    seen = F.col("visits") > 0
    close = F.abs(F.col("q") - F.col("best")) <= F.greatest(tol, F.lit(1e-12))
    per = j.groupBy("condition", "action").agg(
        F.sum("visits").alias("visits"),
        F.sum(F.when(seen, F.col("visits") * F.col("q"))).alias("__vq"),
        E.count_true(seen).alias("covered_worlds"),
        E.count_true(seen & close).alias("co_best_worlds"),
        F.stddev_samp(F.when(seen, F.col("q"))).alias("__sd"),
    )
    total = cells.groupBy("condition").agg(F.sum("visits").alias("__total"))
    j = per.join(total, "condition")
    c = F.col("covered_worlds")
    rob = F.when(c > 0, E.rate("co_best_worlds", c, None)) if covered else F.lit(None).cast("double")
    unc = F.when(c >= 2, F.col("__sd") / F.sqrt(c.cast("double"))) if covered else F.lit(None).cast("double")
    missing = F.lit("world_coverage_unrecorded")
    return j.select(
        "condition", "action", "visits",
        E.rate("visits", "__total", None).alias("probability"),
        E.rate("__vq", "visits", None).alias("q"),
        F.when(F.col("visits") == 0, F.lit("no_realized_visits")).alias("q_reason"),
        "covered_worlds", "co_best_worlds",
        rob.alias("robustness"),
        (F.when(c == 0, F.lit("no_realized_world_coverage")) if covered else missing).alias("robustness_reason"),
        unc.alias("uncertainty"),
        (F.when(c < 2, F.lit("insufficient_world_coverage")) if covered else missing).alias("uncertainty_reason"),
    )


def root_evidence(conditions: DataFrame, worlds: DataFrame) -> DataFrame:
    """A-45: root value and its standard error between worlds; a quantity without coverage has a reason.

    ``conditions``: condition, simulations, root_value. ``worlds``: condition, world, root_value, a row per sampled world.
    """
    per = worlds.groupBy("condition").agg(F.count("root_value").alias("__covered"), F.stddev_samp(E.dbl("root_value")).alias("__sd"))
    j = join_back(conditions, per, ["condition"], "left")
    covered = F.coalesce("__covered", F.lit(0))
    searched = F.coalesce(F.col("simulations") > 0, F.lit(False))
    return j.select(
        "condition", "simulations",
        F.when(searched, E.dbl("root_value")).alias("root_value"),
        F.when(~searched, F.lit("no_realized_simulations")).alias("root_value_reason"),
        covered.alias("covered_worlds"),
        F.when(covered >= 2, F.col("__sd") / F.sqrt(covered.cast("double"))).alias("root_uncertainty"),
        F.when(covered < 2, F.lit("insufficient_world_coverage")).alias("root_uncertainty_reason"),
    )


def evidence_violations(conditions: DataFrame, cells: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """A-45: what keeps a condition's evidence from being published.

    The visits of a condition must be positive and equal its simulations (``policy_mass``); a visited cell must have a value
    and visits can't be null or negative (``world_coverage``); with ``offers`` (action, offer_id), every action of the cells has
    exactly one offer and no offer serves two actions (``offer_alignment``).
    """
    total = cells.groupBy("condition").agg(
        F.sum("visits").alias("__visits"),
        E.count_true(~F.coalesce(F.col("visits") >= 0, F.lit(False)) | ((F.col("visits") > 0) & F.col("q").isNull())).alias("__odd"),
    )
    j = join_back(conditions.select("condition", "simulations"), total, ["condition"], "left").withColumn("__visits", F.coalesce("__visits", F.lit(0)))
    key = F.col("condition").cast("string")
    whole = (F.col("__visits") > 0) & F.col("__visits").eqNullSafe(F.col("simulations"))
    bad = j.filter(~whole).select(
        F.lit("policy_mass").alias("rule"), key.alias("key"),
        F.concat_ws(":", F.col("__visits").cast("string"), F.coalesce(F.col("simulations").cast("string"), F.lit("none"))).alias("detail"),
    ).unionByName(
        j.filter(F.col("__odd") > 0).select(F.lit("world_coverage").alias("rule"), key.alias("key"), F.col("__odd").cast("string").alias("detail"))
    )
    if offers is None:
        return bad
    named = offers.groupBy("action").agg(F.count("offer_id").alias("n"))
    short = join_back(cells.select("action").distinct(), named, ["action"], "left").filter(F.coalesce("n", F.lit(0)) != 1)
    shared = offers.filter("offer_id IS NOT NULL").groupBy("offer_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    misfit = lambda rows, what: rows.select(
        F.lit("offer_alignment").alias("rule"), F.concat(F.lit(f"{what} "), F.coalesce(F.col("action" if what == "action" else "offer_id").cast("string"), F.lit("none"))).alias("key"),
        F.coalesce("n", F.lit(0)).cast("string").alias("detail"),
    )
    return bad.unionByName(misfit(short, "action")).unionByName(misfit(shared, "offer"))


def sampled_robustness(cells: DataFrame) -> DataFrame:
    """Older robustness: share of sampled worlds in which the action's value exceeds one half."""
    return cells.groupBy("condition", "action").agg(
        F.avg(F.when(F.col("q") > 0.5, 1.0).otherwise(0.0)).alias("robustness")
    )


def policy_agreement(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-35: agreement on decisions with more than one option; mean of the positive score gaps."""
    d = df.filter(F.col("num_valid") > 1)
    gap = F.col("score_left") - F.col("score_right")
    out = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("decisions"),
        E.count_true(F.col("action_left") == F.col("action_right")).alias("__a"),
        F.coalesce(F.avg(F.when(gap > 0, gap)), F.lit(0.0)).alias("mean_score_gap_when_disagree"),
    )
    return out.withColumn("agreement", E.rate("__a", "decisions")).drop("__a")


def confidence(df: DataFrame, by: Sequence[str] = (), logits: str = "logits") -> DataFrame:
    """A-46: mean, min and max of the largest softmax probability."""
    top = F.array_max(E.softmax(logits))
    return df.select(*by, top.alias("c")).groupBy(*by).agg(
        F.avg("c").alias("mean_confidence"), F.min("c").alias("min_confidence"),
        F.max("c").alias("max_confidence"),
    )


# ------------------------------------------------------------------ transfer, methods, cost


def transfer_outcome(evals: DataFrame, reference_arm: str, others: Sequence[str],
                     split_a: str, split_b: str) -> tuple[DataFrame, DataFrame]:
    """A-37: (means per arm and split, verdict).

    The reference arm must beat every other arm on the mean agreement of both splits.
    Per-seed values stay rows of ``evals``.
    """
    means = evals.groupBy("arm", "split").agg(
        F.avg("exact_agreement").alias("mean_exact_agreement"),
        F.avg("policy_loss").alias("mean_policy_loss"),
        F.min("exact_agreement").alias("min_exact_agreement"),
        F.max("exact_agreement").alias("max_exact_agreement"),
    )

    def m(arm: str, split: str) -> Column:
        return F.max(F.when((F.col("arm") == arm) & (F.col("split") == split), F.col("mean_exact_agreement")))

    wide = means.agg(
        *[m(a, s).alias(f"{a}|{s}") for a in (reference_arm, *others) for s in (split_a, split_b)],
        F.max(F.when((F.col("arm") == reference_arm) & (F.col("split") == split_b),
                     F.col("max_exact_agreement") - F.col("min_exact_agreement"))).alias("spread"),
    )
    ok = F.lit(True)
    for s in (split_a, split_b):
        for a in others:
            ok = ok & (F.col(f"`{reference_arm}|{s}`") > F.col(f"`{a}|{s}`"))
    verdict = wide.select(
        F.coalesce(ok, F.lit(False)).alias("claim_supported"),
        F.when(ok, "semantic_structure_advantage").otherwise("null_or_ambiguous_structure_evidence").alias("verdict"),
        (F.col("spread") != 0).alias("varies_across_seeds"),
    )
    return means, verdict


def method_table(
    candidates: DataFrame, ratings: DataFrame, anchor_scores: DataFrame, head_to_head: DataFrame,
    competency: DataFrame, profile: DataFrame, control: str,
) -> DataFrame:
    """A-38: per arm means of rating, anchor score, head-to-head, correct count and p95, vs control.

    ``head_to_head`` has one row per scored game (arm, score), pooled over candidates.
    """
    per = (
        candidates.join(ratings, "player_id").join(anchor_scores, "player_id")
        .join(competency, "player_id").join(profile, "player_id")
        .groupBy("arm")
        .agg(
            F.avg("rating").alias("mean_rating"),
            F.avg("anchor_score").alias("mean_anchor_score"),
            F.sum("correct").alias("competency_correct"),
            F.avg("p95_seconds").alias("mean_p95_seconds"),
        )
    )
    h2h = head_to_head.groupBy("arm").agg(F.avg("score").alias("head_to_head_score"))
    base = per.agg(F.max(F.when(F.col("arm") == control, F.col("competency_correct"))).alias("__c"))
    out = attach_row(per.join(h2h, "arm", "left"), base)
    delta = F.col("competency_correct") - F.col("__c")
    return out.withColumns(
        {"competency_delta": delta, "competency_noninferior": delta >= 0}
    ).drop("__c")


def efficiency(per_candidate: DataFrame, control: str) -> DataFrame:
    """A-39: uplift of rating and score over the control of the same seed, per node and per CPU second."""
    base = per_candidate.filter(F.col("arm") == control).select(
        "seed", F.col("rating").alias("__r"), F.col("score").alias("__s")
    )
    j = per_candidate.filter(F.col("arm") != control).join(base, "seed")
    r, s = F.col("rating") - F.col("__r"), F.col("score") - F.col("__s")
    return j.select(
        "arm", "seed", r.alias("rating_uplift"), s.alias("score_uplift"),
        E.rate(r, "nodes_per_label", None).alias("rating_uplift_per_node"),
        E.rate(r, "cpu_seconds_per_label", None).alias("rating_uplift_per_cpu_second"),
        E.rate(s, "nodes_per_label", None).alias("score_uplift_per_node"),
        E.rate(s, "cpu_seconds_per_label", None).alias("score_uplift_per_cpu_second"),
    )


def rollout_health(events: DataFrame, keys: Sequence[str], run: str = "run", update: str = "update") -> DataFrame:
    """A-40: per update the number of truthy events of each key, and the cumulative totals."""
    per = events.groupBy(run, update).agg(*[E.count_true(F.col(k)).alias(k) for k in keys])
    return O.running(per, [run], update, {f"{k}_total": k for k in keys})


def policy_evaluation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-42: (metrics per split, accuracy per competency).

    Every row counts for 'priority' with its offer; target and combat rows also count for
    their own competency with the exactness of the selected candidate.
    """
    one = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    splits = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("examples"), F.avg("loss").alias("policy_loss"),
        one("offer_correct").alias("offer_accuracy"),
        one("candidate_exact").alias("candidate_exact_accuracy"),
        one("exact").alias("exact_agreement"),
    )
    names = {"target": "targeting", "combat": "combat"}
    entries = [F.struct(F.lit("priority").alias("c"), F.col("offer_correct").alias("ok"))]
    for kind, name in names.items():
        entries.append(
            F.when(F.col("kind") == kind, F.struct(F.lit(name).alias("c"), F.col("candidate_exact").alias("ok")))
        )
    comp = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy(
        F.col("e.c").alias("competency")
    ).agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg(F.when(F.col("e.ok"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    return splits, comp


def belief_player_cost(rows: DataFrame, series: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A-43: p50/p95 in ms of several latency series, rollouts per second, sample collision rate.

    ``rows`` has one row per sampled world (key ``world_index``) with the latencies of its
    decision on exactly one row and NULL elsewhere.
    """
    # All series in one pass, one row per series and latency.
    entries = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("seconds")) for s in series])
    stacked = rows.select(*by, F.explode(entries).alias("__e")).select(*by, F.col("__e.series").alias("__series"), F.col("__e.seconds").alias("__seconds"))
    each = O.exact_quantiles(stacked, [*by, "__series"], "__seconds", {"p50": 0.5, "p95": 0.95})
    q = each.groupBy(*by).agg(*[
        (F.max(F.when(F.col("__series") == s, F.col(p))) * 1000).alias(f"{p}_{s}_ms") for s in series for p in ("p50", "p95")
    ])
    unique = (
        rows.groupBy(*by, "decision", "world_index").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by).agg(F.sum("n").alias("sampled_worlds"), F.count(F.lit(1)).alias("unique_sampled_worlds"))
    )
    work = rows.groupBy(*by).agg(F.sum("simulations").alias("__sims"), F.sum(series[0]).alias("__sec"))
    out = unique.join(work, list(by)).join(q, list(by), "left")
    return out.withColumns(
        {
            "rollouts_per_second": E.rate("__sims", "__sec", None),
            "sample_collision_rate": F.when(
                F.col("sampled_worlds") > 0, 1.0 - E.rate("unique_sampled_worlds", "sampled_worlds")
            ).otherwise(0.0),
        }
    ).drop("__sims", "__sec")


def dataset_rollup(shards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-44: totals over shard summaries; a game without winner counts as not won by seat 0."""
    winners = F.col("winners")
    out = shards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("num_games").alias("games"),
        F.sum("decisions").alias("decisions"),
        F.sum("wall_seconds").alias("engine_seconds"),
        F.sum(F.aggregate("steps_per_game", F.lit(0.0), lambda a, x: a + x)).alias("__steps"),
        F.sum(F.size("steps_per_game")).alias("__n"),
        F.sum(F.size(F.filter(winners, lambda w: w == 0))).alias("__w0"),
        F.sum(F.size(winners)).alias("__wn"),
        *[F.sum(f"search.{c}").alias(f"search_{c}") for c in ("decisions", "seconds", "simulations", "cap_hits", "max_depth_sum")],
        F.max("search.max_depth_max").alias("search_max_depth_max"),
    )
    return out.withColumns(
        {
            "engine_core_hours": F.col("engine_seconds") / 3600.0,
            "mean_steps_per_game": E.rate("__steps", "__n"),
            "seat0_win_rate": E.rate("__w0", "__wn"),
            "mean_max_depth": F.col("search_max_depth_sum") / F.greatest(F.lit(1.0), E.dbl("decisions")),
        }
    ).drop("__steps", "__n", "__w0", "__wn")


def token_attribution(objects: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-47: tokens of visible objects by zone and by definition name.

    ``objects``: (viewer, zone, definition); ``catalog``: (definition, name, definition_tokens,
    program_tokens) where the token count of an object is the sum of both.
    """
    j = objects.join(catalog, "definition").withColumn(
        "tokens", F.col("definition_tokens") + F.col("program_tokens")
    )
    zone = j.groupBy("viewer", "zone").agg(F.sum("tokens").alias("tokens"))
    name = j.groupBy("viewer", "name").agg(F.sum("tokens").alias("tokens"))
    return zone, name


def family_counts(df: DataFrame, maps: Sequence[str], max_col: str) -> tuple[DataFrame, DataFrame]:
    """A-48: counters of several map columns merged over all rows, and the largest offer count."""
    rows = None
    for m in maps:
        part = df.select(F.lit(m).alias("family_kind"), F.explode(m).alias("family", "n"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("family_kind", "family").agg(F.sum("n").alias("count"))
    return counts, df.agg(F.max(max_col).alias("maximum_offer_count"))


def ledger_totals(events: DataFrame, by: Sequence[str] = ("run", "scope")) -> DataFrame:
    """A-49: summed resources, peaks, attempts and failures."""
    return events.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("wall_seconds", "user_cpu_seconds", "system_cpu_seconds")],
        F.coalesce(F.max("peak_rss_bytes"), F.lit(0)).alias("peak_rss_bytes"),
        F.coalesce(F.max("artifact_bytes_after"), F.lit(0)).alias("artifact_bytes"),
        F.count(F.lit(1)).alias("attempts"),
        E.count_true(F.col("status") == "failed").alias("failed_attempts"),
    )
