"""A-ops: summaries of games, decision logs, probes and scenario runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.joins import attach_row, join_back

# Action kinds of the decision log, in availability order.
ACTION_KINDS = ("land", "spell", "pass", "attack", "block", "target")
# The eight priority choice sets that are always reported.
PRIORITY_CHOICES = (
    "land", "spell", "pass", "land+spell", "land+pass", "spell+pass", "land+spell+pass", "none",
)
# Decision kinds of a game profile.
DECISION_KINDS = ("priority", "declare_attacker", "declare_blocker", "choose_target")


def matchup_summary(games: DataFrame, by: Sequence[str] = ("matchup",)) -> DataFrame:
    """A-01: games, wins, Wilson interval, mean steps and draws, overall and per seat."""
    aggs = [
        F.count(F.lit(1)).alias("num_games"),
        E.count_true(F.col("hero_won")).alias("wins"),
        F.coalesce(F.avg(E.dbl("steps")), F.lit(0.0)).alias("mean_steps"),
        E.count_true(F.col("winner").isNull()).alias("draws_or_caps"),
    ]
    for seat, label in ((0, "play"), (1, "draw")):
        at = F.col("hero_seat") == seat
        aggs += [
            E.count_true(at).alias(f"games_on_{label}"),
            E.count_true(at & F.col("hero_won")).alias(f"wins_on_{label}"),
        ]
    out = games.groupBy(*by).agg(*aggs)
    lo, hi = E.wilson("wins", "num_games")
    out = out.withColumns(
        {"win_rate": E.rate("wins", "num_games"), "win_ci_lower": lo, "win_ci_upper": hi}
    )
    for label in ("play", "draw"):
        w, g = f"wins_on_{label}", f"games_on_{label}"
        lo, hi = E.wilson(w, g)
        out = out.withColumns(
            {
                f"win_rate_on_{label}": E.rate(w, g),
                f"win_ci_lower_on_{label}": lo,
                f"win_ci_upper_on_{label}": hi,
            }
        )
    return out


def seat_advantage(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-02: how often seat 0 wins among decided games, whoever sits there."""
    out = games.groupBy(*by).agg(
        E.count_true(F.col("winner") == 0).alias("seat0_wins"),
        F.count("winner").alias("decided_games"),
    )
    lo, hi = E.wilson("seat0_wins", "decided_games")
    return out.withColumns(
        {"seat0_win_rate": E.rate("seat0_wins", "decided_games"), "ci_lower": lo, "ci_upper": hi}
    )


def stack_columns(df: DataFrame, by: Sequence[str], cols: Mapping[str, Column | str]) -> DataFrame:
    """Wide columns to (by..., metric, value) rows."""
    pairs = [
        F.struct(F.lit(n).alias("metric"), E.dbl(c).alias("value")) for n, c in cols.items()
    ]
    return df.select(*by, F.explode(F.array(*pairs)).alias("m")).select(*by, "m.metric", "m.value")


def distribution(
    df: DataFrame,
    cols: Mapping[str, Column | str],
    by: Sequence[str] = (),
    probs: Mapping[str, float] | None = None,
    kind: str = "linear",
    full: bool = True,
) -> DataFrame:
    """A-03: one row per (by, metric) with count, mean, interval, min, max and exact quantiles.

    A group without finite values does not appear; ``fill_distribution`` adds the zero rows.
    """
    probs = {"median": 0.5, "p95": 0.95} if probs is None else probs
    keys = [*by, "metric"]
    # One wide aggregation, turned into rows afterwards; only the quantiles need long rows.
    wide = df.groupBy(*by).agg(
        *[
            F.struct(
                F.count(E.dbl(c)).alias("count"), F.avg(E.dbl(c)).alias("mean"), F.stddev_samp(E.dbl(c)).alias("__sd"),
                F.min(E.dbl(c)).alias("min"), F.max(E.dbl(c)).alias("max"),
            ).alias(f"__{n}")
            for n, c in cols.items()
        ]
    )
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"__{n}").alias("s")) for n in cols])
    stats = wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.metric", "e.s.*")
    if full:
        lo, hi = E.mean_ci(F.col("mean"), F.col("__sd"), F.col("count"))
        stats = stats.withColumns({"ci95_lower": lo, "ci95_upper": hi})
    stats = stats.drop("__sd")
    quantiles = O.exact_quantiles(stack_columns(df, by, cols), keys, "value", probs, kind)
    return join_back(stats, quantiles, keys, "left")


def fill_distribution(dist: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    return dist.fillna(0.0, subset=list(value_cols))


def collapse_ratio(skipped: Column | str, surfaced: Column | str) -> Column:
    """A-05: skipped share of all decisions, 0 for a game without decisions."""
    s, t = E.col(skipped), E.col(surfaced)
    return E.rate(s, s + t)


def decision_profile(
    games: DataFrame, kinds: Sequence[str] = DECISION_KINDS, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """A-04: (distributions per metric, win and seat summary) over games that were not aborted.

    ``hero_decisions`` and ``villain_decisions`` are maps kind -> count; a kind that is
    missing from the map counts as zero.
    """
    clean = games.filter(~F.coalesce("aborted", F.lit(False)))

    def of(role: str, kind: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(f"{role}_decisions"), F.lit(kind)), F.lit(0))

    def total(role: str) -> Column:
        return F.aggregate(
            F.map_values(f"{role}_decisions"), F.lit(0).cast("bigint"), lambda a, x: a + x
        )

    surfaced = total("hero") + total("villain")
    cols: dict[str, Column] = {
        "surfaced_total": surfaced,
        "surfaced_hero": total("hero"),
        "surfaced_villain": total("villain"),
        "skipped": F.col("skipped"),
        "collapse_ratio": collapse_ratio(F.col("skipped"), surfaced),
        "turns": F.col("turns"),
    }
    for kind in kinds:
        cols[f"hero_{kind}"] = of("hero", kind)
        cols[f"villain_{kind}"] = of("villain", kind)
    dist = distribution(clean, cols, by)
    won = F.col("winner") == F.col("hero_seat")
    ok = ~F.coalesce("aborted", F.lit(False))
    aggs = [
        F.count(F.lit(1)).alias("num_games"),
        E.count_true(~ok).alias("num_aborted"),
        E.count_true(ok).alias("clean_games"),
        E.count_true(ok & won).alias("hero_wins"),
        E.count_true(ok & F.col("winner").isNotNull()).alias("decided_games"),
        E.count_true(ok & (F.col("winner") == 0)).alias("seat0_wins"),
        F.coalesce(F.sum(F.when(ok, F.col("single_valid"))), F.lit(0)).alias("single_valid_total"),
    ]
    for seat in (0, 1):
        at = ok & (F.col("hero_seat") == seat)
        aggs += [
            E.count_true(at).alias(f"games_seat{seat}"),
            E.count_true(at & won).alias(f"wins_seat{seat}"),
        ]
    summary = games.groupBy(*by).agg(*aggs)
    for name, w, n in (
        ("hero", "hero_wins", "clean_games"),
        ("seat0_player", "seat0_wins", "decided_games"),
        ("hero_seat0", "wins_seat0", "games_seat0"),
        ("hero_seat1", "wins_seat1", "games_seat1"),
    ):
        lo, hi = E.wilson(w, n)
        summary = summary.withColumns(
            {f"{name}_win_rate": E.rate(w, n), f"{name}_ci_lower": lo, f"{name}_ci_upper": hi}
        )
    return dist, summary


def choice_set(kinds: Sequence[str] = ACTION_KINDS) -> Column:
    """P-06: available kinds joined by '+', in fixed order, or 'none'."""
    text = F.concat_ws("+", *[F.when(F.col(f"{k}_available"), F.lit(k)) for k in kinds])
    return F.when(text == "", F.lit("none")).otherwise(text)


def evaluation_metrics(actions: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """A-06 (decision part): took/could rates, pass-land contingency, conditional probabilities.

    One pass and one shuffle whatever the number of metrics; everything is partially
    aggregated before the exchange.
    """
    kind = F.col("action_type")
    can = {k: F.coalesce(F.col(f"{k}_available"), F.lit(False)) for k in ("attack", "land", "spell", "pass")}
    has_probs = F.col("pass_prob").isNotNull()
    both = can["pass"] & can["land"]
    priority = choice_set(("land", "spell", "pass"))

    def mean_when(cond: Column, c: str) -> Column:
        return F.coalesce(F.avg(F.when(cond & has_probs, F.col(c))), F.lit(0.0))

    aggs = [F.count(F.lit(1)).alias("decisions")]
    for k in can:
        aggs.append(E.count_true(kind == k).alias(f"{k}_count"))
        aggs.append(E.count_true(can[k]).alias(f"could_{k}"))
    aggs += [
        E.count_true(F.col("num_valid_actions") <= 1).alias("single_valid_decisions"),
        E.count_true(F.col("num_valid_actions") > 1).alias("multi_valid_decisions"),
        E.count_true(both).alias("pass_land_decisions"),
    ]
    for k in ("pass", "land", "spell"):
        aggs.append(E.count_true(both & (kind == k)).alias(f"pass_land_{k}"))
    for k in can:
        aggs.append(mean_when(F.lit(True), f"{k}_prob").alias(f"mean_{k}_prob"))
    for k in ("pass", "land"):
        aggs.append(mean_when(can["land"], f"{k}_prob").alias(f"mean_{k}_prob_when_land_available"))
        aggs.append(mean_when(both, f"{k}_prob").alias(f"mean_{k}_prob_when_pass_land"))
    for name in PRIORITY_CHOICES:
        aggs.append(
            E.count_true(priority == name).alias("priority_choice_" + name.replace("+", "_"))
        )
    for name in ("action_space", "card_space", "permanent_space"):
        c = f"{name}_truncated"
        if c in actions.columns:
            aggs.append(E.count_true(F.col(c)).alias(f"{name}_truncations"))
    out = actions.groupBy(*by).agg(*aggs)
    return out.withColumns(
        {
            "attack_rate": E.rate("attack_count", "decisions"),
            "passed_when_able": E.rate("pass_count", "could_pass"),
            "attacked_when_able": E.rate("attack_count", "could_attack"),
            "landed_when_able": E.rate("land_count", "could_land"),
            "cast_when_able": E.rate("spell_count", "could_spell"),
            "pass_land_pass_rate": E.rate("pass_land_pass", "pass_land_decisions"),
            "pass_land_land_rate": E.rate("pass_land_land", "pass_land_decisions"),
            "pass_land_spell_rate": E.rate("pass_land_spell", "pass_land_decisions"),
        }
    )


def evaluation_games(games: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """A-06 (game part): wins, one-sided Wilson bound, seat split and mean steps."""
    aggs = [
        F.count(F.lit(1)).alias("num_games"),
        E.count_true(F.col("hero_won")).alias("wins"),
        F.avg(E.dbl("steps")).alias("mean_steps"),
    ]
    for seat, label in ((0, "play"), (1, "draw")):
        at = F.col("hero_seat") == seat
        aggs.append(E.count_true(at).alias(f"games_on_{label}"))
        aggs.append(E.count_true(at & F.col("hero_won")).alias(f"wins_on_{label}"))
    out = games.groupBy(*by).agg(*aggs)
    lower, _ = E.wilson("wins", "num_games")
    return out.withColumns(
        {
            "win_rate": E.rate("wins", "num_games"),
            "win_ci_lower": lower,
            "win_rate_on_play": E.rate("wins_on_play", "games_on_play"),
            "win_rate_on_draw": E.rate("wins_on_draw", "games_on_draw"),
        }
    )


def choice_set_counts(actions: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """A-07: histogram of choice sets in the scopes 'all' and 'priority'."""
    scopes = F.array(
        F.struct(F.lit("all").alias("scope"), choice_set().alias("choice_set")),
        F.struct(
            F.lit("priority").alias("scope"), choice_set(("land", "spell", "pass")).alias("choice_set")
        ),
    )
    return (
        actions.select(*by, F.explode(scopes).alias("s"))
        .groupBy(*by, "s.scope", "s.choice_set")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def simulation_summary(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-08: outcome counts and rates, mean steps and duration, mean steps of hero wins."""
    hero = F.col("winner") == F.col("hero_seat")
    out = games.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_games"),
        E.count_true(hero).alias("hero_wins"),
        E.count_true(F.col("winner") != F.col("hero_seat")).alias("villain_wins"),
        E.count_true(F.col("winner").isNull()).alias("timeouts"),
        F.avg(E.dbl("steps")).alias("avg_steps"),
        F.avg("duration").alias("avg_duration"),
        F.coalesce(F.avg(F.when(hero, E.dbl("steps"))), F.lit(0.0)).alias("avg_steps_to_win"),
    )
    return out.withColumns(
        {
            "hero_win_rate": E.rate("hero_wins", "total_games"),
            "villain_win_rate": E.rate("villain_wins", "total_games"),
        }
    )


def _outcome() -> Column:
    return (
        F.when(F.col("winner").isNull(), F.lit("timeout"))
        .when(F.col("winner") == F.col("hero_seat"), F.lit("hero_win"))
        .otherwise(F.lit("villain_win"))
    )


def turn_analysis(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-09 (distribution part): min, max, quartiles and count of steps, overall and by outcome."""
    tagged = games.select(
        *by,
        E.dbl("steps").alias("steps"),
        F.explode(F.array(F.lit("all"), _outcome())).alias("outcome"),
    )
    keys = [*by, "outcome"]
    stats = tagged.groupBy(*keys).agg(
        F.count("steps").alias("count"), F.min("steps").alias("min"), F.max("steps").alias("max")
    )
    q = O.exact_quantiles(tagged, keys, "steps", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_back(stats, q, keys, "left")


def win_rate_by_band(
    games: DataFrame,
    by: Sequence[str] = (),
    bands: Sequence[tuple[str, int, int | None]] = (("early", 0, 10), ("mid", 11, 25), ("late", 26, None)),
) -> DataFrame:
    """A-09 (band part): hero win rate among games whose steps fall in a band; empty band 0."""
    hero = F.col("winner") == F.col("hero_seat")
    rows = []
    for name, low, high in bands:
        inside = F.col("steps") >= low
        if high is not None:
            inside = inside & (F.col("steps") <= high)
        rows.append((name, inside))
    aggs = []
    for name, inside in rows:
        aggs.append(E.count_true(inside).alias(f"{name}_games"))
        aggs.append(E.count_true(inside & hero).alias(f"{name}_wins"))
    out = games.groupBy(*by).agg(*aggs)
    for name, _ in rows:
        out = out.withColumn(f"{name}_win_rate", E.rate(f"{name}_wins", f"{name}_games"))
    return out


def histogram(df: DataFrame, value: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between minimum and maximum, last bin closed, empty bins listed."""
    span = df.groupBy(*by).agg(F.min(E.dbl(value)).alias("lo"), F.max(E.dbl(value)).alias("hi"))
    # A constant column gets a unit range around its value.
    flat = F.col("hi") == F.col("lo")
    span = span.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    joined = join_back(df, span, by) if by else attach_row(df, span)
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.least(F.floor((E.dbl(value) - F.col("lo")) / width), F.lit(bins - 1))
    counts = joined.groupBy(*by, bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        join_back(spine, counts, [*by, "bin"], "left")
        .withColumn("bin_lower", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .drop("lo", "hi")
    )


def behaviour_summary(kv: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-10: per key the mean if every value is numeric, otherwise the most common value.

    ``kv`` has key, value (string) and ordinal; equal counts go to the value seen first.
    """
    keys = [*by, "key"]
    num = F.expr("try_cast(value AS double)")
    per_value = kv.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_seen"),
        F.max(num).alias("num"),
    )
    total = F.sum(F.col("n"))
    return per_value.groupBy(*keys).agg(
        F.when(
            F.bool_and(F.col("num").isNotNull()), F.sum(F.col("num") * F.col("n")) / total
        ).alias("mean"),
        F.when(
            ~F.bool_and(F.col("num").isNotNull()),
            F.max_by("value", F.struct(F.col("n"), -F.col("first_seen"))),
        ).alias("mode"),
    )


def span_summary(spans: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """A-11: per span the mean total and mean count per run, and the time per call."""
    out = spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total").alias("__t"), F.sum("count").alias("__c")
    )
    return out.select(
        *by,
        (F.col("__t") / F.col("runs")).alias("avg_total_time"),
        (F.col("__c") / F.col("runs")).alias("avg_call_count"),
        E.rate("__t", "__c").alias("avg_time_per_call"),
    )


def scenario_aggregate(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """A-12 (rate part): correct rate with Wilson interval."""
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), E.count_true(F.col("correct")).alias("correct")
    )
    lo, hi = E.wilson("correct", "runs")
    return out.withColumns({"correct_rate": E.rate("correct", "runs"), "ci_lower": lo, "ci_upper": hi})


def scenario_details(runs: DataFrame, by: Sequence[str], detail: str = "detail") -> DataFrame:
    """A-12 (detail part): a map<string,string> column aggregated by the type of its values.

    Booleans give the number of trues, numbers the mean of the non-NULL ones, anything
    else one row per label. A key is boolean (numeric) only if all its values are.
    """
    kv = runs.select(*by, F.explode(detail).alias("key", "value"))
    per = (
        kv.groupBy(*by, "key", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "is_bool": F.col("value").isNull() | F.col("value").isin("true", "false"),
                "num": F.expr("try_cast(value AS double)"),
            }
        )
    )
    kinds = per.groupBy(*by, "key").agg(
        F.bool_and("is_bool").alias("all_bool"),
        F.bool_and(F.col("num").isNotNull() | F.col("value").isNull()).alias("all_num"),
        F.sum(F.when(F.col("value") == "true", F.col("n")).otherwise(0)).alias("trues"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"),
    )
    scalar = kinds.filter(F.col("all_bool") | F.col("all_num")).select(
        *by, "key", F.lit(None).cast("string").alias("label"),
        F.when(F.col("all_bool"), E.dbl("trues")).otherwise(F.col("mean")).alias("result"),
    )
    other = kinds.filter(~(F.col("all_bool") | F.col("all_num"))).select(*by, "key")
    labels = per.join(other, [*by, "key"], "left_semi").select(
        *by, "key", F.coalesce("value", F.lit("None")).alias("label"), E.dbl("n").alias("result")
    )
    return scalar.unionByName(labels)


PROBE_COUNTERS = (
    "counter_windows", "counter_casts", "counter_casts_first_window", "bolt_casts", "bolt_biggest",
    "bolt_face", "bolt_own", "bolt_multi_choice", "hold_windows", "hold_breaks",
)


def behaviour_cell(records: DataFrame, probes: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """A-13: win summary of a cell joined with its summed probe counters; empty rates are NULL."""
    aggs = [
        F.count(F.lit(1)).alias("games"),
        E.count_true(F.col("hero_won")).alias("wins"),
        F.coalesce(F.avg(E.dbl("turns")), F.lit(0.0)).alias("mean_turns"),
        E.count_true(F.col("winner").isNull()).alias("draws_or_caps"),
    ]
    for seat, label in ((0, "play"), (1, "draw")):
        at = F.col("hero_seat") == seat
        aggs.append(
            E.rate(E.count_true(at & F.col("hero_won")), E.count_true(at), None).alias(
                f"win_rate_on_{label}"
            )
        )
    head = records.groupBy(*by).agg(*aggs)
    lo, hi = E.wilson("wins", "games")
    head = head.withColumns({"win_rate": E.rate("wins", "games"), "ci_lower": lo, "ci_upper": hi})
    mv = F.col("countered_mana_values")
    probe = probes.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in PROBE_COUNTERS],
        F.sum(F.aggregate(mv, F.lit(0.0), lambda a, x: a + x)).alias("__mv_sum"),
        F.sum(F.size(mv)).alias("__mv_n"),
        F.sum(F.size(F.filter(mv, lambda x: x <= 2))).alias("__mv_low"),
    )
    probe = probe.select(
        *by, *PROBE_COUNTERS,
        E.rate("counter_casts", "counter_windows", None).alias("counter_cast_rate_per_window"),
        E.rate("counter_casts_first_window", "counter_casts", None).alias("counter_first_window_rate"),
        E.rate("__mv_sum", "__mv_n", None).alias("countered_mv_mean"),
        E.rate("__mv_low", "__mv_n", None).alias("countered_mv_le2_share"),
        E.rate("bolt_biggest", "bolt_multi_choice", None).alias("bolt_biggest_rate_multi"),
        E.rate("bolt_face", "bolt_casts", None).alias("bolt_face_share"),
        E.rate("bolt_own", "bolt_casts", None).alias("bolt_own_share"),
        (1.0 - E.rate("hold_breaks", "hold_windows", None)).alias("instant_holding_rate"),
    )
    return head.join(probe, list(by), "left")


def merged_counts(df: DataFrame, map_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Map counters merged by key (part of A-13, A-27 and A-48)."""
    return (
        df.select(*by, F.explode(map_col).alias("name", "n"))
        .groupBy(*by, "name")
        .agg(F.sum("n").alias("count"))
    )


def behaviour_probe(
    decisions: DataFrame, game: str = "game", seq: str = "ordinal"
) -> DataFrame:
    """A-14: counter-spell, bolt and hold statistics per game from the decision log.

    Columns: kind (priority/target/...), counter_available, cast (name or NULL),
    stack_size, stack_name, stack_value (the single stack card), hold_risk, cast_creature,
    and for target decisions target_side ('face','enemy','own' or NULL), enemy_creatures,
    target_power, max_enemy_power, target_name, target_value (stack card chosen).
    A cast is paired with the game's directly following decision if that is a target choice.
    """
    prev = O.neighbour(
        decisions, [game], seq,
        {"p_cast": "cast", "p_kind": "kind", "p_counter": "counter_available", "p_stack": "stack_size"},
    )
    # First counter window of each game: a partial minimum, not an ordered window.
    first = (
        decisions.filter((F.col("kind") == "priority") & F.col("counter_available"))
        .groupBy(game)
        .agg(F.min(seq).alias("__first"))
    )
    d = prev.join(first, game, "left")
    priority = F.col("kind") == "priority"
    target = F.col("kind") == "target"
    window = priority & F.coalesce("counter_available", F.lit(False))
    counter = window & (F.col("cast") == "counter")
    bolt = priority & (F.col("cast") == "bolt")
    after_bolt = target & (F.col("p_kind") == "priority") & (F.col("p_cast") == "bolt")
    after_counter = (
        target & (F.col("p_kind") == "priority") & (F.col("p_cast") == "counter")
        & F.coalesce("p_counter", F.lit(False)) & (F.col("p_stack") != 1)
    )
    multi = F.col("enemy_creatures") >= 2
    direct = counter & (F.col("stack_size") == 1)
    name = F.when(direct, F.col("stack_name")).when(after_counter, F.col("target_name"))
    value = F.when(direct, F.col("stack_value")).when(after_counter, F.col("target_value"))
    hold = priority & F.coalesce("hold_risk", F.lit(False))
    return d.groupBy(game).agg(
        E.count_true(window).alias("counter_windows"),
        E.count_true(counter).alias("counter_casts"),
        E.count_true(counter & (F.col(seq) == F.col("__first"))).alias("counter_casts_first_window"),
        F.count(name).alias("countered"),
        F.sum(value).alias("countered_value"),
        E.count_true(value <= 2).alias("countered_value_le2"),
        E.count_true(bolt).alias("bolt_casts"),
        E.count_true(after_bolt & multi).alias("bolt_multi_choice"),
        E.count_true(
            after_bolt & multi & (F.col("target_side") == "enemy")
            & (F.col("target_power") >= F.col("max_enemy_power"))
        ).alias("bolt_biggest"),
        E.count_true(after_bolt & (F.col("target_side") == "face")).alias("bolt_face"),
        E.count_true(after_bolt & (F.col("target_side") == "own")).alias("bolt_own"),
        E.count_true(hold).alias("hold_windows"),
        E.count_true(hold & F.coalesce("cast_creature", F.lit(False))).alias("hold_breaks"),
    )


def took_rates(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-36: took and available counts for land, spell and attack."""
    aggs = []
    for k in ("land", "spell", "attack"):
        can = F.coalesce(F.col(f"{k}_available"), F.lit(False))
        aggs.append(E.count_true(can).alias(f"{k}_available_count"))
        aggs.append(E.count_true(can & (F.col("action_type") == k)).alias(f"{k}_took_count"))
    return actions.groupBy(*by).agg(*aggs)


def sanity(games: DataFrame, by: str = "matchup") -> DataFrame:
    """A-41: per matchup and in total: games, hero wins, rate, aborts and truncations."""
    tagged = games.withColumn("scope", F.explode(F.array(F.col(by), F.lit("TOTAL"))))
    out = tagged.groupBy("scope").agg(
        F.count(F.lit(1)).alias("games"),
        E.count_true(F.col("hero_won")).alias("hero_wins"),
        E.count_true(F.col("aborted")).alias("aborts"),
        E.count_true(F.col("truncated")).alias("truncations"),
    )
    lo, hi = E.wilson("hero_wins", "games")
    return out.withColumns({"win_rate": E.rate("hero_wins", "games"), "ci_lower": lo, "ci_upper": hi})
