"""G-ops: gate tables, recommendations, admission and budget decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.operators.ratings import cross_seed
from scoreloom.operators.sequences import run_phases
from scoreloom.sources.io import REPORT_METRICS


@dataclass(frozen=True)
class Rule:
    """A clause compares a value with a bound; ``group`` collects clauses for a verdict."""

    clause: str
    op: str
    bound: float
    group: str = "all"


def _passes(actual: Column, op: Column, bound: Column) -> Column:
    table = {
        ">=": actual >= bound, ">": actual > bound, "<=": actual <= bound, "<": actual < bound,
        "==": actual == bound, "!=": actual != bound,
    }
    out = None
    for name, cond in table.items():
        out = F.when(op == name, cond) if out is None else out.when(op == name, cond)
    return F.coalesce(out, F.lit(False))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.group, r.clause, r.op, float(r.bound)) for r in rules], "group string, clause string, op string, bound double"
    )


def gates(values: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """G-01: (by..., group, clause, actual, op, bound, passed); a missing value fails its clause.

    ``values``: by..., clause, actual. Every declared clause appears for every group of ``by``.
    """
    table = rule_table(values.sparkSession, rules)
    if not by:
        return table.join(values, "clause", "left").withColumn("passed", _passes(F.col("actual"), F.col("op"), F.col("bound")))
    every = F.array(*[F.struct(F.lit(r.group).alias("group"), F.lit(r.clause).alias("clause"), F.lit(r.op).alias("op"), F.lit(float(r.bound)).alias("bound")) for r in rules])
    want = values.select(*by).distinct().select(*by, F.explode(every).alias("r")).select(*by, "r.*")
    return want.join(values, [*by, "clause"], "left").withColumn("passed", _passes(F.col("actual"), F.col("op"), F.col("bound")))


def verdict(gate_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All clauses of a gate table folded to one decision and the number of failures."""
    return gate_rows.groupBy(*by).agg(
        E.all_true(F.col("passed")).alias("passed"), E.count_true(~F.col("passed")).alias("failed_clauses"), F.count(F.lit(1)).alias("clauses")
    )


def stack_values(wide: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide aggregates to the (by..., clause, actual) form of ``gates``; booleans count as 1/0."""
    types = dict(wide.dtypes)
    value = lambda c: F.when(F.col(c), 1.0).otherwise(0.0) if types[c] == "boolean" else E.dbl(c)
    rows = F.array(*[F.struct(F.lit(c).alias("clause"), value(c).alias("actual")) for c in columns])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.clause", "r.actual")


def baseline_final(evals: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per run the baseline and final rows side by side as ``b_`` and ``f_`` columns."""
    phases = run_phases(evals).select("run_id", "baseline_id", "final_id")
    b = evals.select("run_id", F.col("id").alias("baseline_id"), *[E.dbl(m).alias(f"b_{m}") for m in metrics])
    f = evals.select("run_id", F.col("id").alias("final_id"), *[E.dbl(m).alias(f"f_{m}") for m in metrics])
    return phases.join(b, ["run_id", "baseline_id"], "left").join(f, ["run_id", "final_id"], "left")


def run_deltas(evals: DataFrame, metrics: Sequence[str] = tuple(REPORT_METRICS)) -> DataFrame:
    """G-03: final minus baseline for every metric, as rows; runs lacking either side have none."""
    wide = baseline_final(evals, metrics)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"f_{m}") - F.col(f"b_{m}")).alias("delta")) for m in metrics])
    return wide.filter(F.col("baseline_id").isNotNull() & F.col("final_id").isNotNull()).select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*")


# Thresholds of the recommendation heuristics.
WIN_GAIN, WIN_SLACK, LAND_FLOOR, LAND_SLACK, CAST_FLOOR = 0.05, 0.02, 0.35, 0.05, 0.70
# The recommendation texts.
RECOMMENDATIONS = {
    "none": "Stay in first-light: no final evaluation was recorded",
    "advance": "Move on to auxiliary-head experiments",
    "win": "Stay in first-light: random-opponent win signal is too weak",
    "land": "Stay in first-light: pass-collapse still dominates land decisions",
    "spell": "Stay in first-light: creature-play signal remains weak",
}


def recommend(evals: DataFrame) -> DataFrame:
    """G-02: next step per run from three heuristics; a run without baseline compares with zero."""
    metrics = [
        "win_rate", "win_ci_lower", "landed_when_able", "pass_land_land_rate", "pass_land_pass_rate",
        "mean_land_prob_when_pass_land", "mean_pass_prob_when_pass_land", "cast_when_able",
    ]
    d = baseline_final(evals, metrics)
    b_win, b_land = F.coalesce("b_win_rate", F.lit(0.0)), F.coalesce("b_landed_when_able", F.lit(0.0))
    win = (F.col("f_win_rate") - b_win >= WIN_GAIN) & (F.col("f_win_ci_lower") >= F.greatest(F.lit(0.0), b_win - WIN_SLACK))
    land = (
        (F.col("f_landed_when_able") >= F.greatest(F.lit(LAND_FLOOR), b_land - LAND_SLACK))
        & (F.col("f_pass_land_land_rate") > F.col("f_pass_land_pass_rate"))
        & (F.col("f_mean_land_prob_when_pass_land") > F.col("f_mean_pass_prob_when_pass_land"))
    )
    spell = F.col("f_cast_when_able") >= CAST_FLOOR
    ok = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumns({"win_signal_ok": ok(win), "land_chain_ok": ok(land), "spell_chain_ok": ok(spell)})
    text = (
        F.when(F.col("final_id").isNull(), RECOMMENDATIONS["none"])
        .when(F.col("win_signal_ok") & F.col("land_chain_ok") & F.col("spell_chain_ok"), RECOMMENDATIONS["advance"])
        .when(~F.col("win_signal_ok"), RECOMMENDATIONS["win"]).when(~F.col("land_chain_ok"), RECOMMENDATIONS["land"])
        .otherwise(RECOMMENDATIONS["spell"])
    )
    return d.select("run_id", text.alias("recommendation"), "win_signal_ok", "land_chain_ok", "spell_chain_ok")


def integrity(matches: DataFrame, profile: DataFrame, caps_passed: bool, cap_rate_max: float = 0.001) -> DataFrame:
    """G-04 (integrity part): one row with match, profile and resource checks."""
    clean = F.coalesce("replay_passed", F.lit(False)) & ~F.exists(F.map_values("integrity"), lambda x: x != 0)
    m = matches.agg(E.all_true(clean).alias("match_rows_passed"))
    p = profile.agg(
        E.all_true((F.col("root_mutations") == 0) & (F.col("illegal_actions") == 0) & (F.col("playout_cap_rate") <= cap_rate_max)).alias("profile_rows_passed")
    )
    from scoreloom.functions.joins import attach_row

    return attach_row(m, p).withColumn("resource_caps_passed", F.lit(caps_passed)).withColumn(
        "passed", F.col("match_rows_passed") & F.col("profile_rows_passed") & F.col("resource_caps_passed")
    )


def promotion_disposition(integrity_row: DataFrame, smoke: bool, candidate: str | None) -> DataFrame:
    """G-04: integrity first, then smoke, then anchor freeze, then missing incumbent."""
    last = ("rated_not_promotion_eligible", "incumbent_not_in_cohort")
    if candidate is None:
        last = ("rated_not_promotion_eligible", "anchor_freeze")
    if smoke:
        last = ("engineering_smoke_non_promotion", "fixture_or_smoke_profile")
    ok = F.col("passed")
    return integrity_row.select(
        "passed", F.when(ok, last[0]).otherwise("invalid_integrity").alias("disposition"),
        F.when(ok, last[1]).otherwise("zero_tolerance_gate").alias("reason"), F.lit(candidate).alias("candidate"),
    )


# Diagnostic clauses of a candidate arm against its rival and the uniform arm.
DIAGNOSTIC_RULES = (
    Rule("arena_delta", ">=", 0.05), Rule("arena_separation", ">=", 0.05), Rule("high_budget_label_agreement_improvement", ">=", 0.05),
    Rule("competency_noninferiority", ">=", 0.0), Rule("p95_latency_ratio", "<=", 1.10), Rule("nodes_per_second_ratio", ">=", 0.90),
)


def diagnostic_disposition(arms: DataFrame, integrity_row: DataFrame, base_arm: str = "uniform", pair: tuple[str, str] = ("chosen", "visit")) -> tuple[DataFrame, DataFrame]:
    """G-04 (diagnostic form): (clauses per arm, decision). Exactly one clearing arm decides.

    ``arms``: arm, score (mean paired anchor score), label_agreement, competency, p95_seconds, nodes_per_second.
    """
    from scoreloom.functions.joins import attach_row

    cols = ("score", "label_agreement", "competency", "p95_seconds", "nodes_per_second")
    base = arms.agg(*[F.max(F.when(F.col("arm") == base_arm, E.dbl(c))).alias(f"u_{c}") for c in cols])
    both = arms.agg(*[F.max(F.when(F.col("arm") == a, E.dbl(c))).alias(f"{a}_{c}") for a in pair for c in ("score", "competency")])
    j = attach_row(attach_row(arms.filter(F.col("arm").isin(*pair)), base), both)
    other = lambda c: F.when(F.col("arm") == pair[0], F.col(f"{pair[1]}_{c}")).otherwise(F.col(f"{pair[0]}_{c}"))
    wide = j.select(
        "arm", (F.col("score") - F.col("u_score")).alias("arena_delta"), (F.col("score") - other("score")).alias("arena_separation"),
        (F.col("label_agreement") - F.col("u_label_agreement")).alias("high_budget_label_agreement_improvement"),
        (F.col("competency") - other("competency")).alias("competency_noninferiority"),
        (F.col("p95_seconds") / F.col("u_p95_seconds")).alias("p95_latency_ratio"),
        (F.col("nodes_per_second") / F.col("u_nodes_per_second")).alias("nodes_per_second_ratio"),
    )
    rows = gates(stack_values(wide, ["arm"], [r.clause for r in DIAGNOSTIC_RULES]), DIAGNOSTIC_RULES, ["arm"])
    arm_ok = verdict(rows, ["arm"]).filter("passed")
    cleared = arm_ok.agg(F.count(F.lit(1)).alias("clearing"), F.max("arm").alias("arm"))
    one = F.col("clearing") == 1
    decision = attach_row(cleared, integrity_row.select(F.col("passed").alias("__i"))).select(
        "clearing",
        F.when(~F.col("__i"), F.lit(None)).when(one, F.concat(F.lit("next_corpus_"), F.col("arm"))).otherwise("kill_retained_smoke_policy_guidance").alias("decision"),
        F.when(~F.col("__i"), "zero_tolerance_or_resource_cap_gate").when(one, "exactly_one_signal_cleared").otherwise("zero_or_two_signals_cleared").alias("reason"),
    )
    return rows, decision


def nonregression(rates: DataFrame, key: Sequence[str], candidate: str, baseline: str, tolerance: float, player: str = "player_id") -> DataFrame:
    """G-06: candidate at least baseline minus tolerance per key; a missing rate fails."""
    side = lambda p, n: F.max(F.when(F.col(player) == p, F.col("correct_rate"))).alias(n)
    g = rates.groupBy(*key).agg(side(candidate, "candidate"), side(baseline, "baseline"))
    return g.withColumn("passed", F.coalesce(F.col("candidate") >= F.col("baseline") - tolerance, F.lit(False)))


def admission(
    strength: DataFrame, competency: DataFrame, median_rate: float, per_seed_rate: float, winning_seeds: int
) -> DataFrame:
    """G-05: admit the search student, else the student, else report failure.

    ``strength``: series (search, policy_only, policy_value), seed, rate; ``competency``:
    subject (search, student), passed (one row per seed and scenario).
    """
    from scoreloom.functions.joins import attach_row

    s = cross_seed(strength, "rate", ["series"], median_rate, per_seed_rate, winning_seeds)
    has = lambda n: F.coalesce(F.max(F.when(F.col("series") == n, F.col("passed"))), F.lit(False))
    a = s.agg(has("search").alias("search_strength"), (has("policy_only") & has("policy_value")).alias("student_strength"))
    fit = lambda n: E.all_true(F.col("passed") | (F.col("subject") != n))
    b = competency.agg(fit("search").alias("search_competency"), fit("student").alias("student_competency"))
    d = attach_row(a, b)
    search = F.col("search_strength") & F.col("search_competency")
    student = F.col("student_strength") & F.col("student_competency")
    return d.withColumns(
        {
            "decision": F.when(search, "admit_student_search").when(student, "admit_student").otherwise("prototype_failure"),
            "disposition": F.when(search | student, "continue").otherwise("revise"),
        }
    )


def select_variant(cells: DataFrame, full: str, undo: str, page: str, flat: Sequence[str], single: str, saturated: str) -> DataFrame:
    """G-07: driver selection from ratios to the full-clone driver.

    ``cells``: driver, cell_id, simulations_per_second, root_latency_seconds_p99, rss_peak_bytes, rss_peak_delta_bytes.
    """
    metrics = ("simulations_per_second", "root_latency_seconds_p99", "rss_peak_bytes", "rss_peak_delta_bytes")
    wide = cells.groupBy("cell_id").agg(
        *[F.max(F.when(F.col("driver") == d, E.dbl(m))).alias(f"{n}_{m}") for n, d in (("f", full), ("u", undo), ("p", page)) for m in metrics]
    )
    ratio = lambda n, m: F.col(f"{n}_{m}") / F.nullif(F.col(f"f_{m}"), F.lit(0.0))
    speed, p99, rss, delta = metrics
    flat_ok = lambda n, s: (ratio(n, speed) >= s) & (ratio(n, p99) <= 1.10) & (ratio(n, rss) <= 1.10)
    in_flat = F.col("cell_id").isin(*flat)
    keeps = (ratio("p", speed) >= 0.90) & (ratio("p", rss) <= 1.0)
    heavy = keeps & (ratio("p", rss) <= 0.85) & (ratio("p", delta) <= 0.60)
    light = keeps & (ratio("p", delta) <= 0.75)
    all_in = lambda where, c: E.all_true(F.when(where, F.coalesce(c, F.lit(False))).otherwise(F.lit(True)))
    out = wide.agg(
        all_in(in_flat, flat_ok("u", 1.20)).alias("undo_sequential"),
        (all_in(F.col("cell_id") == saturated, heavy) & all_in(F.col("cell_id") == single, light)).alias("page_retained"),
        all_in(in_flat, flat_ok("p", 0.90)).alias("__flat"),
        F.count_distinct(F.when(in_flat | F.col("cell_id").isin(single, saturated), F.col("cell_id"))).alias("__cells"),
    )
    complete = F.col("__cells") == len(set(flat) | {single, saturated})
    out = out.withColumns({"undo_sequential": F.col("undo_sequential") & complete, "page_retained": F.col("page_retained") & complete})
    general = F.col("page_retained") & F.col("__flat")
    choice = (
        F.when(general, "page_general").when(F.col("page_retained") & F.col("undo_sequential"), "hybrid_undo_page")
        .when(F.col("page_retained"), "hybrid_full_page").when(F.col("undo_sequential"), "hybrid_undo_full").otherwise("full_clone")
    )
    return out.select("undo_sequential", "page_retained", general.alias("page_general"), choice.alias("selection"))


def resource_caps(ledger: DataFrame, key: Sequence[str], wall_limit: float, core_limit: float, bytes_limit: float, workers: int = 1) -> DataFrame:
    """G-08: running resource totals per ledger event with cap checks (at most / below the limit).

    Events of one ordinal count together: each has the totals after all of them.
    """
    run = O.running(ledger, key, "ordinal", {"wall_total": "wall_seconds", "core_total": F.col("wall_seconds") * workers}, peers=True)
    run = O.running_max(run, key, "ordinal", {"bytes_peak": "artifact_bytes"}, peers=True)
    return run.withColumns(
        {
            "passed": (F.col("wall_total") <= wall_limit) & (F.col("core_total") <= core_limit) & (F.col("bytes_peak") <= bytes_limit),
            "launchable": (F.col("wall_total") < wall_limit) & (F.col("core_total") < core_limit) & (F.col("bytes_peak") < bytes_limit),
        }
    )


def arm_decision(accuracy: DataFrame, target: str, controls: Sequence[str], minimum: float, minimum_uplift: float,
                 signal: str = "preliminary_opcode_alignment_signal", null: str = "null_opcode_alignment_result") -> DataFrame:
    """G-09 (alignment form): the target arm must reach the floor and beat every control by the margin."""
    t = F.max(F.when(F.col("arm") == target, F.col("accuracy")))
    c = [F.max(F.when(F.col("arm") == a, F.col("accuracy"))) for a in controls]
    out = accuracy.agg(t.alias("target_accuracy"), *[(t - x).alias(f"uplift_over_{a}") for a, x in zip(controls, c)])
    ok = F.col("target_accuracy") >= minimum
    for a in controls:
        ok = ok & (F.col(f"uplift_over_{a}") >= minimum_uplift)
    ok = F.coalesce(ok, F.lit(False))
    return out.withColumns({"criterion_met": ok, "decision": F.when(ok, signal).otherwise(null)})


def structural_decision(runs: DataFrame, intervals: DataFrame, uplifts: DataFrame, bounds: Mapping[str, float]) -> DataFrame:
    """G-09 (structural form): trainability, per-family accuracy and uplift, aggregate uplift and calibration.

    ``runs``: seed, train_accuracy, validation_accuracy; ``intervals``: family ('' = all), metric, mean;
    ``uplifts``: family ('' = all), mean, t95_low.
    """
    from scoreloom.functions.joins import attach_row

    b = bounds
    r = runs.agg(E.all_true((F.col("train_accuracy") >= b["train"]) & (F.col("validation_accuracy") >= b["validation"])).alias("trainability"))
    acc = F.col("metric") == "accuracy"
    fam = F.col("family") != ""
    i = intervals.agg(
        E.all_true(F.when(acc & fam, F.col("mean") >= b["family_accuracy"]).otherwise(F.lit(True))).alias("__fa"),
        E.all_true(F.when(acc & ~fam, F.col("mean") >= b["accuracy"]).otherwise(F.lit(True))).alias("__aa"),
        E.all_true(F.when((F.col("metric") == "brier") & ~fam, F.col("mean") <= b["brier"]).when((F.col("metric") == "nll") & ~fam, F.col("mean") <= b["nll"]).otherwise(F.lit(True))).alias("calibration"),
    )
    u = uplifts.agg(
        E.all_true(F.when(fam, F.col("mean") >= b["family_uplift"]).otherwise(F.lit(True))).alias("__fu"),
        E.all_true(F.when(~fam, F.col("t95_low") > b["uplift_low"]).otherwise(F.lit(True))).alias("__au"),
    )
    d = attach_row(attach_row(r, i), u)
    semantic = F.col("__fa") & F.col("__aa") & F.col("__fu") & F.col("__au")
    return d.select(
        "trainability", semantic.alias("semantic_accuracy"), "calibration",
        (F.col("trainability") & semantic & F.col("calibration")).alias("passed"),
    )


def budget_verdict(gate_rows: DataFrame) -> DataFrame:
    """G-10: per group pass or miss with the failed clauses, and the overall row."""
    tagged = gate_rows.withColumn("group", F.explode(F.array(F.col("group"), F.lit("overall"))))
    return tagged.groupBy("group").agg(
        F.when(E.all_true(F.col("passed")), "pass").otherwise("miss").alias("status"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("clause"))))).alias("failures"),
    )
