"""Training half and identities of a workload, and the root of conditional evidence."""

import pytest

from scoreloom.operators import measurements as M

GAME = "run string, game int, decisions int, traversals int, cpu_seconds double, terminal boolean"
ROW = "run string, game int, puct_ms double, command_ms double, native_actions int"


def test_training_summary_and_every_violation(spark):
    games = spark.createDataFrame(
        [("a", 1, 2, 8, 1.5, True), ("a", 2, 1, 4, 0.5, True), ("b", 3, 2, 8, 1.0, False), ("b", 4, 9, 36, 1.0, True), ("b", 5, 2, 7, 1.0, True), ("b", 6, 0, 0, None, True)], GAME)
    rows = spark.createDataFrame(
        [("a", 1, 1.0, 10.0, 1), ("a", 1, 3.0, 30.0, 1), ("a", 2, 5.0, 20.0, 0), ("b", 3, 1.0, 1.0, None), ("b", 3, 1.0, 1.0, 1)]
        + [("b", 4, 1.0, 1.0, 1)] * 9 + [("b", 5, 1.0, 1.0, 1)], ROW)
    clock = spark.createDataFrame([("a", 2.0)], "run string, wall_seconds double")
    out, bad = M.training_summary(games, rows, clock, simulations=4, max_decisions=5)
    got = {r.run: r for r in out.collect()}
    a = got["a"]
    assert (a.games, a.decisions, a.traversals, a.worker_cpu_seconds, a.native_apply_mismatches) == (2, 3, 12, 2.0, 1)
    assert (a.steps_per_second, a.traversals_per_second, a.games_per_second) == (1.5, 6.0, 1.0)
    assert (a.puct_min_ms, a.puct_p50_ms, a.puct_max_ms, a.puct_mean_ms, a.command_p50_ms) == (1.0, 3.0, 5.0, 3.0, 20.0)
    assert a.puct_p95_ms == pytest.approx(4.8)
    assert got["b"].steps_per_second is None and got["b"].native_apply_mismatches == 1
    assert sorted((r.rule, r.key) for r in bad.collect()) == [
        ("decision_count", "b/4"), ("decision_count", "b/6"), ("decision_rows", "b/5"), ("nonterminal_game", "b/3"), ("traversal_count", "b/5")]


def test_identity_of_surfaces(spark):
    schema = "surface string, terminal_state_sha256 string, logical_trace_sha256 string"
    same = spark.createDataFrame([("x", "t", "l"), ("x", "t", "l"), ("y", "t", "l")], schema)
    out, bad = M.workload_identity(same, "t")
    assert {(r.surface, r.terminal_state_sha256, r.logical_trace_sha256) for r in out.collect()} == {("x", "t", "l"), ("y", "t", "l")}
    assert bad.collect() == []
    mixed = spark.createDataFrame([("x", "t", "l"), ("x", "t", "m"), ("y", "u", "l"), ("z", None, "l")], schema)
    out, bad = M.workload_identity(mixed, "t")
    assert {r.surface: (r.terminal_state_sha256, r.logical_trace_sha256) for r in out.collect()} == {"x": ("t", None), "y": ("u", "l"), "z": (None, "l")}
    assert sorted((r.rule, r.key) for r in bad.collect()) == [
        ("nondeterministic_logical_trace_sha256", "x"), ("surfaces_differ_in_logical_trace_sha256", "all"),
        ("surfaces_differ_in_terminal_state_sha256", "all"), ("terminal_state_drift", "y"), ("terminal_state_drift", "z")]


def test_inner_series_of_one_surface(spark):
    games = spark.createDataFrame([("live", 2, 1.0, {"a": 1}), ("plain", 2, 1.0, {"a": 1})], "surface string, commands int, game_seconds double, fallback_counters map<string,int>")
    commands = spark.createDataFrame([("live", 10.0), ("live", 20.0), ("plain", 1.0), ("plain", 3.0)], "surface string, duration_ms double")
    inner = spark.createDataFrame([("live", 4.0), ("live", 6.0)], "surface string, duration_ms double")
    got = {r.surface: r for r in M.workload_summary(games, commands, ["a"], inner=inner)[0].collect()}
    assert (got["live"].mean_ms, got["live"].inner_mean_ms, got["live"].inner_max_ms) == (15.0, 5.0, 6.0)
    assert (got["plain"].mean_ms, got["plain"].inner_mean_ms, got["plain"].inner_p50_ms) == (2.0, 2.0, 2.0)


def test_root_evidence_and_its_reasons(spark):
    conditions = spark.createDataFrame([("a", 4, 0.5), ("b", 0, 0.5), ("c", 2, 0.1), ("d", None, None)], "condition string, simulations int, root_value double")
    worlds = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.4), ("a", 3, 0.6), ("c", 1, 0.1)], "condition string, world int, root_value double")
    got = {r.condition: r for r in M.root_evidence(conditions, worlds).collect()}
    assert got["a"].root_value == 0.5 and got["a"].root_uncertainty == pytest.approx(0.2 / 3**0.5) and got["a"].root_uncertainty_reason is None
    assert (got["b"].root_value, got["b"].root_value_reason) == (None, "no_realized_simulations")
    assert (got["c"].root_uncertainty, got["c"].root_uncertainty_reason) == (None, "insufficient_world_coverage")
    assert got["d"].root_value_reason == "no_realized_simulations" and got["d"].covered_worlds == 0


def test_evidence_violations(spark):
    conditions = spark.createDataFrame([("a", 3), ("b", 5), ("c", 0), ("d", None)], "condition string, simulations int")
    cells = spark.createDataFrame(
        [("a", 1, 0, 2, 0.5), ("a", 2, 1, 1, 0.5), ("b", 1, 0, 4, 0.5), ("b", 1, 1, 1, None), ("d", 1, 2, 1, 0.5)],
        "condition string, world int, action int, visits int, q double")
    offers = spark.createDataFrame([(0, 7), (1, 7)], "action int, offer_id int")
    assert sorted(tuple(r) for r in M.evidence_violations(conditions, cells, offers).collect()) == [
        ("offer_alignment", "action 2", "0"), ("offer_alignment", "offer 7", "2"), ("policy_mass", "c", "0:0"), ("policy_mass", "d", "1:none"), ("world_coverage", "b", "1")]
