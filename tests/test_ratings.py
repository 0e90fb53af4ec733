import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import calibration as C
from scoreloom.operators import ratings as R

# Games won by the first player of each pair from seat 0 and from seat 1, 24 games each.
CELLS = [
    ("puct32", "flat16", 7, 12), ("puct32", "flat4", 12, 16), ("puct32", "flat64", 5, 9), ("puct32", "random", 18, 20),
    ("puct32", "greedy", 14, 20), ("flat16", "flat4", 8, 15), ("flat16", "flat64", 10, 8), ("flat16", "random", 23, 22),
    ("flat16", "greedy", 9, 21), ("flat4", "flat64", 5, 6), ("flat4", "random", 22, 23), ("flat4", "greedy", 6, 22),
    ("flat64", "random", 23, 24), ("flat64", "greedy", 19, 22), ("random", "greedy", 3, 14),
]
# Published ratings of that population.
RATINGS = {"flat64": 1513.282, "flat16": 1369.324, "puct32": 1333.201, "flat4": 1321.252, "greedy": 1203.275, "random": 1000.0}

SCHEMA = "player_a string, player_b string, deal_block bigint, leg int, player_a_seat int, score_a double, truncated boolean, termination_reason string"


def population(spark):
    rows = []
    for a, b, s0, s1 in CELLS:
        for seat, won in ((0, s0), (1, s1)):
            rows += [(a, b, i, seat, seat, 1.0 if i < won else 0.0, False, "win") for i in range(24)]
    return spark.createDataFrame(rows, SCHEMA)


def test_fit_reproduces_published_population(spark):
    fit = R.fit_ratings(population(spark).repartition(7), "random").collect()
    got = {r.name: r.value for r in fit if r.kind == "rating"}
    info = {r.name: r.value for r in fit if r.kind == "fit"}
    assert got == pytest.approx(RATINGS, abs=1e-3)
    assert info["seat0_elo"] == pytest.approx(-96.326, abs=1e-3)
    assert info["log_loss"] == pytest.approx(0.51517, abs=1e-5) and info["iterations"] == 6 and info["converged"] == 1.0


def test_payoff_matrix_with_expectations(spark):
    m = population(spark)
    res = R.rating_residuals(m, *R.split_fit(R.fit_ratings(m, "random")))
    cells = {(r.player_a, r.player_b): r for r in R.payoff_matrix(res, predicted=True).collect()}
    cell = cells["flat16", "puct32"]
    assert (cell.games, cell.wins_a, cell.wins_b) == (48, 29, 19)
    assert 1 - cell.expected_mean_score_a == pytest.approx(0.45194925341, abs=1e-8)
    assert -cell.pearson_residual == pytest.approx(-0.81105549190, abs=1e-7)
    assert R.top_residuals(R.payoff_matrix(res, predicted=True), 3).count() == 3


def test_blocks_need_exactly_two_legs(spark):
    rows = []
    for block in range(8):
        for seat in (0, 1):
            rows.append(("strong", "random", block, seat, seat, 0.0 if block == 0 else 1.0, False, "win"))
    rows += [("a", "b", 1, 0, 0, 0.5, False, "win"), ("a", "b", 1, 1, 1, 1.0, False, "win"), ("a", "b", 2, 0, 0, 1.0, False, "win"),
             ("b", "a", 3, 0, 0, 1.0, None, None), ("a", "b", 4, 0, 0, 1.0, True, "win"), ("a", "b", 5, 0, 0, 1.0, False, "truncated")]
    rows += [("a", "b", 6, i, i % 2, 1.0, False, "win") for i in range(3)]
    m = {r.cell_id: r for r in R.payoff_matrix(spark.createDataFrame(rows, SCHEMA)).collect()}
    c = m["random__strong"]
    assert (c.games, c.wins_b, c.sweeps_a, c.splits, c.sweeps_b, c.draw_or_mixed) == (16, 14, 1, 0, 7, 0)
    d = m["a__b"]
    assert d.games == 7 and d.draw_or_mixed == 4 and d.sweeps_a == 0


def test_separated_players_stay_finite(spark):
    rows = [("strong", "random", i // 2, i % 2, i % 2, 1.0, False, "win") for i in range(32)]
    fit = {r.name: r.value for r in R.fit_ratings(spark.createDataFrame(rows, SCHEMA), "random").collect()}
    assert math.isfinite(fit["strong"]) and fit["random"] == 1000.0 and abs(fit["seat0_elo"]) < 1e-6


def test_bootstrap_equals_refit_on_the_same_draws(spark):
    m = population(spark)
    boot = {(r.kind, r.name): r for r in R.bootstrap_ratings(m, "random", 20, 5, method="stream").collect()}
    rng = np.random.default_rng(5)
    pdf = m.toPandas()
    values = []
    for _ in range(20):
        draw = rng.choice(np.arange(24), size=24, replace=True)
        w = pdf["deal_block"].map(pd.Series(draw).value_counts()).fillna(0.0)
        cells = pdf.assign(weight=w).groupby(["player_a", "player_b", "player_a_seat", "score_a"], as_index=False)["weight"].sum()
        fit = R.solve_ratings(cells, "random", 400.0)
        values.append(dict(zip(fit["players"], fit["ratings"]))["flat64"])
    r = boot["rating", "flat64"]
    assert (r.low, r.median, r.high) == pytest.approx(tuple(np.percentile(values, [2.5, 50, 97.5])), abs=1e-6)
    assert ("difference", "flat16__minus__flat4") in boot and r.fits == 20 and ("failure", "") not in boot


def test_poisson_weights_have_unit_mean_and_variance(spark):
    uniform = R.hashed_uniform(F.lit(7), F.col("id"))
    u = spark.range(200_000).select(R._poisson_weight(uniform).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert u[0] == pytest.approx(1.0, abs=0.02) and u[1] == pytest.approx(1.0, abs=0.03)
    boot = {(r.kind, r.name): r for r in R.bootstrap_ratings(population(spark), "random", 30, 5).collect()}
    r = boot["rating", "flat64"]
    assert r.low < RATINGS["flat64"] < r.high and r.fits == 30


@pytest.mark.parametrize("wins,losses", [(0, 0), (3, 9), (10, 10), (1, 0), (2300, 2500), (150, 20), (1999, 2001), (0, 900), (6000, 5800)])
def test_sign_test(spark, wins, losses):
    n, m = wins + losses, min(wins, losses)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
    got = spark.range(1).select(R.sign_test_p(F.lit(wins), F.lit(losses))).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_fit_equals_dense_newton(spark):
    rng = np.random.default_rng(1)
    names = [f"p{k:02d}" for k in range(12)]
    cells = pd.DataFrame([(names[i], names[j], int(rng.integers(2)), float(rng.choice([0.0, 0.5, 1.0])), float(rng.integers(1, 9)))
                          for i in range(12) for j in range(i + 1, 12) for _ in range(3)], columns=["player_a", "player_b", "player_a_seat", "score_a", "weight"])
    fit = R.solve_ratings(cells, "p03", 400.0)
    x = np.zeros((len(cells), 13))
    for k, r in enumerate(cells.itertuples()):
        x[k, names.index(r.player_a)], x[k, names.index(r.player_b)], x[k, 12] = 1, -1, 1 if r.player_a_seat == 0 else -1
    theta, ridge = np.zeros(13), (R.ELO_PER_LOGIT / 400.0) ** 2
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        h = x.T @ (x * (cells.weight.to_numpy() * p * (1 - p))[:, None]) + ridge * np.eye(13)
        theta -= np.linalg.solve(h, x.T @ (cells.weight.to_numpy() * (p - cells.score_a.to_numpy())) + ridge * theta)
    assert fit["theta"] == pytest.approx(theta, abs=1e-9) and fit["converged"]
    assert fit["condition"] == pytest.approx(np.linalg.cond(h), rel=1e-4)


def test_components_and_gaps(spark):
    players = spark.createDataFrame([(p,) for p in "abcdefgh"], "player string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("f", "g"), ("x", "z")], "a string, b string")
    row, gaps = R.connectivity(players, edges, "a")
    r = row.first()
    assert r.component_count == 3 and not r.anchor_reaches_all and r.unexpected_edges == 1 and r.missing_edges == 28 - 5
    assert gaps.filter("rule = 'unexpected_edge'").first()["key"] == "x__z"


def test_spearman_ties_and_degenerate_groups(spark):
    rows = [("t", 1.0, 1.0), ("t", 2.0, 3.0), ("t", 2.0, 2.0), ("t", 5.0, 9.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("s", 1.0, 1.0)]
    got = {r.k: r.spearman for r in R.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert got["t"] == pytest.approx(np.corrcoef([0, 1.5, 1.5, 3], [0, 2, 1, 3])[0, 1])
    assert math.isnan(got["c"]) and math.isnan(got["s"])


def test_t_interval_needs_five_seeds(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 1.0)], "k string, v double")
    got = {r.k: r for r in R.t_interval(df, "v", ["k"]).collect()}
    assert got["a"].valid and got["a"].t95_high == pytest.approx(2 + 2.7764451051977987 * np.std(range(5), ddof=1) / math.sqrt(5))
    assert not got["b"].valid and got["b"].t95_low is None


def test_reliability_bin_edges(spark):
    p = [0.1, 0.3, 0.30000000000000004, 1.0, 0.0, 1.5]
    df = spark.createDataFrame([(x, 1.0) for x in p], "p double, y double")
    summary, bins = C.reliability(df, "p", "y")
    n = {r.bin: r["count"] for r in bins.collect()}
    assert n[1] == 1 and n[3] == 2 and n[9] == 1 and n[0] == 1 and sum(n.values()) == 5 and len(n) == 10
    assert summary.first()["count"] == 6 and summary.first()["status"] == "insufficient_n"
