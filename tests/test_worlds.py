import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import tracking as T
from scoreloom.operators import worlds as B

POOL = {"a": 3, "b": 4, "c": 2}


def pools(spark, hand=4, pool=POOL, space="s"):
    return spark.createDataFrame([(space, pool, hand)], "space_id string, pool map<string,int>, hand_size int")


def masses(df):
    return {r.hand_key: math.exp(r.log_p) for r in df.collect()}


def test_enumeration_is_exact_and_ordered(spark):
    rows = B.enumerate_worlds(pools(spark)).orderBy("world_index").collect()
    assert sum(int(r.weight) for r in rows) == math.comb(9, 4) == 126
    assert [r.world_index for r in rows] == list(range(11))
    counts = [tuple(r.hand.get(n, 0) for n in "abc") for r in rows]
    assert counts == sorted(counts) and all(sum(c) == 4 for c in counts)
    assert B.total_weights(pools(spark)).first()["total_weight"] == 126
    assert B.enumerate_worlds(pools(spark, 10)).count() == 0


def test_large_pool_counts(spark):
    pool = {f"n{i:02d}": 4 for i in range(12)}
    w = B.enumerate_worlds(pools(spark, 5, pool))
    row = w.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("t"), F.max("world_index").alias("m"), F.countDistinct("world_index").alias("d")).first()
    assert int(row.t) == math.comb(48, 5) and row.m == row.n - 1 == row.d - 1


def test_predicates_fold_against_the_pool(spark):
    qs = [B.WorldQuery("h0", "has", "a", 0), B.WorldQuery("h9", "has", "a", 9), B.WorldQuery("l0", "lacks", "a", 0), B.WorldQuery("l9", "lacks", "a", 9),
          B.WorldQuery("e0", "exactly", "a", 0), B.WorldQuery("ne0", "not_exactly", "a", 0), B.WorldQuery("e5", "exactly", "b", 5), B.WorldQuery("n5", "not_exactly", "b", 5)]
    got = {r.query_id: (r.canonical_kind, r["count"]) for r in B.canonical_predicates(pools(spark), qs).collect()}
    assert got == {"h0": ("true", None), "h9": ("empty", None), "l0": ("empty", None), "l9": ("true", None), "e0": ("lacks", 1), "ne0": ("has", 1), "e5": ("empty", None), "n5": ("true", None)}


def test_support_and_conditions(spark):
    w = B.enumerate_worlds(pools(spark))
    plan = B.query_plan(B.WorldQuery("has_c", "has", "c", 1), B.WorldQuery("two_b", "exactly", "b", 2))
    s = {r.query_id: int(r.total_weight) for r in B.support(w, plan).collect()}
    assert s["true"] == 126 and s["has_c"] + s["not(has_c)"] == 126 and s["not(has_c)"] == math.comb(7, 4)
    rows, empty = B.conditions(w, [*plan, B.WorldQuery("never", "has", "a", 9)])
    total = {r.condition: r.p for r in rows.groupBy("condition").agg(F.sum("p").alias("p")).collect()}
    assert all(v == pytest.approx(1.0) for v in total.values()) and empty.first()["key"] == "s/never"


def test_hidden_draw_equals_prior_of_the_larger_hand(spark):
    drawn = masses(B.draw(B.prior(B.enumerate_worlds(pools(spark, 3))), pools(spark, 3)))
    want = masses(B.prior(B.enumerate_worlds(pools(spark, 4))))
    assert drawn == pytest.approx(want)


def test_exit_then_return_conditions_on_the_card(spark):
    prior = B.prior(B.enumerate_worlds(pools(spark)))
    fact = spark.createDataFrame([("s", "a")], "space_id string, card string")
    back = B.add_known(B.remove_known(prior, fact), fact)
    assert masses(back) == pytest.approx({k: v for k, v in masses(prior).items() if "a=" in k})


def test_transport_applies_exits_returns_and_draws(spark):
    before = pools(spark)
    after = pools(spark, 4, {"a": 2, "b": 4, "c": 3}, "t")
    facts = spark.createDataFrame([("s", "t", ["a"], ["c"], 1)], "space_id string, next_space_id string, exits array<string>, returns array<string>, hidden_draws int")
    # -1 exit, +1 return, +1 draw: hand size 5 in the next space.
    after = after.withColumn("hand_size", F.lit(5))
    out, bad = B.transport(B.prior(B.enumerate_worlds(before)), before, facts, B.enumerate_worlds(after))
    assert bad.count() == 0
    m = masses(out)
    assert sum(m.values()) == pytest.approx(1.0)
    # Every mass sits on hands that hold the returned card.
    assert all("c=" in k for k, v in m.items() if v > 0)


def likelihood(spark, w, fn):
    return w.select("space_id", "world_index", fn.alias("likelihood"), F.lit(2).alias("legal"), F.lit(1).alias("matching"))


def test_update_floor_and_impossible(spark):
    w = B.enumerate_worlds(pools(spark))
    prior = B.prior(w)
    lik = likelihood(spark, w, F.lit(0.0)).withColumn("matching", F.when(F.col("world_index") < 3, 0).otherwise(1))
    out, bad = B.update(prior, lik, 0.1)
    rows = {r.world_index: r.log_p for r in out.collect()}
    assert len(rows) == 11 and all(rows[i] == -math.inf for i in range(3)) and bad.count() == 0
    _, none = B.update(prior, likelihood(spark, w, F.lit(0.0)), 0.0)
    assert [r.rule for r in none.collect()] == ["no_finite_mass"]
    _, wrong = B.update(prior, likelihood(spark, w, F.lit(1.5)), 0.0)
    assert "likelihood_range" in {r.rule for r in wrong.collect()}


def test_scores_and_ranks(spark):
    p = pools(spark)
    w = B.enumerate_worlds(p)
    prior = B.prior(w)
    truth = spark.createDataFrame([("hit", "s", {"a": 2, "b": 2}), ("miss", "s", {"z": 4})], "point_id string, space_id string, hand map<string,int>")
    got = {r.point_id: r for r in B.score_truth(prior, p, truth).collect()}
    assert got["hit"].probability == pytest.approx(3 * 6 / 126) and got["miss"].log_loss == math.inf and got["miss"].true_world_index is None
    inc = {c.card: c.predicted for c in got["hit"].cards}
    assert inc["c"] == pytest.approx(1 - math.comb(7, 4) / 126)
    better = sum(1 for v in masses(prior).values() if v > got["hit"].probability + 1e-12)
    assert got["hit"].rank == better + 1


def test_paired_sampling_matches_searchsorted(spark):
    import numpy as np

    prior = B.prior(B.enumerate_worlds(pools(spark)))
    got = {r.draw: r.world_index for r in B.sample_worlds(prior, B.shared_uniforms(spark, 50, 9), buckets=8).collect()}
    p = np.exp([r.log_p for r in prior.orderBy("world_index").collect()])
    cum = np.cumsum(p)
    cum[-1] = 1.0
    want = np.searchsorted(cum, np.random.default_rng(9).random(50), side="right")
    assert [got[i] for i in range(50)] == want.tolist()


def test_tracker_stops_at_a_revision_gap(spark):
    spaces = pools(spark, 3).unionByName(pools(spark, 4, POOL, "t"))
    w = B.enumerate_worlds(spaces)
    cols = "game string, viewer int, sequence bigint, before_revision bigint, after_revision bigint, before_space string, after_space string, acting int, commitment_kind string, exits array<string>, returns array<string>, hidden_draws int"
    tr = spark.createDataFrame(
        [("g", 0, 0, 1, 2, "s", "t", 1, None, [], [], 1), ("g", 0, 1, 2, 3, "t", "t", 1, None, [], [], 0),
         ("h", 0, 0, 1, 2, "s", "s", 1, None, [], [], 0), ("h", 0, 1, 7, 8, "s", "t", 1, None, [], [], 1)], cols)
    starts = spark.createDataFrame([("g", 0, 1, "s"), ("h", 0, 1, "s")], "game string, viewer int, revision bigint, space_id string")
    none = spark.createDataFrame([], "game string, viewer int, sequence bigint, world_index bigint, likelihood double, legal int, matching int")
    records, state, bad = T.track(tr, starts, spaces, w, none, 0.0)
    assert {(r.game, r.sequence) for r in records.collect()} == {("g", 0), ("g", 1), ("h", 0)}
    assert [r.rule for r in bad.collect()] == ["revision_gap"]
    final = {r.real_space for r in state.collect()}
    assert final == {"t", "s"}
    got = {r.hand_key: math.exp(r.log_p) for r in state.filter("real_space = 't'").collect()}
    assert got == pytest.approx(masses(B.prior(w.filter("space_id = 't'"))))
