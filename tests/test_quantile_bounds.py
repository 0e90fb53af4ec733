import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import ordered as O
from scoreloom.operators import aggregates as A
from scoreloom.operators import comparisons as X
from scoreloom.operators import sequences as S
from scoreloom.operators import worlds as B

RNG = np.random.default_rng(4)
SETS = {
    "outlier": np.append(RNG.uniform(0, 1, 20_000), -1e9),
    "crowded": 1.7e15 + RNG.integers(0, 10_000_000, 20_000).astype(float),
    "signs": np.concatenate([-np.exp(RNG.normal(0, 50, 5000)), np.exp(RNG.normal(0, 50, 5000)), [0.0, -0.0, 5e-324, -5e-324]]),
}


@pytest.mark.parametrize("name", SETS)
def test_no_value_set_crowds_a_window(spark, name):
    x = SETS[name]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    row = O.exact_quantiles(df, [], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert list(row) == pytest.approx(list(np.percentile(x, [0, 37, 50, 100])), rel=1e-12)
    values = O._values(df, [], "v")
    cells = O._ranked(values, O._log_totals(values, []), []).groupBy("__b", "__c").count()
    assert cells.agg(F.max("count")).first()[0] <= len(x) / 50


def test_infinities_nan_and_null_keys(spark):
    rows = [("a", 1.0), ("a", float("inf")), ("a", float("inf")), ("a", float("-inf")), (None, 2.0), (None, 4.0), ("n", float("nan")), ("n", 1.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in O.exact_quantiles(df, ["k"], "v", {"lo": 0.0, "hi": 1.0, "mid": 2 / 3}).collect()}
    assert (got["a"].lo, got["a"].hi, got["a"].mid) == (-math.inf, math.inf, math.inf)
    assert (got[None].lo, got[None].hi) == (2.0, 4.0)
    assert got["n"].lo == 1.0 and math.isnan(got["n"].hi) and "e" not in got
    ranks = {(r.k, r.v): (r.n, r.below, r.total) for r in O.value_ranks(df.where("k = 'a'"), ["k"], "v").collect()}
    assert ranks == {("a", -math.inf): (1, 0, 4), ("a", 1.0): (1, 1, 4), ("a", math.inf): (2, 2, 4)}


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "k string, v double")
    assert S.normalise(df, "v", ["k"]).count() == 4
    assert {r.k: r.median for r in A.distribution(df, {"m": "v"}, ["k"]).collect()} == {"a": 2.0, None: 7.0}
    assert sum(r["count"] for r in A.histogram(df, "v", 2, ["k"]).collect()) == 4


def test_group_keys_may_have_short_names(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 2, 3.0)], "g long, r long, v double")
    assert O.exact_quantiles(df, ["g", "r"], "v", {"m": 0.5}).first().m == 2.0


def test_tied_first_cursor(spark):
    d = spark.createDataFrame([("x", 0, 0, 5), ("x", 0, 1, 5), ("x", 0, 2, 9)], "replay_id string, viewer int, ordinal long, cursor long")
    e = spark.createDataFrame([("x", 0, s) for s in range(1, 12)], "replay_id string, viewer int, seq long")
    got = {r.seq: r.ordinal for r in X.continuation(d, e).collect()}
    assert got == {**{s: 0 for s in range(1, 5)}, **{s: 1 for s in range(5, 9)}, **{s: 2 for s in range(9, 12)}}


def test_a_space_with_a_bad_likelihood_ends(spark):
    belief = spark.createDataFrame([(s, w, math.log(0.5)) for s in (1, 2) for w in (0, 1)], "space_id long, world_index long, log_p double")
    like = spark.createDataFrame([(1, 0, 0.5, 1, 1), (2, 0, 0.5, 1, 1), (2, 1, 0.25, 1, 1)], "space_id long, world_index long, likelihood double, legal int, matching int")
    out, bad = B.update(belief, like, 0.0)
    assert {(r.space_id, r.world_index): round(math.exp(r.log_p), 9) for r in out.collect()} == {(2, 0): round(2 / 3, 9), (2, 1): round(1 / 3, 9)}
    assert [(r.rule, r.key) for r in bad.collect()] == [("missing_likelihood", "1/1")]
