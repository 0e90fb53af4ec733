"""Resampled intervals in parts against plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import ratings as R


def pairs(spark, values, scenario="s"):
    return spark.createDataFrame([(scenario, float(v), 0.0) for v in values], "scenario string, left_value double, right_value double")


def plain(values, replicates, quantiles):
    rng = np.random.default_rng(5)
    means = rng.choice(np.asarray(values, dtype=float), size=(replicates, len(values))).mean(axis=1)
    return np.percentile(means, [100 * q for q in quantiles])


@pytest.mark.parametrize("values", [[1, 0, 0, -1, 1, 1, 0], list(np.random.default_rng(1).normal(0.3, 2, 900))])
def test_interval_is_that_of_plain_resampling(spark, values):
    got = R.cluster_contrast(pairs(spark, values), ["scenario"], replicates=4000).first()
    low, high = plain(values, 4000, (0.025, 0.975))
    error = np.std(values) / np.sqrt(len(values))
    assert got.ci95_low == pytest.approx(low, abs=0.2 * error) and got.ci95_high == pytest.approx(high, abs=0.2 * error)


def test_parts_do_not_change_the_distribution(spark):
    values = np.random.default_rng(2).exponential(1.0, 3000)
    counts = spark.createDataFrame([(float(v), 1 + k % 3) for k, v in enumerate(values)], "value double, n long")
    found = [R._resample_means(counts, [], 3000, 9, {"q10": 0.1, "q90": 0.9}, parts=p).first() for p in (1, 7, 256)]
    width = found[0].q90 - found[0].q10
    assert width > 0
    for other in found[1:]:
        assert other.q10 == pytest.approx(found[0].q10, abs=0.1 * width) and other.q90 == pytest.approx(found[0].q90, abs=0.1 * width)


def test_reruns_and_partitions_agree(spark):
    frame = pairs(spark, np.random.default_rng(3).normal(size=500))
    a, b = (R.noninferiority(frame.repartition(n), 0.1, replicates=300, seed=4).first().one_sided_95_lower for n in (2, 9))
    assert a == pytest.approx(b, abs=1e-12)


def test_half_a_million_distinct_differences(spark):
    n = 500_000
    frame = spark.range(n).select(F.lit("all").alias("scenario"), (F.col("id") / n).alias("left_value"), F.lit(0.0).alias("right_value"))
    got = R.cluster_contrast(frame, ["scenario"], replicates=60).first()
    error = np.sqrt(1 / 12 / n)
    assert got.clusters == n and -6 * error < got.ci95_low - 0.5 < -error < error < got.ci95_high - 0.5 < 6 * error


def test_runs_inside_a_part_are_one_draw():
    values, counts = np.arange(5000.0), np.ones(5000, dtype=np.int64)
    left = np.full(400, 5000)
    rng = np.random.default_rng(0)
    means = R._draw_sums(values, counts, left, rng, run=64) / 5000
    assert means.mean() == pytest.approx(values.mean(), abs=4 * values.std() / np.sqrt(5000 * 400))
    assert means.std() == pytest.approx(values.std() / np.sqrt(5000), rel=0.2)


def test_single_value_and_no_rows(spark):
    one = R.cluster_contrast(pairs(spark, [2.0]), ["scenario"], replicates=10).first()
    assert (one.ci95_low, one.ci95_high, one.wins) == (2.0, 2.0, 1)
    assert R.cluster_contrast(pairs(spark, [1.0]).limit(0), ["scenario"], replicates=10).collect() == []
