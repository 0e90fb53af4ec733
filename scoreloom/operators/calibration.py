"""C-ops: reliability tables, prediction metrics and belief calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.joins import attach_row, join_back


def bin_edges(bins: int, edges: str = "division") -> list[tuple[float, float]]:
    """Bin limits: ``division`` is i/bins; ``accumulated`` is lower + 1/bins from a linear grid."""
    if edges == "division":
        return [(i / bins, (i + 1) / bins) for i in range(bins)]
    lows = np.linspace(0.0, 1.0 - 1.0 / bins, bins)
    return [(float(v), float(v + 1.0 / bins)) for v in lows]


def bin_index(p: Column, limits: Sequence[tuple[float, float]], last: str = "closed") -> Column:
    """Bin number by comparison with the limits; NULL outside.

    ``last``: 'closed' admits p <= upper of the last bin, 'one' admits exactly 1.0.
    """
    out = None
    for i, (low, high) in enumerate(limits):
        if i < len(limits) - 1:
            inside = (p >= low) & (p < high)
        elif last == "closed":
            inside = (p >= low) & (p <= high)
        else:
            inside = ((p >= low) & (p < high)) | (p == 1.0)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.cast("int")


def truth_label(winner: Column, seat: Column, winnerless: str = "excluded") -> Column:
    """winner == seat as 1/0; a missing winner is excluded (NULL), half, or a loss."""
    empty = {"excluded": None, "half": 0.5, "loss": 0.0}[winnerless]
    return F.when(winner.isNull(), F.lit(empty).cast("double")).otherwise(
        F.when(winner == seat, 1.0).otherwise(0.0)
    )


def reliability(
    df: DataFrame, p: str, y: str, by: Sequence[str] = (), bins: int = 10, edges: str = "division",
    last: str = "closed", clip: float = 1e-7, sparse_below: int = 10, weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """C-01: (summary, bins) of predictions ``p`` against targets ``y``.

    One shuffle by (by..., bin) with partial aggregation; the summary adds at most bins+1
    rows per group. Empty bins are listed; drop them with ``count > 0``.
    """
    limits = bin_edges(bins, edges)
    pc, yc = F.col(p).cast("double"), F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    q = F.greatest(F.least(pc, F.lit(1 - clip)), F.lit(clip))
    bce = -(yc * F.log(q) + (1 - yc) * F.log(1 - q))
    rows = df.filter(pc.isNotNull() & yc.isNotNull()).select(
        *by, bin_index(pc, limits, last).alias("bin"), w.alias("w"), pc.alias("p"), yc.alias("y"), bce.alias("bce")
    )
    per = rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("p")).alias("sp"),
        F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"),
        F.sum(F.col("w") * F.col("bce")).alias("sb"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy"))).otherwise(0.0)
    summary = per.groupBy(*by).agg(
        F.sum("n").alias("count"),
        (F.sum("sp") / F.sum("w")).alias("mean_prediction"), (F.sum("sy") / F.sum("w")).alias("mean_target"),
        (F.sum("sq") / F.sum("w")).alias("brier"), (F.sum("sb") / F.sum("w")).alias("binary_cross_entropy"),
        (F.sum(gap) / F.sum("w")).alias("expected_calibration_error"),
    ).withColumn(
        "status", F.when(F.col("count") >= sparse_below, "sufficient").otherwise("insufficient_n")
    )
    spine = summary.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lower"), F.lit(b).alias("upper")) for i, (a, b) in enumerate(limits)])
        ).alias("s"),
    ).select(*by, "s.bin", "s.lower", "s.upper")
    filled = per.filter(F.col("bin").isNotNull()).select(
        *by, "bin", F.col("n").alias("count"), (F.col("sp") / F.col("w")).alias("mean_prediction"),
        (F.col("sy") / F.col("w")).alias("mean_target"),
    )
    table = spine.join(filled, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return summary, table


def calibration_by_phase(
    df: DataFrame, p: str, targets: Mapping[str, str], phase_one_hot: str, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """C-02: (reliability summary per target source and phase, violations of the one-hot check).

    The phase is the position of the largest entry of the one-hot array, which must sum to one.
    """
    one_hot_ok = F.abs(E.array_sum(phase_one_hot) - 1.0) <= 1e-5
    phase = E.first_argmax(phase_one_hot)
    bad = df.filter(~F.coalesce(one_hot_ok, F.lit(False))).groupBy(F.col(phase_one_hot).cast("string").alias("key")).agg(
        F.count(F.lit(1)).cast("string").alias("detail")
    ).select(F.lit("phase_one_hot").alias("rule"), "key", "detail")
    sources = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).cast("double").alias("y")) for n, c in targets.items()])
    long = df.select(*by, F.col(p).alias("p"), phase.cast("string").alias("ph"), F.explode(sources).alias("t")).select(
        *by, "p", "t.source", "t.y", F.explode(F.array(F.lit("overall"), F.col("ph"))).alias("phase")
    )
    summary, _ = reliability(long.filter(E.finite("y")), "p", "y", [*by, "source", "phase"])
    return summary, bad


def value_calibration(
    decisions: DataFrame, winnerless: str, by: Sequence[str] = (), edges: str = "division"
) -> tuple[DataFrame, DataFrame]:
    """C-03: root value against the outcome for the acting seat, with the chosen label rule."""
    d = decisions.withColumn("__y", truth_label(F.col("winner"), F.col("seat"), winnerless))
    return reliability(d, "root_value", "__y", by, edges=edges)


def belief_calibration(
    points: DataFrame, by: Sequence[str] = (), bins: int = 10
) -> tuple[DataFrame, DataFrame]:
    """C-04: (aggregate per group, block per card).

    ``points``: log_loss, top_mass, rank, effective_size, true_world_index and
    ``cards`` array<struct<card, predicted, present>>.
    """
    base = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.avg("log_loss").alias("mean_log_loss"),
        F.avg("top_mass").alias("mean_top_mass"), F.avg("effective_size").alias("mean_effective_size"),
        E.count_true(F.col("true_world_index").isNull()).alias("outside_support"),
    )
    med = O.exact_quantiles(points, by, "rank", {"median_rank": 0.5})
    cards = points.select(*by, F.explode("cards").alias("c")).select(
        *by, "c.card", F.col("c.predicted").alias("p"), F.col("c.present").cast("double").alias("y")
    )
    keyed = cards.select(*by, F.explode(F.array(F.lit(""), F.col("card"))).alias("card"), "p", "y")
    summary, _ = reliability(keyed, "p", "y", [*by, "card"], bins, last="one")
    per_card = summary.filter("card <> ''").select(
        *by, "card", F.col("count").alias("points"), "brier", F.col("expected_calibration_error").alias("ece"),
        F.col("mean_prediction").alias("mean_predicted_inclusion"), F.col("mean_target").alias("observed_inclusion"),
    )
    overall = summary.filter("card = ''").select(
        *by, F.col("brier").alias("mean_per_card_brier"), F.col("expected_calibration_error").alias("per_card_ece")
    )
    if by:
        head = join_back(join_back(base, med, by, "left"), overall, by, "left")
    else:
        head = attach_row(
            attach_row(base, med.agg(F.max("median_rank").alias("median_rank"))),
            overall.agg(F.max("mean_per_card_brier").alias("mean_per_card_brier"), F.max("per_card_ece").alias("per_card_ece")),
        )
    return head, per_card


def paired_truth(points: DataFrame, by: Sequence[str] = (), order: str = "ordinal") -> DataFrame:
    """C-05: improvement of the posterior over the prior on the same truths; final = last by order."""
    out = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg("improvement").alias("mean_improvement"), F.max_by("improvement", order).alias("final_improvement"),
        F.avg("mass_ratio").alias("mean_mass_ratio"),
        F.avg(F.when(F.col("mass_ratio") > 1, 1.0).otherwise(0.0)).alias("share_above_prior"),
        F.avg("posterior_log_loss").alias("posterior_mean_log_loss"), F.avg("prior_log_loss").alias("prior_mean_log_loss"),
    )
    m1 = O.exact_quantiles(points, by, "improvement", {"median_improvement": 0.5})
    m2 = O.exact_quantiles(points, by, "mass_ratio", {"median_mass_ratio": 0.5})
    if by:
        return join_back(join_back(out, m1, by, "left"), m2, by, "left")
    return attach_row(attach_row(out, m1.agg(F.max("median_improvement").alias("median_improvement"))),
                      m2.agg(F.max("median_mass_ratio").alias("median_mass_ratio")))


def truth_by_viewer(points: DataFrame, improvement_gt: float = 0.0, share_gt: float = 0.5) -> DataFrame:
    """C-06: per viewer all points and opponent-commitment points, with the prediction gate."""
    scoped = points.select(
        "*", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("opponent_commitment"), F.lit("commitment"))))).alias("scope")
    )
    out = paired_truth(scoped, ["viewer", "scope"])
    gate = (F.col("mean_improvement") > improvement_gt) & (F.col("share_above_prior") > share_gt)
    return out.withColumn("prediction_passed", F.when(F.col("scope") == "commitment", gate))


def value_buckets(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C-07: value error by sign of the board and holding; all six buckets are listed (ungrouped use
    needs at least one row per group). Spearman needs eight rows, otherwise NaN."""
    from scoreloom.operators.ratings import spearman

    sign = F.when(F.col("board_adv") > 0, "ahead").when(F.col("board_adv") < 0, "behind").otherwise("even")
    hold = F.when(F.col("holding_interaction") > 0.5, "holding").otherwise("no-instants")
    d = df.withColumn("bucket", F.concat_ws("/", sign, hold))
    err = F.col("v") - F.col("gt")
    keys = [*by, "bucket"]
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.avg("gt").alias("mean_gt"),
        F.avg(err).alias("bias"), F.avg(F.abs(err)).alias("mae"),
    )
    rho = spearman(d, "v", "gt", keys).drop("n")
    names = F.array(*[F.lit(f"{s}/{h}") for s in ("ahead", "even", "behind") for h in ("holding", "no-instants")])
    groups = d.select(*by).distinct() if by else d.agg(F.lit(1).alias("__one"))
    spine = groups.select(*by, F.explode(names).alias("bucket"))
    out = spine.join(stats, keys, "left").join(rho, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return out.withColumns(
        {"n": n, "spearman": F.when(n >= 8, F.col("spearman")).when(n > 0, F.lit(float("nan")))}
    )


def policy_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C-08: cross entropy of logits against a target distribution, KL, accuracies, target entropy."""
    logp = E.log_softmax("logits")
    loss = -E.array_sum(F.zip_with("target", logp, lambda t, l: t.cast("double") * l))
    ent = -E.array_sum(F.transform("target", lambda t: t.cast("double") * F.log(F.greatest(t.cast("double"), F.lit(1e-12)))))
    hit = F.when(E.first_argmax("logits") == F.col("action"), 1.0).otherwise(0.0)
    d = df.select(*by, loss.alias("loss"), ent.alias("ent"), hit.alias("hit"), F.col("num_valid").alias("nv"))
    many = F.col("nv") > 1
    return d.groupBy(*by).agg(
        F.avg("loss").alias("policy_loss"),
        F.greatest(F.lit(0.0), F.avg(F.col("loss") - F.col("ent"))).alias("policy_kl"),
        F.avg("hit").alias("policy_accuracy"),
        F.coalesce(F.avg(F.when(many, F.col("hit"))), F.lit(0.0)).alias("policy_accuracy_nontrivial"),
        F.avg("ent").alias("policy_target_entropy"),
        F.avg(1.0 / F.greatest(F.col("nv"), F.lit(1))).alias("uniform_policy_probability"),
    )


def value_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C-09: BCE with logits, Brier and accuracy of value logits over usable rows."""
    x, t = F.col("value_logit").cast("double"), F.col("value_target").cast("double")
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    prob = 1.0 / (1.0 + F.exp(-x))
    ok = F.coalesce("usable", F.lit(False))
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(ok, bce)), F.lit(0.0)).alias("value_loss"),
        F.coalesce(F.avg(F.when(ok, (prob - t) * (prob - t))), F.lit(0.0)).alias("value_brier"),
        F.coalesce(F.avg(F.when(ok, F.when((prob >= 0.5) == (t >= 0.5), 1.0).otherwise(0.0))), F.lit(0.0)).alias("value_accuracy"),
        E.count_true(ok).alias("value_rows"),
    )


def binary_metrics(df: DataFrame, p1: str, label: str, by: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """C-10: accuracy, Brier, confidence ECE and NLL (floor 1e-12) of a two-class probability.

    Confidence is the larger class probability; equal probabilities predict class 0.
    """
    p, y = F.col(p1).cast("double"), F.col(label)
    pred = F.when(p > 0.5, 1).otherwise(0)
    correct = F.when(pred == y, 1.0).otherwise(0.0)
    own = F.when(y == 1, p).otherwise(1.0 - p)
    conf = F.greatest(p, 1.0 - p)
    limits = [(i / bins, (i + 1) / bins) for i in range(bins)]
    rows = df.select(
        *by, correct.alias("c"), ((p - y) * (p - y)).alias("b"), (-F.log(F.greatest(own, F.lit(1e-12)))).alias("l"),
        conf.alias("f"), bin_index(conf, limits).alias("bin"),
    )
    per = rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("c", "b", "l", "f")]
    )
    n = F.sum("n")
    return per.groupBy(*by).agg(
        n.alias("total"), (F.sum("c") / n).alias("accuracy"), (F.sum("b") / n).alias("brier"),
        (F.sum(F.abs(F.col("c") - F.col("f"))) / n).alias("ece_5_bin"), (F.sum("l") / n).alias("nll"),
    )


def explained_variance(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """C-11: 1 - Var(y - pred)/Var(y), NaN when the target is constant."""
    v = F.var_pop(y)
    return df.groupBy(*by).agg(v.alias("__v"), F.var_pop(F.col(y) - F.col(pred)).alias("__r")).select(
        *by,
        F.when(F.col("__v") > 0, 1.0 - F.col("__r") / F.nullif(F.col("__v"), F.lit(0.0)))
        .otherwise(F.lit(float("nan"))).alias("explained_variance"),
    )


def pair_symmetry(df: DataFrame, pair: str, p1: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """C-12: (max probability difference and prediction disagreements over complete pairs, violations)."""
    g = df.groupBy(*by, pair).agg(
        F.count(F.lit(1)).alias("n"), F.max(p1).alias("hi"), F.min(p1).alias("lo"),
        F.countDistinct(F.col(p1) > 0.5).alias("k"),
    )
    bad = g.filter("n <> 2").select(
        F.lit("incomplete_pair").alias("rule"), F.col(pair).cast("string").alias("key"), F.col("n").cast("string").alias("detail")
    )
    out = g.filter("n = 2").groupBy(*by).agg(
        F.max(F.col("hi") - F.col("lo")).alias("maximum_paired_probability_difference"),
        E.count_true(F.col("k") > 1).alias("paired_prediction_disagreements"),
        F.count(F.lit(1)).alias("pairs"),
    )
    return out, bad
