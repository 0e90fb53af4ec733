"""R-ops: population ratings, resampling, paired tests and connectivity.

The rating fit depends on the matches only through the counts of the cells (player a,
player b, seat, score). Spark collapses the match log to those cells (map-side combined,
one small shuffle); the fit then works on sums per pair and seat, so its cost depends on the
pairs that met and not on the number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.joins import attach_row, join_back
from scoreloom.session import cut_lineage

# Fixed values of the rating scale: Elo points per unit of log odds, anchor rating, limits.
ELO_PER_LOGIT = 400.0 / math.log(10.0)
ANCHOR_RATING = 1000.0
PRIOR_ELO_SD = 400.0
LOGIT_LIMIT = 40.0
GRADIENT_TOLERANCE = 1e-10
MAX_ITERATIONS = 100


def retained(matches: DataFrame) -> DataFrame:
    """P-01: drop truncated rows; a NULL flag or reason means not truncated."""
    return matches.filter(
        ~F.coalesce("truncated", F.lit(False))
        & (F.coalesce("termination_reason", F.lit("")) != "truncated")
    )


def orient_pairs(df: DataFrame) -> DataFrame:
    """P-02: each row from the side of the alphabetically first player."""
    flip = F.col("player_a") > F.col("player_b")
    cols = {
        "player_a": F.least("player_a", "player_b"),
        "player_b": F.greatest("player_a", "player_b"),
        "score_a": F.when(flip, 1.0 - F.col("score_a")).otherwise(F.col("score_a")),
        "player_a_seat": F.when(flip, 1 - F.col("player_a_seat")).otherwise(F.col("player_a_seat")),
    }
    if "predicted_score_a" in df.columns:
        p = F.col("predicted_score_a")
        cols["predicted_score_a"] = F.when(flip, 1.0 - p).otherwise(p)
    return df.withColumns(cols)


def score_for(player: Column | str) -> Column:
    """P-03: score of a match row from one player's side; NULL if the player is not in it."""
    p = F.col(player) if isinstance(player, str) else player
    return F.when(F.col("player_a") == p, F.col("score_a")).when(
        F.col("player_b") == p, 1.0 - F.col("score_a")
    )


def rating_cells(matches: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Sufficient statistic of the fit: summed weights per (player_a, player_b, seat, score)."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return matches.groupBy(*by, "player_a", "player_b", "player_a_seat", "score_a").agg(
        w.cast("double").alias("weight")
    )


class _PairTable:
    """Weight and score of every (first player, second player, seat), by player index.

    All sums of the fit run over these rows, so nothing of the size rows × players or players × players exists. The last
    parameter is the seat effect, in favour of the first player in seat 0.
    """

    def __init__(self, cells: pd.DataFrame, prior_sd: float):
        seat = np.where(cells["player_a_seat"].to_numpy() == 0, 1.0, -1.0)
        names = pd.unique(pd.concat([cells["player_a"], cells["player_b"]]).astype(str))
        self.players = np.sort(np.asarray(names, dtype=object).astype(str))
        rows = pd.DataFrame({
            "i": np.searchsorted(self.players, cells["player_a"].astype(str)), "j": np.searchsorted(self.players, cells["player_b"].astype(str)),
            "seat": seat, "n": cells["weight"].astype(float), "s": cells["weight"].astype(float) * cells["score_a"].astype(float),
        }).groupby(["i", "j", "seat"], as_index=False, sort=True).sum()
        self.i, self.j, self.seat, self.n, self.s = (rows[c].to_numpy() for c in ("i", "j", "seat", "n", "s"))
        self.ridge = (ELO_PER_LOGIT / prior_sd) ** 2

    def win(self, theta: np.ndarray) -> np.ndarray:
        """Chance of the first player in every row."""
        lead = theta[self.i] - theta[self.j] + self.seat * theta[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(lead, -LOGIT_LIMIT, LOGIT_LIMIT)))

    def spread(self, per_row: np.ndarray) -> np.ndarray:
        """A quantity of every row summed onto the parameters it depends on, with their signs."""
        size = len(self.players)
        by_player = np.bincount(self.i, per_row, size) - np.bincount(self.j, per_row, size)
        return np.append(by_player, np.dot(self.seat, per_row))

    def slope(self, theta: np.ndarray) -> np.ndarray:
        return self.spread(self.n * self.win(theta) - self.s) + self.ridge * theta

    def curvature(self, theta: np.ndarray):
        """The Hessian as a function, and its diagonal."""
        p = self.win(theta)
        c = self.n * p * (1.0 - p)
        size = len(self.players)
        diagonal = np.append(np.bincount(self.i, c, size) + np.bincount(self.j, c, size), c.sum()) + self.ridge
        return lambda v: self.spread(c * (v[self.i] - v[self.j] + self.seat * v[-1])) + self.ridge * v, diagonal


def _conjugate(apply, diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a positive definite system by conjugate gradients, scaled by the diagonal."""
    x, rest = np.zeros_like(right), right.copy()
    z = rest / diagonal
    way, size = z.copy(), float(rest @ z)
    goal = 1e-30 * size
    for _ in range(20 * len(right)):
        if size <= goal:
            break
        image = apply(way)
        step = size / float(way @ image)
        x += step * way
        rest -= step * image
        z = rest / diagonal
        size, before = float(rest @ z), size
        way = z + (size / before) * way
    return x


def _extreme(apply, size: int, rounds: int = 400) -> float:
    """Largest eigenvalue of a positive definite operator, by powers from a fixed start."""
    v, value = np.cos(np.arange(size) + 1.0), 0.0
    for _ in range(rounds):
        v = v / np.linalg.norm(v)
        image = apply(v)
        last, value = value, float(v @ image)
        if abs(value - last) <= 1e-13 * value:
            break
        v = image
    return value


def solve_ratings(cells: pd.DataFrame, anchor: str, prior_sd: float, diagnose: bool = True) -> dict:
    """Most probable skills and seat effect under a Gaussian prior, from weighted cells.

    Newton steps; each is found by conjugate gradients on the pair table. ``diagnose`` adds the condition
    number of the curvature.
    """
    table = _PairTable(cells, prior_sd)
    where = int(np.searchsorted(table.players, anchor))
    if len(table.players) < 2 or where == len(table.players) or table.players[where] != anchor:
        raise ValueError("a rating needs two players and the anchor")
    theta = np.zeros(len(table.players) + 1)
    for steps in range(1, MAX_ITERATIONS + 1):
        slope = table.slope(theta)
        steepest = float(np.abs(slope).max())
        if steepest <= GRADIENT_TOLERANCE:
            break
        theta = theta - _conjugate(*table.curvature(theta), slope)
    chance = table.win(theta)
    score, total = table.s, table.n
    surprise = -(score @ np.log(chance + 1e-15) + (total - score) @ np.log(1.0 - chance + 1e-15))
    elo = theta * ELO_PER_LOGIT
    fit = {
        "players": table.players, "ratings": elo[:-1] - elo[where] + ANCHOR_RATING, "seat": float(elo[-1]), "theta": theta,
        "converged": steepest <= GRADIENT_TOLERANCE, "iterations": steps, "gradient_norm": steepest,
        "log_loss": float(surprise / total.sum()) if total.sum() else math.nan,
    }
    if diagnose:
        apply, diagonal = table.curvature(theta)
        fit["condition"] = _extreme(apply, len(theta)) * _extreme(lambda v: _conjugate(apply, diagonal, v), len(theta))
    return fit


def _deviance(cells: pd.DataFrame, fit: dict, prior_sd: float) -> float:
    """Twice the log likelihood lost against the scores themselves; every match counts once."""
    counted = _PairTable(cells.assign(weight=cells["rows"]), prior_sd)
    chance, y = counted.win(fit["theta"]), cells["score_a"].to_numpy(dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(y > 0, y * np.log(y), 0.0) + np.where(y < 1, (1 - y) * np.log(1 - y), 0.0)
    fitted = counted.s @ np.log(chance) + (counted.n - counted.s) @ np.log(1.0 - chance)
    return 2.0 * float(cells["rows"].to_numpy(dtype=float) @ own - fitted)


_FIT_FIELDS = "kind string, name string, value double"


def fit_ratings(
    matches: DataFrame, anchor: str, by: Sequence[str] = (), prior_elo_sd: float = PRIOR_ELO_SD,
    weight: str | None = None,
) -> DataFrame:
    """R-01: long table (by..., kind, name, value): a rating per player and fit diagnostics.

    The deviance is unweighted over rows (each match counts once) while the log loss is
    weighted, as in the usual definition of the two with resampling weights.
    """
    kept = retained(matches)
    cells = kept.groupBy(*by, "player_a", "player_b", "player_a_seat", "score_a").agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("weight"),
        F.count(F.lit(1)).cast("double").alias("rows"),
    )
    keys = list(by) or ["__all"]
    if not by:
        cells = cells.withColumn("__all", F.lit(0))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = solve_ratings(pdf, anchor, prior_elo_sd)
        deviance = _deviance(pdf, fit, prior_elo_sd)
        out = [("rating", p, r) for p, r in zip(fit["players"], fit["ratings"])]
        out += [
            ("fit", "seat0_elo", fit["seat"]), ("fit", "converged", float(fit["converged"])),
            ("fit", "iterations", float(fit["iterations"])),
            ("fit", "gradient_norm", fit["gradient_norm"]),
            ("fit", "hessian_condition", fit["condition"]), ("fit", "log_loss", fit["log_loss"]),
            ("fit", "deviance", deviance),
        ]
        frame = pd.DataFrame(out, columns=["kind", "name", "value"])
        for i, k in enumerate(keys):
            frame.insert(i, k, [key[i]] * len(frame))
        return frame

    types = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + _FIT_FIELDS
    out = cells.groupBy(*keys).applyInPandas(solve, schema)
    return out if by else out.drop("__all")


def split_fit(fit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings: player, rating), (seat effect: one row seat0_elo) of an ungrouped fit.

    The fit, one row per player, is written first: both parts are read several times.
    """
    fit = cut_lineage(fit)
    ratings = fit.filter("kind = 'rating'").select(F.col("name").alias("player"), F.col("value").alias("rating"))
    seat = fit.agg(F.max(F.when((F.col("kind") == "fit") & (F.col("name") == "seat0_elo"), F.col("value"))).alias("seat0_elo"))
    return ratings, seat


def rating_residuals(matches: DataFrame, ratings: DataFrame, seat: DataFrame) -> DataFrame:
    """R-02: predicted score, raw and Pearson residual and deviance of every retained match."""
    ra = ratings.select(F.col("player").alias("player_a"), F.col("rating").alias("__ra"))
    rb = ratings.select(F.col("player").alias("player_b"), F.col("rating").alias("__rb"))
    d = attach_row(retained(matches).join(ra, "player_a").join(rb, "player_b"), seat)
    side = F.when(F.col("player_a_seat") == 0, 1.0).otherwise(-1.0)
    eta = (F.col("__ra") - F.col("__rb") + side * F.col("seat0_elo")) / ELO_PER_LOGIT
    eta = F.greatest(F.least(eta, F.lit(LOGIT_LIMIT)), F.lit(-LOGIT_LIMIT))
    d = d.withColumn("predicted_score_a", 1.0 / (1.0 + F.exp(-eta)))
    p, s = F.col("predicted_score_a"), F.col("score_a")
    dev = F.when(s > 0, s * F.log(s / p)).otherwise(0.0) + F.when(
        s < 1, (1 - s) * F.log((1 - s) / (1 - p))
    ).otherwise(0.0)
    return d.withColumns(
        {
            "raw_residual": s - p,
            "pearson_residual": (s - p) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-15))),
            "deviance": 2.0 * dev,
        }
    ).drop("__ra", "__rb", "seat0_elo")


def payoff_matrix(matches: DataFrame, predicted: bool = False) -> DataFrame:
    """A-19: one row per canonical pair; ``predicted`` needs the columns of ``rating_residuals``.

    Aggregated twice: (pair, block) -> pair. A block counts as sweep or split only with
    exactly two legs; everything else is draw_or_mixed.
    """
    d = orient_pairs(matches if predicted else retained(matches))
    s = F.col("score_a")
    seat = F.col("player_a_seat")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"),
        E.count_true(s == 1.0).alias("w"), E.count_true(s == 0.5).alias("d"), E.count_true(s == 0.0).alias("l"),
    ]
    for i in (0, 1):
        aggs += [E.count_true(seat == i).alias(f"n{i}"), F.sum(F.when(seat == i, s).otherwise(0.0)).alias(f"s{i}")]
    if predicted:
        p = F.col("predicted_score_a")
        aggs += [F.sum(p).alias("p"), F.sum(p * (1 - p)).alias("v"), F.sum("deviance").alias("dev")]
    block = d.groupBy("player_a", "player_b", "deal_block").agg(*aggs)
    two = F.col("n") == 2
    top = [
        F.sum("n").alias("games"), F.sum("s").alias("score_a"),
        F.sum("w").alias("wins_a"), F.sum("d").alias("draws"), F.sum("l").alias("wins_b"),
        *[F.sum(f"n{i}").alias(f"games_seat{i}") for i in (0, 1)],
        *[F.sum(f"s{i}").alias(f"score_a_seat{i}") for i in (0, 1)],
        F.count(F.lit(1)).alias("blocks"),
        E.count_true(two & (F.col("w") == 2)).alias("sweeps_a"),
        E.count_true(two & (F.col("w") == 1) & (F.col("l") == 1)).alias("splits"),
        E.count_true(two & (F.col("l") == 2)).alias("sweeps_b"),
    ]
    if predicted:
        top += [F.sum("p").alias("expected_score_a"), F.sum("v").alias("__v"), F.sum("dev").alias("cell_deviance")]
    m = block.groupBy("player_a", "player_b").agg(*top)
    m = m.withColumns(
        {
            "cell_id": F.concat_ws("__", "player_a", "player_b"),
            "mean_score_a": E.rate("score_a", "games", None),
            "mean_score_a_seat0": E.rate("score_a_seat0", "games_seat0", None),
            "mean_score_a_seat1": E.rate("score_a_seat1", "games_seat1", None),
            "draw_or_mixed": F.col("blocks") - F.col("sweeps_a") - F.col("sweeps_b") - F.col("splits"),
        }
    ).drop("blocks")
    if predicted:
        gap = F.col("score_a") - F.col("expected_score_a")
        m = m.withColumns(
            {
                "expected_mean_score_a": F.col("expected_score_a") / F.col("games"),
                "raw_residual_percentage_points": 100.0 * gap / F.col("games"),
                "pearson_residual": F.when(F.col("__v") > 0, gap / F.sqrt("__v")).otherwise(0.0),
            }
        ).drop("__v")
    return m


def top_residuals(matrix: DataFrame, k: int = 10) -> DataFrame:
    """R-04: the k cells with the largest absolute residual."""
    return matrix.orderBy(F.abs("raw_residual_percentage_points").desc(), "cell_id").limit(k)


def _poisson_weight(u: Column) -> Column:
    """Poisson(1) quantile of a uniform, unrolled until the tail is below 1e-16."""
    cdf, term, out = math.exp(-1.0), math.exp(-1.0), F.when(u < math.exp(-1.0), 0)
    for k in range(1, 18):
        term /= k
        cdf += term
        out = out.when(u < cdf, k)
    return out.otherwise(18).cast("double")


def hashed_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the SHA-256 of the parts, joined by ``/``: 52 bits."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bootstrap_weights(spark, blocks: Sequence[int], replicates: int, seed: int) -> DataFrame:
    """(replicate, deal_block, weight) drawn with replacement from one numpy stream."""
    rng = np.random.default_rng(seed)
    ordered = np.asarray(sorted(blocks))
    parts = []
    for r in range(replicates):
        values, counts = np.unique(rng.choice(ordered, size=len(ordered), replace=True), return_counts=True)
        parts.append(pd.DataFrame({"replicate": r, "deal_block": values, "weight": counts.astype(float)}))
    frame = pd.concat(parts) if parts else pd.DataFrame({"replicate": [], "deal_block": [], "weight": []})
    return spark.createDataFrame(frame, "replicate int, deal_block bigint, weight double")


def bootstrap_ratings(
    matches: DataFrame, anchor: str, replicates: int, seed: int, prior_elo_sd: float = PRIOR_ELO_SD, method: str = "hash"
) -> DataFrame:
    """R-03: deal-block bootstrap; (kind, name, low, median, high, fits) for ratings, pairwise
    differences and the seat effect, and the number of failed replicates.

    Truncated rows are dropped before weighting. ``method="hash"`` gives each (replicate, block) an
    independent Poisson(1) weight from SHA-256, the usual bootstrap for massive data: it needs no draw
    table, and rows are combined to (replicate, cell) before the shuffle. ``method="stream"`` draws multinomial
    counts from one numpy stream on the driver, for reproducing results that were made so; it holds
    replicates × blocks weights there. The caller chooses; the size of the data never does.
    """
    if method not in ("hash", "stream"):
        raise ValueError(f"unknown method {method!r}")
    kept = retained(matches)
    per_block = kept.groupBy("deal_block", "player_a", "player_b", "player_a_seat", "score_a").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    cell = ["player_a", "player_b", "player_a_seat", "score_a"]
    if method == "stream":
        blocks = [r[0] for r in kept.select("deal_block").distinct().collect()]
        w = bootstrap_weights(kept.sparkSession, blocks, replicates, seed)
        weighted = per_block.join(w, "deal_block").select("replicate", *cell, (F.col("n") * F.col("weight")).alias("weight"))
    else:
        weighted = per_block.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select(
            "replicate", *cell, (F.col("n") * _poisson_weight(hashed_uniform(F.lit(seed), F.col("replicate"), F.col("deal_block")))).alias("weight"))
    # Cells of weight zero keep every player in every replicate.
    empty = per_block.select(*cell).distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), *cell, F.lit(0.0).alias("weight")
    )
    cells = weighted.unionByName(empty).groupBy("replicate", *cell).agg(F.sum("weight").alias("weight"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            fit = solve_ratings(pdf, anchor, prior_elo_sd, diagnose=False)
        except ValueError:
            fit = None
        if fit is None or not fit["converged"]:
            return pd.DataFrame([(key[0], "failure", "", 1.0)], columns=["replicate", "kind", "name", "value"])
        names, r = fit["players"], fit["ratings"]
        rows = [(key[0], "rating", p, v) for p, v in zip(names, r)]
        rows += [
            (key[0], "difference", f"{names[i]}__minus__{names[j]}", r[i] - r[j])
            for i in range(len(names)) for j in range(i + 1, len(names))
        ]
        rows.append((key[0], "seat", "seat0_elo", fit["seat"]))
        return pd.DataFrame(rows, columns=["replicate", "kind", "name", "value"])

    fits = cells.groupBy("replicate").applyInPandas(solve, "replicate int, kind string, name string, value double")
    # One value per replicate: the group size is the declared number of replicates.
    return fits.groupBy("kind", "name").agg(
        F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.5)).alias("median"),
        F.percentile("value", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("fits"),
    )


# ------------------------------------------------------------------ paired comparisons


def paired_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """J-01: (inner pairs, violations). Both sides must hold the same unique keys."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl"), F.max(value).alias("left_value"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr"), F.max(value).alias("right_value"))
    j = l.join(r, list(keys), "full_outer")
    ok = (F.col("nl") == 1) & (F.col("nr") == 1)
    key_text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bad = j.filter(~F.coalesce(ok, F.lit(False))).select(
        F.lit("unpaired_key").alias("rule"), key_text.alias("key"),
        F.concat_ws(":", F.coalesce("nl", F.lit(0)).cast("string"), F.coalesce("nr", F.lit(0)).cast("string")).alias("detail"),
    )
    return j.filter(ok).select(*keys, "left_value", "right_value"), bad


def _resample_means(counts: DataFrame, by: Sequence[str], replicates: int, seed: int, probs: dict[str, float], parts: int = 256) -> DataFrame:
    """Quantiles of bootstrap means from value counts.

    Drawing n values with replacement is a multinomial draw over the distinct values, and a multinomial draw can be
    made in two steps: how many of the n fall into each part of the values, then which values inside a part. A
    group's values are dealt to ``parts`` parts by hash. Every part draws the first step from the same seed, so all
    parts agree on it without meeting, and draws its own values a run at a time; the parts' sums add up to
    the group's. No task holds more than one part of one group.
    """
    keys = list(by) or ["__all"]
    c = (counts if by else counts.withColumn("__all", F.lit(0))).withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    sizes = c.groupBy(*keys, "__part").agg(F.sum("n").alias("n"))
    layout = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", "n"))).alias("__layout"))
    each = layout.select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], F.posexplode("__layout.__part").alias("__at", "__of"), F.col("__layout.n").alias("__sizes")
    )

    def draw(key: tuple, values: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("value")
        sizes = np.asarray(plan["__sizes"].iloc[0], dtype=np.int64)
        at, total = int(plan["__at"].iloc[0]), int(sizes.sum())
        group = [seed, *[abs(hash_text(str(k))) for k in key[:-1]]]
        left = np.random.default_rng(group).multinomial(total, sizes / total, size=replicates)[:, at]
        sums = _draw_sums(values["value"].to_numpy(dtype=float), values["n"].to_numpy(dtype=np.int64), left, np.random.default_rng([*group, int(key[-1]) + 1]))
        return pd.DataFrame([[*key[:-1], total, (sums / total).tolist()]], columns=[*keys, "total", "shares"])

    types = dict(c.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", total long, shares array<double>"
    pieces = c.groupBy(*keys, "__part").cogroup(each.groupBy(*[f"__key_{i}" for i in range(len(keys))], "__of")).applyInPandas(draw, schema)
    means = pieces.select(*keys, F.posexplode("shares").alias("__replicate", "share")).groupBy(*keys, "__replicate").agg(F.sum("share").alias("mean"))
    out = means.groupBy(*keys).agg(*[F.percentile("mean", F.lit(q)).alias(name) for name, q in probs.items()])
    return out if by else out.drop("__all")


def _draw_sums(values: np.ndarray, counts: np.ndarray, left: np.ndarray, rng: np.random.Generator, run: int = 1024) -> np.ndarray:
    """Sums of ``left[r]`` draws from ``values`` with weights ``counts``, for every replicate r; a run of values at a time."""
    left, sums, rest = left.copy(), np.zeros(len(left)), int(counts.sum())
    for low in range(0, len(values), run):
        n = counts[low : low + run]
        size = int(n.sum())
        here = left if size == rest else rng.binomial(left, size / rest)
        share = n / size
        sums += rng.multinomial(here, share / share.sum()) @ values[low : low + run]
        left, rest = left - here, rest - size
    return sums


def hash_text(text: str) -> int:
    """Stable small integer of a text (Python's own hash changes between processes)."""
    value = 0
    for ch in text.encode():
        value = (value * 131 + ch) % 2_147_483_647
    return value


def noninferiority(
    pairs: DataFrame, margin: float, by: Sequence[str] = ("scenario",), replicates: int = 2000, seed: int = 0
) -> DataFrame:
    """R-05: mean paired difference, 5th percentile of bootstrap means, pass flags.

    ``pairs`` comes from ``paired_join``; its differences may all be distinct.
    """
    d = pairs.withColumn("value", E.dbl("left_value") - E.dbl("right_value"))
    counts = d.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    point = counts.groupBy(*by).agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("point_difference"), F.sum("n").alias("pairs")
    )
    low = _resample_means(counts, by, replicates, seed, {"one_sided_95_lower": 0.05})
    j = point.join(low, list(by)) if by else attach_row(point, low.agg(F.max("one_sided_95_lower").alias("one_sided_95_lower")))
    return j.withColumns(
        {
            "point_passed": F.col("point_difference") >= -margin,
            "lower_bound_passed": F.col("one_sided_95_lower") > -margin,
            "passed": (F.col("point_difference") >= -margin) & (F.col("one_sided_95_lower") > -margin),
        }
    )


def cluster_outcomes(rows: DataFrame, keys: Sequence[str] = ("model_seed", "program")) -> tuple[DataFrame, DataFrame]:
    """R-07: (one outcome per cluster, violations for clusters whose outcome is not constant)."""
    g = rows.groupBy(*keys).agg(
        F.min(F.col("correct").cast("int")).alias("lo"), F.max(F.col("correct").cast("int")).alias("hi"),
        F.count(F.lit(1)).alias("rows"),
    )
    bad = g.filter("lo <> hi").select(
        F.lit("unstable_cluster").alias("rule"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.col("rows").cast("string").alias("detail"),
    )
    return g.filter("lo = hi").select(*keys, (F.col("lo") == 1).alias("correct")), bad


def cluster_accuracy(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """R-08: accuracy with the exact-z Wilson interval over clusters, and per field of ``by`` over rows.

    Repeated rows of a cluster do not enter the cluster interval.
    """
    outcomes, _ = cluster_outcomes(rows, keys)
    parts = [outcomes.select(F.lit("clusters").alias("scope"), F.lit("all").alias("level"), "correct")]
    for b in by:
        parts.append(rows.select(F.lit(b).alias("scope"), F.col(b).cast("string").alias("level"), "correct"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    out = stacked.groupBy("scope", "level").agg(
        E.count_true(F.col("correct")).alias("successes"), F.count(F.lit(1)).alias("total")
    )
    lo, hi = E.wilson("successes", "total", E.Z95_EXACT, None)
    return out.withColumns({"accuracy": E.rate("successes", "total", None), "ci95_low": lo, "ci95_high": hi})


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test from win and loss counts.

    The largest term of the binomial tail comes from log factorials; the others follow in terms of ratios.
    With m of n losses the term i places further is below exp(-2 i² / (n + 1)), so the sum ends where
    terms fall under 1e-18 of the largest one, whatever the counts.
    """
    n = (wins + losses).cast("double")
    m = F.least(wins, losses).cast("double")

    def log_factorial(x: Column) -> Column:
        """Stirling series at x + 16, brought back by the 15 factors in between."""
        z = x + 16.0
        between = F.lit(0.0)
        for k in range(1, 16):
            between = between + F.log(x + float(k))
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - between

    log_top = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2.0)
    reach = F.least(m, F.ceil(F.sqrt(F.lit(21.0) * (n + 1.0))) + 1).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(reach, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * F.greatest(m - i, F.lit(0.0)) / (n - m + i + 1.0)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(log_top) * tail))


def cluster_contrast(pairs: DataFrame, by: Sequence[str] = (), replicates: int = 10_000, seed: int = 21_499) -> DataFrame:
    """R-06: mean difference with bootstrap interval, wins/losses/ties and the exact sign test."""
    d = pairs.withColumn("value", E.dbl("left_value") - E.dbl("right_value"))
    counts = d.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value"), F.col("n")
    out = counts.groupBy(*by).agg(
        (F.sum(v * n) / F.sum(n)).alias("mean_difference"), F.sum(n).alias("clusters"),
        F.sum(F.when(v > 0, n).otherwise(0)).alias("wins"), F.sum(F.when(v < 0, n).otherwise(0)).alias("losses"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("ties"),
    )
    out = out.withColumn("two_sided_exact_sign_p", sign_test_p(F.col("wins"), F.col("losses")))
    ci = _resample_means(counts, by, replicates, seed, {"ci95_low": 0.025, "ci95_high": 0.975})
    if by:
        return out.join(ci, list(by))
    return attach_row(out, ci.agg(F.max("ci95_low").alias("ci95_low"), F.max("ci95_high").alias("ci95_high")))


def t_interval(df: DataFrame, value: str, by: Sequence[str], seeds: int = 5, quantile: float = E.T95_DF4) -> DataFrame:
    """R-09: interval over five seeds; ``valid`` is false (and the interval NULL) for any other count."""
    g = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    ok = F.col("n") == seeds
    half = F.lit(quantile) * F.col("stdev") / math.sqrt(seeds)
    return g.withColumns(
        {
            "valid": ok,
            "t95_low": F.when(ok, F.col("mean") - half), "t95_high": F.when(ok, F.col("mean") + half),
        }
    )


def uplift(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """R-10: t interval of the per-seed difference of two arms, overall and by family."""
    pairs, _ = paired_join(left, right, keys, value)
    d = pairs.withColumn("difference", F.col("left_value") - F.col("right_value"))
    return t_interval(d, "difference", by)


def mean_ci95(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """R-12: mean with normal interval; one value degenerates, no value gives zeros."""
    g = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.stddev_samp(value).alias("__sd")
    )
    lo, hi = E.mean_ci(F.col("mean"), F.col("__sd"), F.col("n"))
    return g.withColumns({"ci95_lower": lo, "ci95_upper": hi}).drop("__sd")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """R-13: rank correlation with average ranks; NaN for fewer than two rows or no variance.

    Ranks come from distributed value counts, so a group of any size is ranked in parallel.
    The mean of average ranks is known exactly, (n-1)/2, so one pass of centred sums suffices.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("__vx"), F.col(y).cast("double").alias("__vy")
    )
    joint = pairs.groupBy(*by, "__vx", "__vy").agg(F.count(F.lit(1)).alias("__c"))
    rx = O.value_ranks(pairs, by, "__vx").select(
        *by, "__vx", (F.col("below") + (F.col("n") - 1) / 2.0 - (F.col("total") - 1) / 2.0).alias("__rx"), "total"
    )
    ry = O.value_ranks(pairs, by, "__vy").select(
        *by, "__vy", (F.col("below") + (F.col("n") - 1) / 2.0 - (F.col("total") - 1) / 2.0).alias("__ry")
    )
    j = join_back(join_back(joint, rx, [*by, "__vx"]), ry, [*by, "__vy"])
    c = F.col("__c")
    g = j.groupBy(*by).agg(
        F.sum(c).alias("n"), F.sum(c * F.col("__rx") * F.col("__ry")).alias("xy"),
        F.sum(c * F.col("__rx") * F.col("__rx")).alias("xx"), F.sum(c * F.col("__ry") * F.col("__ry")).alias("yy"),
    )
    ok = (F.col("n") >= 2) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return g.select(
        *by, "n",
        F.when(ok, F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).otherwise(F.lit(float("nan"))).alias("spearman"),
    )


def arm_gap(summary: DataFrame, arm: str, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """R-14: win-rate difference of two arms with both intervals side by side."""
    cols = ("win_rate", "win_ci_lower", "win_ci_upper")

    def side(name: str, prefix: str) -> list[Column]:
        return [F.max(F.when(F.col(arm) == name, F.col(c))).alias(f"{prefix}_{c}") for c in cols]

    out = summary.filter(F.col(arm).isin(left, right)).groupBy(*by).agg(*side(left, "left"), *side(right, "right"))
    return out.withColumn("win_rate_delta", F.col("left_win_rate") - F.col("right_win_rate"))


def cross_seed(df: DataFrame, rate: str, by: Sequence[str], minimum: float, threshold: float, needed: int) -> DataFrame:
    """R-15: median rate over seeds at least ``minimum`` and ``needed`` seeds above ``threshold``."""
    return df.groupBy(*by).agg(
        F.percentile(rate, F.lit(0.5)).alias("median_rate"),
        E.count_true(F.col(rate) > threshold).alias("seeds_above"),
        F.count(rate).alias("seeds"),
    ).withColumn("passed", (F.col("median_rate") >= minimum) & (F.col("seeds_above") >= needed))


# ------------------------------------------------------------------ population graph


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node name that can be reached.

    Each round takes the smallest label among neighbours and then the label of that
    label, which halves the remaining distance; lineage is cut by reliable checkpoints.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    ).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(
            F.col("dst").alias("node")
        ).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        step = step.join(root, "component", "left").select(
            "node", "old", F.least("component", "jump").alias("component")
        )
        step = cut_lineage(step)
        changed = step.filter("old <> component").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels


def expected_pairs(players: DataFrame, player: str = "player", blocks: int = 16) -> DataFrame:
    """Every unordered pair of the roster: its size is the square of the roster, as declared.

    Players are dealt to blocks, and pairs of blocks are joined by equality, so blocks × blocks tasks share the pairs.
    """
    roster = players.select(F.col(player).alias("__p")).distinct().filter("__p IS NOT NULL")
    dealt = roster.withColumn("__own", F.pmod(F.xxhash64("__p"), F.lit(blocks)).cast("int")).withColumn(
        "__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = dealt.select(F.col("__p").alias("a"), F.col("__own").alias("__x"), F.col("__other").alias("__y"))
    second = dealt.select(F.col("__p").alias("b"), F.col("__other").alias("__x"), F.col("__own").alias("__y"))
    return first.join(second, ["__x", "__y"]).filter("a < b").select("a", "b")


ROSTER_SHIPPED = 1_000_000


def missing_pairs(spine: DataFrame, seen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b): the pairs a < b of a roster that ``seen`` (keys, a, b) lacks, without listing the roster's square.

    ``spine``: the roster (player) for each value of ``keys``. Players are numbered in order. A player's later partners become bits of
    words, one for 64 numbers, before they are shuffled; words pass in order, and only the numbers of one that is not full, and
    those between two words, are listed. A roster of up to ``ROSTER_SHIPPED`` players goes to the tasks, so that names of pairs are never
    shuffled; a name is looked up by its hash and then compared whole, as Spark looks up a number in a tenth of a text's time.
    """
    keys = list(keys)
    placed = spine.select("player").distinct().filter("player IS NOT NULL").repartitionByRange("player").sortWithinPartitions("player")
    placed = cut_lineage(placed.withColumn("__pos", F.monotonically_increasing_id()))
    roster = cut_lineage(O.row_numbers(placed, [], "__pos", "__i").select("player", "__i"))
    size = roster.count()
    shipped = F.broadcast if size <= ROSTER_SHIPPED else lambda df: df
    names = lambda name, number: shipped(roster.select(F.col("player").alias(name), F.col("__i").alias(number)))
    hashed = lambda name: F.xxhash64(F.col(name).cast("string"))

    def numbered(df: DataFrame, name: str, number: str) -> DataFrame:
        by = shipped(roster.select(F.col("player").alias("__name"), F.col("__i").alias(number), hashed("player").alias("__hash")))
        # Not an equality of names, which would make them a key of the lookup.
        same = (F.col(name) <= F.col("__name")) & (F.col(name) >= F.col("__name"))
        return df.join(by, (hashed(name) == F.col("__hash")) & same).drop("__name", "__hash")

    firsts = names("a", "__x")
    if keys:
        firsts = cut_lineage(spine.select(*keys, F.col("player").alias("a")).distinct().join(firsts, "a"))
        firsts = F.broadcast(firsts) if firsts.count() <= ROSTER_SHIPPED else firsts
    x, y, word = F.col("__x"), F.col("__y"), F.col("__word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), y.bitwiseAND(63).cast("int"))
    started = seen.join(firsts, [*keys, "a"]) if keys else numbered(seen, "a", "__x")
    inside = numbered(started.select(*keys, "__x", "b"), "b", "__y").filter("__x < __y")
    words = inside.groupBy(*keys, "__x", F.shiftright("__y", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    ends = firsts.select(*keys, "__x", F.lit((size >> 6) + 1).cast("bigint").alias("__word"), F.lit(0).cast("bigint").alias("__bits"))
    before = F.coalesce(F.lag("__word").over(Window.partitionBy(*keys, "__x").orderBy("__word")), F.shiftright("__x", 6) - 1)
    spans = words.unionByName(ends).withColumns({"__low": F.greatest((before + 1) * 64, x + 1), "__high": F.least(word * 64 + 63, F.lit(size).cast("bigint"))})
    gaps = spans.filter(F.bit_count("__bits") < F.col("__high") - F.col("__low") + 1).select("*", F.explode(F.sequence("__low", "__high")).alias("__y"))
    held = (y >= word * 64) & (F.col("__bits").bitwiseAND(bit) != 0)
    return gaps.filter(~held).join(names("a", "__x"), "__x").join(names("b", "__y"), "__y").select(*keys, "a", "b")


def connectivity(players: DataFrame, edges: DataFrame, anchor: str) -> tuple[DataFrame, DataFrame]:
    """R-16: (one summary row, violations for missing and unexpected edges).

    ``players``: column player. ``edges``: columns a < b (observed pairs, any multiplicity).
    """
    seen = edges.select("a", "b").distinct()
    missing = missing_pairs(players, seen).withColumn("rule", F.lit("missing_edge"))
    roster = lambda c: players.select(F.col("player").alias(c), F.lit(True).alias(f"__{c}")).distinct()
    extra = seen.join(roster("a"), "a", "left").join(roster("b"), "b", "left").filter("__a IS NULL OR __b IS NULL OR NOT a < b").select(
        "a", "b").withColumn("rule", F.lit("unexpected_edge"))
    gaps = missing.unionByName(extra).select(
        "rule", F.concat_ws("__", "a", "b").alias("key"), F.lit("").alias("detail")
    )
    nodes = players.select(F.col("player").alias("node"))
    inside = seen.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(
        nodes.select(F.col("node").alias("b")), "b", "left_semi"
    )
    labels = components(nodes, inside)
    comp = labels.agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("component_count"),
        E.count_true(F.col("node") == anchor).alias("__anchor"),
    )
    counts = seen.agg(F.count(F.lit(1)).alias("observed_edges"))
    gap_counts = gaps.agg(
        E.count_true(F.col("rule") == "missing_edge").alias("missing_edges"),
        E.count_true(F.col("rule") == "unexpected_edge").alias("unexpected_edges"),
    )
    n = F.col("nodes")
    out = attach_row(attach_row(comp, counts), gap_counts).select(
        "nodes", "observed_edges", (n * (n - 1) / 2).cast("bigint").alias("expected_edges"), "component_count",
        ((F.col("component_count") == 1) & (F.col("__anchor") > 0)).alias("anchor_reaches_all"),
        F.coalesce("missing_edges", F.lit(0)).alias("missing_edges"),
        F.coalesce("unexpected_edges", F.lit(0)).alias("unexpected_edges"),
        ((F.coalesce("missing_edges", F.lit(0)) == 0) & (F.coalesce("unexpected_edges", F.lit(0)) == 0)).alias("complete_graph"),
    )
    return out, gaps


def adjacency(edges: DataFrame) -> DataFrame:
    """R-16: (player, neighbour) in both directions, as rows."""
    return edges.select(F.col("a").alias("player"), F.col("b").alias("neighbour")).unionByName(
        edges.select(F.col("b").alias("player"), F.col("a").alias("neighbour"))
    ).distinct()


def uncertainty(bootstrap: DataFrame, players: DataFrame, replicates: int) -> tuple[DataFrame, DataFrame]:
    """R-17: (intervals, violations): each player and each pairwise difference present, no failure."""
    want_r = players.select(F.lit("rating").alias("kind"), F.col("player").alias("name"))
    # A difference is named by its two players; a name that doesn't fall apart into them matches none. Names are cut apart in a
    # generator, because Spark would repeat the cuts, and what makes the names, in a filter and in every join below it.
    cut = F.struct(F.substring_index("name", "__minus__", 1).alias("a"), F.substring_index("name", "__minus__", -1).alias("b"))
    named = bootstrap.filter("kind = 'difference'").select("name", F.inline(F.array(cut)))
    whole = F.octet_length("a") + F.octet_length("b") + len("__minus__") == F.octet_length("name")
    pairs = missing_pairs(players, named.filter(whole)).select(
        F.lit("difference").alias("kind"), F.concat_ws("__minus__", "a", "b").alias("name")
    )
    want = want_r.unionByName(
        players.limit(1).select(F.lit("seat").alias("kind"), F.lit("seat0_elo").alias("name"))
    )
    single = bootstrap.filter(F.col("kind").isin("rating", "seat")).select("kind", "name")
    missing = want.join(single, ["kind", "name"], "left_anti").unionByName(pairs).select(
        F.lit("missing_interval").alias("rule"), F.concat_ws("/", "kind", "name").alias("key"), F.lit("").alias("detail")
    )
    failed = bootstrap.filter((F.col("kind") == "failure") | (F.col("fits") != replicates)).select(
        F.lit("failed_replicates").alias("rule"), F.concat_ws("/", "kind", "name").alias("key"),
        F.col("fits").cast("string").alias("detail"),
    )
    return bootstrap.filter("kind <> 'failure'"), missing.unionByName(failed)
