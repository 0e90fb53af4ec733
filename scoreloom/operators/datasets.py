"""X-ops: splits, targets, validation and snapshots of labelled decision data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.joins import attach_row, join_back
from scoreloom.operators.calibration import truth_label
from scoreloom.operators.measurements import soft_targets
from scoreloom.operators.sequences import violation

__all__ = [
    "blended_value", "condition_rows", "dataset_violations", "expand_conditions", "fresh_rows", "freeze_prefix",
    "hash_rank", "neutral_condition", "offset_games", "one_hot", "ragged_batch", "resume_plan", "sample_states",
    "soft_targets", "split_by_game", "split_pairs", "uniform_conditions", "value_targets", "verify_snapshot",
    "visit_targets",
]


def hash_rank(text: Column) -> Column:
    """The first 52 bits of SHA-256 as a double, which holds them exactly."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double")


def split_by_game(df: DataFrame, fraction: float = 0.1, seed: int = 0, game: str = "game_index") -> DataFrame:
    """X-01: ``is_validation`` by whole games; max(1, round-half-even(games·fraction)) games.

    Games are ranked by a seeded hash with distributed ranks, so no task holds all games.
    """
    games = df.select(game).distinct().withColumn(
        "__h", hash_rank(F.concat_ws(":", F.lit(str(seed)), F.col(game).cast("string")))
    )
    ranks = O.value_ranks(games, [], "__h").select("__h", "below", "total")
    # Games with equal hashes (52 bits) are ordered by id.
    tie = F.row_number().over(W.partitionBy("__h").orderBy(game))
    wanted = F.greatest(F.lit(1), F.bround(F.col("total") * fraction, 0))
    flags = games.join(ranks, "__h").select(game, ((F.col("below") + tie) <= wanted).alias("is_validation"))
    return df.join(flags, game)


def split_pairs(pairs: DataFrame, suite: str, quotas: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """X-02: (pair -> split by rank of SHA-256(suite + pair) in its family, families of the wrong size).

    The rank limit is the declared family size, which Spark applies before the shuffle.
    """
    size = sum(quotas.values())
    order = W.partitionBy("family").orderBy(F.sha2(F.concat(F.lit(suite), F.col("pair_id")), 256))
    ranked = pairs.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= size)
    split, low = None, 0
    for name, count in quotas.items():
        cond = (F.col("__r") > low) & (F.col("__r") <= low + count)
        split = F.when(cond, name) if split is None else split.when(cond, name)
        low += count
    bad = pairs.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != size).select(
        *violation("family_size", F.col("family"), F.col("n"))
    )
    return ranked.withColumn("split", split).drop("__r"), bad


def fresh_rows(df: DataFrame) -> DataFrame:
    """X-03: rows of the newest round."""
    newest = df.agg(F.max("round").alias("__newest"))
    return attach_row(df, newest).filter(F.col("round") == F.col("__newest")).drop("__newest")


def offset_games(df: DataFrame) -> DataFrame:
    """S-05: game ids made unique over rounds: each round starts after the largest id so far.

    Rounds ascend and offsets accumulate as running max(id)+1; one round is left unchanged.
    """
    tops = df.groupBy("round").agg(F.max("game_index").alias("__top"))
    # One row per round.
    before = W.partitionBy(F.lit(0)).orderBy("round").rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select("round", F.coalesce(F.sum(F.col("__top") + 1).over(before), F.lit(0)).alias("__off"))
    return join_back(df, offsets, ["round"]).withColumn("game_index", F.col("game_index") + F.col("__off")).drop("__off")


def visit_targets(visits: Column | str = "visit_counts", valid: Column | str = "actions_valid") -> Column:
    """X-05: visits inside the mask over their sum (at least 1)."""
    masked = F.zip_with(E.col(valid), E.col(visits), lambda ok, v: F.when(ok > 0, v.cast("double")).otherwise(0.0))
    return E.let(
        masked,
        lambda m: E.let(
            F.struct(m.alias("v"), F.greatest(E.array_sum(m), F.lit(1.0)).alias("s")),
            lambda t: F.transform(t["v"], lambda v: v / t["s"]),
        ),
    )


def one_hot(action: Column | str, width: Column | int) -> Column:
    """X-06: one at the chosen action, zeros elsewhere."""
    last = (F.lit(width) if isinstance(width, int) else width) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == E.col(action), 1.0).otherwise(0.0))


def blended_value(outcome: Column, root: Column) -> Column:
    return 0.5 * outcome + 0.5 * root


def value_targets(df: DataFrame, kind: str) -> DataFrame:
    """X-07: ``value_target`` and ``value_usable`` for 'terminal_outcome', 'root_value' or 'blend'.

    A row without a winner is unusable for the outcome and the blend; a non-finite root value
    for the root and the blend. Range violations are reported by ``dataset_violations``.
    """
    outcome = F.coalesce(truth_label(F.col("winner"), F.col("seat"), "excluded"), F.lit(0.0))
    decided = F.col("winner").isNotNull()
    if kind == "terminal_outcome":
        return df.withColumns({"value_target": outcome, "value_usable": decided})
    ok = E.finite("root_value")
    root = F.when(ok, E.dbl("root_value")).otherwise(0.0)
    if kind == "root_value":
        return df.withColumns({"value_target": root, "value_usable": ok})
    if kind == "blend":
        return df.withColumns({"value_target": blended_value(outcome, root), "value_usable": decided & ok})
    raise ValueError(f"unsupported value target {kind!r}")


def dataset_violations(df: DataFrame, key: Sequence[str], policy: str = "visits", value: str = "terminal_outcome") -> DataFrame:
    """X-08: one violation row per broken rule and row."""
    action = F.col("action").cast("int")
    valid = F.col("actions_valid")
    inside = (action >= 0) & (action < F.size(valid))
    rules = {
        "action_not_legal": ~F.coalesce(inside & (F.get(valid, action) > 0), F.lit(False)),
        "num_valid_mismatch": F.size(F.filter(valid, lambda x: x > 0)) != F.col("num_valid"),
    }
    if policy == "scores":
        s = F.col("scores")
        rules |= {
            "score_shape": F.size(s) != F.size(valid),
            "score_not_finite": ~F.forall(s, lambda x: E.finite(x)),
            "no_scored_action": ~F.exists(s, lambda x: x >= 0),
            "score_mask_mismatch": ~F.forall(F.zip_with(s, valid, lambda a, b: (a >= 0) == (b > 0)), lambda x: x),
        }
    elif policy == "visits":
        v = F.col("visit_counts")
        rules |= {
            "visit_shape": F.size(v) != F.size(valid),
            "visit_invalid": ~F.forall(v, lambda x: E.finite(x) & (x >= 0)),
            "visit_outside_mask": F.exists(F.zip_with(v, valid, lambda a, b: (a > 0) & ~(b > 0)), lambda x: x),
            "no_visits": E.array_sum(v) <= 0,
        }
    if value in ("root_value", "blend"):
        rules["root_value_range"] = E.finite("root_value") & ~F.col("root_value").between(0, 1)
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.select(F.explode(names).alias("rule"), text.alias("key"), F.lit("").alias("detail"))


# ------------------------------------------------------------------ conditions


def expand_conditions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X-09: (one row per decision and condition with re-masked scores and their argmax action, violations).

    ``condition`` is array<struct<index, weight, scores>>; illegal scores become -1 and
    illegal actions never win the argmax (first maximum).
    """
    bad = df.filter(F.coalesce(F.size("condition"), F.lit(0)) < 1).select(
        *violation("invalid_condition_count", F.col("decision_id"))
    )
    masked = F.zip_with("c.scores", "actions_valid", lambda s, ok: F.when(ok > 0, s.cast("double")).otherwise(-1.0))
    ranked = F.zip_with("scores", "actions_valid", lambda s, ok: F.when(ok > 0, s).otherwise(F.lit(float("-inf"))))
    keep = [c for c in df.columns if c not in ("condition", "scores", "action")]
    out = df.select(*keep, F.posexplode("condition").alias("condition_slot", "c")).select(
        *keep, "condition_slot", F.col("c.index").alias("condition_index"), F.col("c.weight").alias("condition_weight"), masked.alias("scores")
    )
    return out.withColumn("action", E.first_argmax(ranked)), bad


def condition_rows(conds: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """X-10: (condition rows with weights normalised by mass and scores clipped to [0,1], violations).

    ``conds``: key..., condition_index, condition_mass, q_values, actions_valid, root_value.
    """
    total = conds.groupBy(*key).agg(F.sum("condition_mass").alias("__t"))
    j = conds.join(total, list(key))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    shape = F.size("q_values") != F.size("actions_valid")
    bad_mass = total.filter(~(E.finite("__t") & (F.col("__t") > 0))).select(*violation("condition_mass", text, F.col("__t")))
    bad_shape = conds.filter(shape).select(*violation("q_shape", text, F.size("q_values")))
    scores = F.zip_with(
        "q_values", "actions_valid",
        lambda q, ok: F.when(ok > 0, F.greatest(F.least(q.cast("double"), F.lit(1.0)), F.lit(0.0))).otherwise(-1.0),
    )
    out = j.filter(~shape & E.finite("__t") & (F.col("__t") > 0)).select(
        *key, "condition_index", (F.col("condition_mass") / F.col("__t")).alias("condition_weight"),
        scores.alias("condition_scores"), F.col("root_value").alias("condition_root_value"),
    )
    return out, bad_mass.unionByName(bad_shape)


def neutral_condition(df: DataFrame) -> DataFrame:
    """X-11: the same rows with condition 0 and weight 1."""
    return df.withColumns({"condition_index": F.lit(0).cast("bigint"), "condition_weight": F.lit(1.0)})


def uniform_conditions(df: DataFrame, k: int) -> DataFrame:
    """X-12: k equal conditions per decision, each with the decision's own scores and weight 1/k."""
    if k < 1:
        raise ValueError("at least one condition is required")
    entry = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct(i.cast("smallint").alias("index"), F.lit(1.0 / k).alias("weight"), F.col("scores").alias("scores")),
    )
    return df.withColumn("condition", entry)


# ------------------------------------------------------------------ snapshots and resume


def freeze_prefix(manifest: DataFrame, files: DataFrame, n: int, run_fingerprint: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X-13: (shard records of the prefix 0..n-1, totals, violations).

    ``manifest``: shard_index, path, sha256, num_games, decisions, game_offset, run_fingerprint;
    ``files``: path, bytes, sha256 (receipts of what is on disk).
    """
    spark = manifest.sparkSession
    want = spark.range(n).select(F.col("id").cast("int").alias("shard_index"))
    idx = F.col("shard_index")
    dup = manifest.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        *violation("duplicate_index", idx, F.col("n"))
    )
    m = want.join(manifest, "shard_index", "left")
    missing = m.filter(F.col("path").isNull()).select(*violation("missing_index", idx))
    f = files.select("path", F.col("bytes").alias("file_bytes"), F.col("sha256").alias("file_sha256"))
    j = m.filter(F.col("path").isNotNull()).join(f, "path", "left")
    rules = [
        F.when(F.col("file_sha256").isNull(), F.lit("missing_file")),
        F.when(F.col("file_sha256") != F.col("sha256"), F.lit("digest_mismatch")),
        F.when(~F.col("run_fingerprint").eqNullSafe(F.lit(run_fingerprint)), F.lit("provenance_mismatch")),
    ]
    broken = j.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), idx.cast("string").alias("key"), F.col("path").alias("detail"))
    totals = j.agg(
        F.count(F.lit(1)).alias("shards"), F.sum("num_games").alias("games"), F.sum("decisions").alias("decisions"),
        F.sum("file_bytes").alias("bytes"),
    )
    records = j.select("shard_index", "path", "game_offset", "num_games", "decisions", "file_bytes", "file_sha256")
    return records, totals, dup.unionByName(missing).unionByName(broken)


def verify_snapshot(manifest: DataFrame, files: DataFrame, expected: DataFrame | None = None, actual: DataFrame | None = None) -> DataFrame:
    """X-14: differences between a manifest and the files, and between identity scalars (V-09)."""
    from scoreloom.operators.comparisons import fingerprint_diff, receipt_diff

    out = receipt_diff(manifest, files)
    if expected is not None and actual is not None:
        diff = fingerprint_diff(expected, actual).select(
            *violation("identity_mismatch", F.col("key"), F.concat_ws("->", F.coalesce("expected", F.lit("~")), F.coalesce("actual", F.lit("~"))))
        )
        out = out.unionByName(diff)
    return out


def resume_plan(chunks: DataFrame, files: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X-15: (chunk -> completed/pending, progress totals, violations).

    ``chunks``: shard_index, shard_name, summary_name, num_games, run_fingerprint; ``files``: name,
    sha256; ``summaries``: shard_index, num_games, decisions, run_fingerprint, sha256.
    """
    f = files.select("name", "sha256")
    expected = chunks.select(F.col("shard_name").alias("name")).unionByName(chunks.select(F.col("summary_name").alias("name")))
    unexpected = f.join(expected, "name", "left_anti").select(*violation("unexpected_file", F.col("name")))
    j = chunks.join(f.select(F.col("name").alias("shard_name"), F.col("sha256").alias("shard_sha")), "shard_name", "left")
    j = j.join(f.select(F.col("name").alias("summary_name"), F.lit(True).alias("has_summary")), "summary_name", "left")
    s = summaries.select(
        "shard_index", F.col("num_games").alias("s_games"), "decisions", F.col("run_fingerprint").alias("s_run"), F.col("sha256").alias("s_sha")
    )
    j = j.join(s, "shard_index", "left")
    shard, summary = F.col("shard_sha").isNotNull(), F.coalesce("has_summary", F.lit(False))
    done = shard & summary
    rules = [
        F.when(shard != summary, F.lit("half_written_pair")),
        F.when(done & ~F.col("s_sha").eqNullSafe(F.col("shard_sha")), F.lit("digest_mismatch")),
        F.when(done & ~F.col("s_games").eqNullSafe(F.col("num_games")), F.lit("num_games_mismatch")),
        F.when(done & ~F.col("s_run").eqNullSafe(F.col("run_fingerprint")), F.lit("fingerprint_mismatch")),
    ]
    bad = j.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("shard_name").alias("key"), F.lit("").alias("detail"))
    plan = j.select("shard_index", F.when(done, "completed").when(shard | summary, "broken").otherwise("pending").alias("state"), "num_games", "decisions")
    progress = plan.agg(
        F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col("decisions"))), F.lit(0)).alias("decisions_completed"),
        F.coalesce(F.sum(F.when(F.col("state") == "completed", F.col("num_games"))), F.lit(0)).alias("games_completed"),
        E.count_true(F.col("state") == "completed").alias("shards_completed"), F.count(F.lit(1)).alias("shards_total"),
    )
    return plan, progress, unexpected.unionByName(bad)


def sample_states(df: DataFrame, rate: float, seed: int, key: Sequence[str], interaction: Sequence[str], instants: Sequence[str]) -> DataFrame:
    """X-16: hash-sampled decisions with more than one option, with their bucketing features.

    Permanents are array<struct<power, toughness>>; the board counts non-negative parts only.
    """
    u = hash_rank(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])) / float(1 << 52)

    def board(c: str) -> Column:
        return F.aggregate(
            c, F.lit(0.0),
            lambda acc, p: acc + F.greatest(p["power"], F.lit(0)) + F.greatest(p["toughness"], F.lit(0)),
        )

    def holds(names: Sequence[str]) -> Column:
        return F.when(F.arrays_overlap("hand", F.array(*[F.lit(n) for n in names])), 1.0).otherwise(0.0)

    kept = df.filter((F.col("num_valid") > 1) & (u < rate))
    return kept.select(
        *key, "seat", "num_valid", (board("own_permanents") - board("other_permanents")).alias("board_adv"),
        (E.dbl("own_life") - E.dbl("other_life")).alias("life_adv"), holds(interaction).alias("holding_interaction"),
        holds(instants).alias("holding_instant"), E.dbl("turn").alias("turn"),
        truth_label(F.col("winner"), F.col("seat"), "half").alias("won"),
    )


def ragged_batch(df: DataFrame, batch: Sequence[str], order: str, items: str) -> DataFrame:
    """X-17: start and end offsets of each sample's items in its batch's concatenated list."""
    sized = df.withColumn("size", F.size(items))
    run = O.running(sized, batch, order, {"end_offset": F.col("size").cast("bigint")})
    return run.withColumn("start_offset", F.col("end_offset") - F.col("size"))
