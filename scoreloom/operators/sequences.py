"""W-ops: ordered computations, episodes, landmark ranking, rewards and chains.

Unbounded ordered passes go through ``functions.ordered`` so that one long sequence is
spread over tasks. Plain windows remain only where a rank limit or a contract bounds the
partition.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.canonical import canonical_text
from scoreloom.functions.joins import attach_row, join_back

# Decision kind by action space (anything else is 'other').
KIND_BY_ACTION_SPACE = {
    "PRIORITY": "priority",
    "CHOOSE_TARGET": "targeting",
    "DECLARE_ATTACKER": "attack",
    "DECLARE_BLOCKER": "block",
}
# Weight of a presentation event by importance.
IMPORTANCE_WEIGHT = {"ambient": 0, "normal": 1, "emphasized": 4, "critical": 8}
# Order in which landmark reasons are listed.
REASON_ORDER = (
    "priority_commitment", "priority_response", "target_selection", "attack_declaration",
    "block_declaration", "branching_choice", "public_semantic_impact",
)
IMPORTANCE_CAP, BREADTH_CAP, EPISODE_CAP = 32, 16, 16


def violation(rule: str, key: Column, detail: Column | None = None) -> list[Column]:
    """The three columns of a violation row."""
    return [
        F.lit(rule).alias("rule"), key.cast("string").alias("key"),
        (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
    ]


def decision_kind(action_space: Column | str) -> Column:
    """F-03: decision kind of an action space."""
    c = E.col(action_space)
    out = None
    for space, kind in KIND_BY_ACTION_SPACE.items():
        out = F.when(c == space, kind) if out is None else out.when(c == space, kind)
    return out.otherwise("other")


def select_roots(decisions: DataFrame, warmup: int, measured: int) -> tuple[DataFrame, DataFrame]:
    """W-01: (first warmup+measured decisions in corpus order with root ids, violations when too few).

    The order-and-limit is a distributed top-k; only the requested rows reach the digest.
    """
    need = warmup + measured
    order = ["deal_seed", "leg", "match_id", "ordinal"]
    top = decisions.orderBy(*order).limit(need)
    pair = F.array(F.to_json(F.struct(F.col("trace_sha256").alias("v"))), F.col("revision").cast("string"))

    @F.pandas_udf("string")
    def root_text(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda p: canonical_text([json.loads(p[0])["v"], int(p[1])]))

    # At most warmup+measured rows by construction.
    ranked = top.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    roots = ranked.select(
        "*", F.sha2(root_text(pair), 256).alias("root_id"),
        F.when(F.col("position") <= warmup, "warmup").otherwise("measured").alias("phase"),
    )
    short = top.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < need).select(
        *violation("short_corpus", F.lit("roots"), F.col("n"))
    )
    return roots, short


def combat_episodes(decisions: DataFrame, replay: str = "replay_id") -> DataFrame:
    """W-02: attack/block decisions numbered by episode; any other decision ends an episode."""
    d = O.islands(decisions, [replay], "ordinal", ["viewer", "turn", "step", "kind"], "episode")
    return d.filter(F.col("kind").isin("attack", "block"))


def _weights(presentation: str) -> Column:
    w = F.create_map(*[F.lit(x) for kv in IMPORTANCE_WEIGHT.items() for x in kv])
    return F.aggregate(
        presentation, F.lit(0), lambda acc, e: acc + F.coalesce(F.try_element_at(w, e["importance"]), F.lit(0))
    )


def _reasons(pairs: Sequence[tuple[str, Column]]) -> Column:
    by_name = dict(pairs)
    return F.array_compact(
        F.array(*[F.when(F.coalesce(by_name[r], F.lit(False)), F.lit(r)) for r in REASON_ORDER if r in by_name])
    )


def landmark_candidates(decisions: DataFrame, replay: str = "replay_id") -> DataFrame:
    """W-03: candidate landmarks of single decisions and combat episodes.

    ``decisions``: replay, ordinal, decision_id, viewer, turn, step, kind, automatic, verb,
    event_cursor, n_offers, stack_reference, presentation array<struct<importance,...>>.
    """
    impact = F.exists("presentation", lambda e: e["importance"].isin("emphasized", "critical"))
    d = decisions.withColumns({"imp": _weights("presentation"), "impact": F.coalesce(impact, F.lit(False))})
    live = ~F.coalesce("automatic", F.lit(False)) & (F.col("n_offers") > 1)
    commit = F.col("verb") != "pass_priority"
    single = d.filter(live & F.col("kind").isin("priority", "targeting"))
    priority = F.col("kind") == "priority"
    single = single.filter(~priority | commit | F.col("stack_reference")).select(
        replay, "decision_id", "event_cursor", F.col("kind").alias("family"),
        F.least("imp", F.lit(IMPORTANCE_CAP)).cast("bigint").alias("importance"),
        F.when(priority & commit, 1).otherwise(0).cast("bigint").alias("deliberate"),
        F.least("n_offers", F.lit(BREADTH_CAP)).cast("bigint").alias("breadth"),
        F.lit(1).cast("bigint").alias("episode_size"),
        _reasons(
            [
                ("priority_commitment", priority & commit), ("priority_response", priority & F.col("stack_reference")),
                ("target_selection", F.col("kind") == "targeting"), ("branching_choice", F.lit(True)),
                ("public_semantic_impact", F.col("impact")),
            ]
        ).alias("reasons"),
    )
    members = combat_episodes(d, replay)
    first = F.struct("decision_id", "event_cursor", "kind", "automatic", "n_offers")
    ep = members.groupBy(replay, "episode").agg(
        F.min_by(first, "ordinal").alias("h"),
        # Every member's own weight is capped before the episode sum is.
        F.sum(F.least("imp", F.lit(IMPORTANCE_CAP))).alias("imp"), F.max("impact").alias("impact"),
        F.sum("n_offers").alias("offers"), F.count(F.lit(1)).alias("size"),
    )
    combat = ep.filter(~F.coalesce("h.automatic", F.lit(False)) & (F.col("h.n_offers") > 1)).select(
        replay, F.col("h.decision_id").alias("decision_id"), F.col("h.event_cursor").alias("event_cursor"),
        F.lit("combat").alias("family"),
        F.least("imp", F.lit(IMPORTANCE_CAP)).cast("bigint").alias("importance"),
        F.lit(0).cast("bigint").alias("deliberate"),
        F.least("offers", F.lit(BREADTH_CAP)).cast("bigint").alias("breadth"),
        F.least("size", F.lit(EPISODE_CAP)).cast("bigint").alias("episode_size"),
        _reasons(
            [
                ("attack_declaration", F.col("h.kind") == "attack"), ("block_declaration", F.col("h.kind") == "block"),
                ("branching_choice", F.lit(True)), ("public_semantic_impact", F.col("impact")),
            ]
        ).alias("reasons"),
    )
    return single.unionByName(combat)


LANDMARK_ORDER = ("importance", "deliberate", "breadth", "episode_size")


def landmark_order() -> list[Column]:
    return [F.col(c).desc() for c in LANDMARK_ORDER] + [F.col("event_cursor"), F.col("decision_id")]


def select_landmarks(
    candidates: DataFrame, group: Sequence[str], family: str = "family", limit: int = 7, quota: int = 3,
    fill: int = 3, order: Sequence[Column] | None = None, key: str = "decision_id",
) -> DataFrame:
    """W-04: best of each family, then up to ``limit`` with at most ``quota`` per family, then fill.

    A greedy pass in one global order equals: keep the first ``quota`` per family (a
    rank limit that Spark applies before the shuffle), take each family's first, then the
    rest in global order up to the limit. The fill step can only apply when quota < fill.
    """
    order = list(order) if order is not None else landmark_order()
    in_family = W.partitionBy(*group, family).orderBy(*order)
    kept = candidates.withColumn("__fr", F.row_number().over(in_family)).filter(F.col("__fr") <= quota)
    # From here a group has at most quota × families rows.
    whole = W.partitionBy(*group)
    later = W.partitionBy(*group, F.col("__fr") > 1).orderBy(*order)
    kept = kept.withColumns(
        {
            "__families": F.sum(F.when(F.col("__fr") == 1, 1).otherwise(0)).over(whole),
            "__lr": F.row_number().over(later),
        }
    )
    chosen = kept.filter((F.col("__fr") == 1) | (F.col("__lr") <= F.lit(limit) - F.col("__families")))
    chosen = chosen.drop("__fr", "__families", "__lr")
    if quota < fill:
        top = candidates.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(
            F.col("__r") <= 2 * fill
        ).drop("__r")
        extra = top.join(chosen.select(*group, key), [*group, key], "left_anti")
        both = chosen.withColumn("__phase", F.lit(0)).unionByName(extra.withColumn("__phase", F.lit(1)))
        size = F.sum(F.when(F.col("__phase") == 0, 1).otherwise(0)).over(whole)
        rank_extra = F.row_number().over(W.partitionBy(*group, "__phase").orderBy(*order))
        both = both.withColumns({"__n": size, "__r": rank_extra})
        chosen = both.filter((F.col("__phase") == 0) | (F.col("__r") <= F.lit(fill) - F.col("__n"))).drop("__phase", "__n", "__r")
    return chosen.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def rolling_gate(
    history: DataFrame, by: Sequence[str], window: int, minimum: int, numerator: int, denominator: int,
    acknowledged: str | None = None,
) -> DataFrame:
    """W-05: gate over the last ``window`` admissions of each history.

    The share is compared in integers: kernel_changing·denominator > n·numerator.
    ``acknowledged`` is a column with the sequence a redesign response acknowledges (or NULL).
    """
    last = W.partitionBy(*by).orderBy(F.col("sequence").desc())
    recent = history.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= window)
    ack = F.max(acknowledged) if acknowledged else F.lit(None).cast("bigint")
    g = recent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("denominator"),
        E.count_true(F.col("classification") == "content_only").alias("content_only"),
        E.count_true(F.col("classification") == "kernel_changing").alias("kernel_changing"),
        F.max("sequence").alias("latest_sequence"), F.min("sequence").alias("first_sequence"),
        ack.alias("__ack"),
    )
    n = F.col("denominator")
    breached = F.when(n >= minimum, F.col("kernel_changing") * denominator > n * numerator)
    status = (
        F.when(n < minimum, "insufficient_history")
        .when(~breached, "within_threshold")
        .when(F.col("__ack").eqNullSafe(F.col("latest_sequence")), "breached_acknowledged")
        .otherwise("breached_unacknowledged")
    )
    return g.withColumns({"threshold_breached": breached, "gate_status": status}).drop("__ack")


def sequence_violations(df: DataFrame, key: Sequence[str], seq: str, start: int = 1) -> DataFrame:
    """W-06: sequences must be contiguous from ``start``: duplicates, gaps and wrong start."""
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    uniq = df.groupBy(*key, seq).agg(F.count(F.lit(1)).alias("n"))
    dup = uniq.filter("n > 1").select(*violation("duplicate_sequence", text, F.col(seq)))
    prev = O.neighbour(uniq, key, seq, {"__p": seq})
    bad_start = prev.filter(F.col("__p").isNull() & (F.col(seq) != start)).select(*violation("wrong_start", text, F.col(seq)))
    gap = prev.filter(F.col(seq) - F.col("__p") > 1).select(*violation("gap", text, F.col(seq)))
    return dup.unionByName(bad_start).unionByName(gap)


def cursor_violations(df: DataFrame, key: Sequence[str], ordinal: str, cursor: str, strict: bool = False) -> DataFrame:
    """W-06: cursors must not decrease (or must increase) in ordinal order."""
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    prev = O.neighbour(df, key, ordinal, {"__p": cursor})
    bad = F.col(cursor) <= F.col("__p") if strict else F.col(cursor) < F.col("__p")
    return prev.filter(bad).select(*violation("cursor_backwards", text, F.col(ordinal)))


def unique_violations(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """W-06: combinations that occur more than once."""
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*violation(rule, text, F.col("n")))


def unsigned_digest(event_json: Column, hash_field: str = "event_sha256") -> Column:
    """Digest of an event's canonical text without its own hash field."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return None
            if not isinstance(value, dict):
                return None
            value.pop(hash_field, None)
            return canonical_text(value)

        return texts.map(one)

    return F.sha2(strip(event_json), 256)


def verify_chain(
    events: DataFrame, ledger: str = "ledger_id", ordinal: str = "ordinal", text: str = "event",
    final_kind: str | None = "complete", resources: Sequence[str] = (), sequence_start: int | None = None,
) -> DataFrame:
    """W-07: violations of a hash chain: link to the previous hash, own digest, last kind,
    and optionally sequence numbers and finite non-negative resource values."""
    g = lambda path: F.get_json_object(text, "$." + path)
    d = events.select(
        ledger, ordinal, g("event_sha256").alias("h"), g("previous_event_sha256").alias("p"), g("kind").alias("k"),
        g("sequence").alias("s"), unsigned_digest(F.col(text)).alias("own"), (F.try_parse_json(text).isNull()).alias("broken"),
        *[F.expr(f"try_cast(get_json_object({text}, '$.resources.{r}') AS double)").alias(f"r_{r}") for r in resources],
    )
    d = O.neighbour(d, [ledger], ordinal, {"ph": "h", "po": ordinal})
    key = F.concat_ws("/", F.col(ledger).cast("string"), F.col(ordinal).cast("string"))
    rules = [
        F.when(F.col("broken"), F.lit("invalid_json")),
        F.when(~F.col("p").eqNullSafe(F.col("ph")), F.lit("chain_mismatch")),
        F.when(~F.col("h").eqNullSafe(F.col("own")), F.lit("digest_mismatch")),
    ]
    if sequence_start is not None:
        place = F.col(ordinal) + (sequence_start)
        rules.append(F.when(~F.col("s").cast("bigint").eqNullSafe(place.cast("bigint")), F.lit("sequence_mismatch")))
    for r in resources:
        ok = E.finite(f"r_{r}") & (F.col(f"r_{r}") >= 0)
        rules.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"invalid_{r}")))
    rows = d.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), key.alias("key"), F.lit("").alias("detail"))
    if final_kind is None:
        return rows
    tail = d.groupBy(ledger).agg(F.max_by("k", ordinal).alias("k"))
    open_end = tail.filter(~F.col("k").eqNullSafe(F.lit(final_kind))).select(*violation("incomplete", F.col(ledger), F.coalesce("k", F.lit(""))))
    return rows.unionByName(open_end)


def rank_methods(methods: DataFrame, tie_order: dict[str, int], score: str = "mean_anchor_score") -> DataFrame:
    """W-08: methods by rating, anchor score, head-to-head, correct count (all descending), p95 and tie order.

    ``separation`` is the smallest score margin of the winner over any other method. The table
    has one row per declared method, so a single window is bounded by the declaration.
    """
    ties = F.create_map(*[F.lit(x) for kv in tie_order.items() for x in kv])
    order = [
        F.col("mean_rating").desc(), F.col("mean_anchor_score").desc(), F.col("head_to_head_score").desc(),
        F.col("competency_correct").desc(), F.col("mean_p95_seconds"), F.try_element_at(ties, F.col("arm")),
    ]
    m = methods.filter(F.col("arm").isin(*tie_order))
    ranked = m.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    best = ranked.agg(
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("__w"), F.max(F.when(F.col("rank") > 1, F.col(score))).alias("__o")
    )
    return attach_row(ranked, best).withColumn("separation", F.col("__w") - F.col("__o")).drop("__w", "__o")


def world_rank(beliefs: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """W-09: 1 + number of strictly more probable worlds in the same space; NULL at zero mass."""
    positive = beliefs.filter(F.col(p) > 0)
    ranks = O.value_ranks(positive, keys, p).select(
        *keys, F.col(p).alias("__p"), (F.col("total") - F.col("below") - F.col("n") + 1).alias("rank")
    )
    b = beliefs.withColumn("__p", F.when(F.col(p) > 0, F.col(p).cast("double")))
    return join_back(b, ranks, [*keys, "__p"], "left").drop("__p")


def top_worlds(df: DataFrame, keys: Sequence[str], k: int, weight: str = "weight", index: str = "world_index") -> DataFrame:
    """W-10: the k heaviest worlds per space, ties by index; the rank limit runs before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(index))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_action(values: Column | str) -> Column:
    """W-11: struct (top index, margin to the second, unique); first index wins ties."""
    v = E.col(values)
    return E.let(
        F.struct(E.doubles(v).alias("v"), F.sort_array(E.doubles(v), asc=False).alias("s")),
        lambda t: F.when(
            F.size(t["s"]) >= 2,
            F.struct(
                (F.array_position(t["v"], t["s"][0]) - 1).cast("int").alias("index"),
                (t["s"][0] - t["s"][1]).alias("margin"), (t["s"][0] != t["s"][1]).alias("unique"),
            ),
        ),
    )


def recommendation_flip(df: DataFrame, key: Sequence[str], condition: str, left: str, right: str, values: str) -> DataFrame:
    """W-11: top actions of two conditions side by side and whether they differ."""
    t = top_action(values)
    g = df.filter(F.col(condition).isin(left, right)).select(*key, condition, t.alias("t")).groupBy(*key).agg(
        F.max(F.when(F.col(condition) == left, F.col("t"))).alias("l"),
        F.max(F.when(F.col(condition) == right, F.col("t"))).alias("r"),
    )
    return g.filter(F.col("l").isNotNull() & F.col("r").isNotNull()).select(
        *key, F.col("l.index").alias("left_top"), F.col("r.index").alias("right_top"),
        F.col("l.margin").alias("left_margin"), F.col("r.margin").alias("right_margin"),
        F.col("l.unique").alias("left_unique"), F.col("r.unique").alias("right_unique"),
        (F.col("l.index") != F.col("r.index")).alias("flip"),
    )


def gae(rollouts: DataFrame, gamma: float, lam: float, env: Sequence[str] = ("env",), t: str = "t") -> DataFrame:
    """W-12: generalised advantages and returns per environment.

    ``done[t]`` says that step t starts a new episode, so step t does not bootstrap from
    t+1 when done[t+1]; the last step uses ``next_value`` and ``next_done``. The backward
    recurrence is an affine scan over chunks, so one long environment is not one task.
    """
    d = O.neighbour(rollouts, env, t, {"__nv": "value", "__nd": "done"}, "lead")
    nv = F.coalesce("__nv", "next_value")
    live = 1.0 - F.coalesce("__nd", "next_done").cast("double")
    d = d.withColumns(
        {"__mult": F.lit(gamma * lam) * live, "__add": F.col("reward") + F.lit(gamma) * nv * live - F.col("value")}
    )
    out = O.affine_scan_back(d, env, t, "__mult", "__add", "advantage")
    return out.withColumn("returns", F.col("advantage") + F.col("value")).drop("__nv", "__nd", "__mult", "__add")


def normalise(df: DataFrame, value: str, by: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """W-13: centred and scaled by the sample deviation; unscaled when it is missing or tiny."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    j = join_back(df, s, by) if by else attach_row(df, s)
    centred = F.col(value) - F.col("__m")
    flat = F.col("__s").isNull() | F.isnan("__s") | (F.col("__s") < eps)
    return j.withColumn(f"{value}_normalised", F.when(flat, centred).otherwise(centred / (F.col("__s") + eps))).drop("__m", "__s")


def progress_reward(df: DataFrame, key: Sequence[str], t: str, weights: dict[str, float]) -> DataFrame:
    """W-14: weighted positive increases of counters (a column named ``-x`` rewards decreases of x)."""
    names = {n.lstrip("-"): n for n in weights}
    d = O.neighbour(df, key, t, {f"__p_{c}": c for c in names})
    total = F.lit(0.0)
    for c, n in names.items():
        diff = F.col(f"__p_{c}") - F.col(c) if n.startswith("-") else F.col(c) - F.col(f"__p_{c}")
        total = total + F.lit(weights[n]) * F.coalesce(F.greatest(diff, F.lit(0)), F.lit(0))
    return d.withColumn("progress_reward", total).drop(*[f"__p_{c}" for c in names])


def potential(weights: dict[str, float], lands=("own_lands", "other_lands"), creatures=("own_creatures", "other_creatures"),
              life=("own_life", "other_life")) -> Column:
    """Board potential: weighted differences, life difference in units of twenty."""
    def diff(p):
        return F.col(p[0]).cast("double") - F.col(p[1])
    return (
        weights.get("land", 0.0) * diff(lands) + weights.get("creature", 0.0) * diff(creatures)
        + weights.get("life", 0.0) * diff(life) / 20.0
    )


def potential_reward(df: DataFrame, key: Sequence[str], t: str, phi: Column, gamma: float) -> DataFrame:
    """W-15: gamma·phi(next) - phi(now); phi of a finished game is 0. Rows without a successor are dropped."""
    d = O.neighbour(df.withColumn("__phi", phi), key, t, {"__np": "__phi", "__over": "game_over"}, "lead")
    nxt = F.when(F.col("__over"), 0.0).otherwise(F.col("__np"))
    return d.filter(F.col("__np").isNotNull()).withColumn(
        "potential_reward", F.lit(gamma) * nxt - F.col("__phi")
    ).drop("__phi", "__np", "__over")


def head_per_game(df: DataFrame, game: Sequence[str], order: Sequence[str], k: int = 8) -> DataFrame:
    """W-16: first k rows per game."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*game).orderBy(*order))).filter(F.col("position") <= k)


def run_phases(evals: DataFrame, run: str = "run_id") -> DataFrame:
    """W-17: per run the id of the first baseline, the last final (else the last evaluation), and
    the number of checkpoints; order is (step, id)."""
    at = F.struct("step", "id")
    kind = F.col("kind")
    return evals.groupBy(run).agg(
        F.min_by(F.when(kind == "baseline", F.col("id")), F.when(kind == "baseline", at)).alias("baseline_id"),
        F.coalesce(
            F.max_by(F.when(kind == "final", F.col("id")), F.when(kind == "final", at)), F.max_by("id", at)
        ).alias("final_id"),
        E.count_true(kind == "checkpoint").alias("checkpoints"),
        F.max(kind == "final").alias("has_final_row"),
    )


def rss_peak(samples: DataFrame, declared: DataFrame, key: Sequence[str] = ("run",)) -> tuple[DataFrame, DataFrame]:
    """W-18: (peak, count and wall per run, violations).

    ``samples``: ordinal, offset_seconds, rss_bytes; ``declared``: peak_bytes, sample_count, wall_seconds.
    """
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    g = samples.groupBy(*key).agg(
        F.max("rss_bytes").alias("peak"), F.count(F.lit(1)).alias("n"), F.max("offset_seconds").alias("last")
    )
    row_bad = samples.filter((F.col("rss_bytes") < 0) | ~E.finite("offset_seconds")).select(*violation("invalid_sample", text, F.col("ordinal")))
    back = O.neighbour(samples, key, "ordinal", {"__p": "offset_seconds"}).filter(
        F.col("offset_seconds") < F.col("__p")
    ).select(*violation("offset_backwards", text, F.col("ordinal")))
    j = declared.join(g, list(key), "left")
    wall_ok = E.finite("wall_seconds") & (F.col("wall_seconds") > 0) & (F.col("wall_seconds") >= F.coalesce("last", F.lit(0.0)))
    rules = [
        F.when(F.col("peak").isNull(), F.lit("no_samples")),
        F.when(F.col("peak") != F.col("peak_bytes"), F.lit("peak_mismatch")),
        F.when(F.col("n") != F.col("sample_count"), F.lit("count_mismatch")),
        F.when(~wall_ok, F.lit("invalid_wall")),
    ]
    declared_bad = j.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), text.alias("key"), F.lit("").alias("detail"))
    out = j.select(*key, F.col("peak").alias("peak_bytes"), F.col("n").alias("sample_count"), "wall_seconds")
    return out, row_bad.unionByName(back).unionByName(declared_bad)


