"""V-ops: row invariants and re-derivation checks as violation tables (rule, key, detail).

An empty table means that the input passed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions.canonical import canonical_sha256
from scoreloom.functions.joins import attach_row, join_back
from scoreloom.operators.sequences import REASON_ORDER, violation
from scoreloom.session import cut_lineage


def check_rows(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One violation row per row and broken rule; a condition that is not true is broken."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(names).alias("rule"), key.cast("string").alias("key"), F.lit("").alias("detail"))


def violations_match_rows(matches: DataFrame, key: str = "match_id") -> DataFrame:
    """V-01: invariants of a match row."""
    cell = F.concat_ws("__", F.least("player_a", "player_b"), F.greatest("player_a", "player_b"))
    score = F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("player_a_seat"), 1.0).otherwise(0.0)
    path = F.col("trace_path")
    parts = F.split(path, "/")
    return check_rows(
        matches, F.col(key),
        {
            "distinct_players": F.col("player_a") != F.col("player_b"),
            "cell_identity": F.col("cell_id") == cell,
            "leg_is_seat": F.col("player_a_seat") == F.col("leg"),
            "score_matches_winner": F.col("score_a") == score,
            "truncation_reason": F.col("truncated") == (F.col("termination_reason") == "truncated"),
            "terminal": F.col("truncated") | F.col("terminated"),
            "trace_digest": F.col("trace_sha256") == F.col("game_trace_sha256"),
            "relative_path": ~F.startswith(path, F.lit("/")) & ~F.array_contains(parts, ".."),
            "path_of_cell": path == F.concat(F.lit("traces/"), F.col("cell_id"), F.lit(".commands.jsonl.gz")),
        },
    )


CHECKPOINT_FIELDS = ("checkpoint_sha256", "checkpoint_bytes", "parameter_count", "training_seed", "artifact_id")


def violations_registrations(regs: DataFrame, key: str = "player_id") -> DataFrame:
    """V-02: code players name a source and no checkpoint; checkpoint players the full identity, no alias."""
    code = F.col("runner_kind") == "code"
    none, every = F.lit(True), F.lit(True)
    for c in CHECKPOINT_FIELDS:
        none = none & F.col(c).isNull()
        every = every & F.col(c).isNotNull()
    source = F.coalesce("source_sha256", F.lit("")) != ""
    alias = F.contains(F.lower(F.coalesce("artifact_id", F.lit(""))), F.lit("latest"))
    return check_rows(
        regs, F.col(key),
        {
            "code_identity": ~code | (source & none),
            "code_is_production": ~code | (F.col("evidence_class") == "production"),
            "checkpoint_identity": code | every,
            "checkpoint_without_source": code | F.col("source_sha256").isNull(),
            "mutable_alias": code | ~alias,
        },
    )


def violations_integrity(matches: DataFrame, key: str = "match_id") -> DataFrame:
    """V-03: all integrity counters zero and the replay passed."""
    return check_rows(
        matches, F.col(key),
        {
            "integrity_counter": ~F.exists(F.map_values("integrity"), lambda x: x != 0),
            "replay_passed": F.col("replay_passed"),
        },
    )


def violations_rederived(stored: DataFrame, derived: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """V-04: stored summaries that differ from recomputed ones (NULL equals NULL), or have no partner."""
    s = stored.select(*keys, F.struct(*values).alias("s"))
    d = derived.select(*keys, F.struct(*values).alias("d"))
    j = s.join(d, list(keys), "full_outer")
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    types = dict(stored.dtypes)
    rules = [F.when(F.col("s").isNull(), F.lit("not_stored")), F.when(F.col("d").isNull(), F.lit("not_derivable"))]
    for v in values:
        a, b = F.col(f"s.{v}"), F.col(f"d.{v}")
        same = a.eqNullSafe(b)
        if tolerance and types[v] in ("double", "float"):
            same = same | (F.abs(a - b) <= tolerance)
        rules.append(F.when(F.col("s").isNotNull() & F.col("d").isNotNull() & ~F.coalesce(same, F.lit(False)), F.lit(v)))
    return j.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), text.alias("key"), F.lit("").alias("detail"))


def violations_matched_corpora(samples: DataFrame, player: str = "player_id") -> DataFrame:
    """V-05: every player must have the same root id at every position.

    Compared position by position, so no player's sequence is collected.
    """
    n = samples.select(player).distinct().agg(F.count(F.lit(1)).alias("__n"))
    g = samples.groupBy("position").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(player).alias("players"), F.min("root_id").alias("lo"), F.max("root_id").alias("hi")
    )
    j = attach_row(g, n)
    return check_rows(
        j, F.col("position"),
        {"same_root": F.col("lo") == F.col("hi"), "all_players": (F.col("players") == F.col("__n")) & (F.col("rows") == F.col("__n"))},
    )


def violations_decision_index(decisions: DataFrame, landmarks: DataFrame, identity: Mapping[str, str]) -> DataFrame:
    """V-06: bindings of indexed decisions and landmarks.

    ``decisions``: decision_id, match_id, content_hash, asset_manifest_hash, viewer, prompt_actor, prompt_id,
    offer struct<id,actor>, offers array<struct<id,actor>>, revision, automatic, opponent_hand array, played
    struct<match_id,expected_revision,prompt_id,offer_id>. ``landmarks``: decision_id, reasons array<string>.
    """
    d = F.col
    rows = check_rows(
        decisions, d("decision_id"),
        {
            "match": d("match_id") == identity["match_id"],
            "content_pack": (d("content_hash") == identity["content_hash"]) & (d("asset_manifest_hash") == identity["asset_manifest_hash"]),
            "opponent_hand": F.coalesce(F.size("opponent_hand"), F.lit(0)) == 0,
            "viewer_binding": (d("prompt_actor") == d("viewer")) & (d("offer.actor") == d("viewer")),
            "offer_in_frame": F.exists("offers", lambda o: o == d("offer")),
            "played_command": (d("played.match_id") == d("match_id")) & (d("played.expected_revision") == d("revision"))
            & (d("played.prompt_id") == d("prompt_id")) & (d("played.offer_id") == d("offer.id")),
        },
    )
    order = F.array(*[F.lit(r) for r in REASON_ORDER])
    sorted_reasons = F.filter(order, lambda r: F.array_contains(d("reasons"), r))
    ref = decisions.select("decision_id", (~d("automatic") & (F.size("offers") > 1)).alias("open"))
    j = landmarks.join(ref, "decision_id", "left")
    marks = check_rows(
        j, d("decision_id"),
        {"landmark_known": d("open").isNotNull(), "landmark_not_forced": F.coalesce("open", F.lit(True)),
         "landmark_reasons": (F.size("reasons") > 0) & (d("reasons") == sorted_reasons)},
    )
    dup = landmarks.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*violation("landmark_repeated", d("decision_id"), d("n")))
    return rows.unionByName(marks).unionByName(dup)


def violations_workers(workers: DataFrame, cells: DataFrame) -> DataFrame:
    """V-07: worker topology, driver, seed, shape and the expected simulations W·A·L·R.

    ``cells``: cell_id, workers, driver, root_seed, shape, actors_per_worker, worlds, rollouts_per_world, whole.
    """
    c = cells.select(*[F.col(x).alias(x if x == "cell_id" else f"c_{x}") for x in cells.columns])
    j = workers.join(c, "cell_id", "left")
    text = F.concat_ws("/", "cell_id", F.col("repeat").cast("string"), F.col("worker").cast("string"))
    want = F.col("c_actors_per_worker") * F.col("action_count") * F.col("c_worlds") * F.col("c_rollouts_per_world")
    rows = check_rows(
        j, text,
        {
            "declared_cell": F.col("c_driver").isNotNull(), "driver": F.col("driver") == F.col("c_driver"),
            "root_seed": F.col("root_seed") == F.col("c_root_seed"), "shape": F.col("shape") == F.col("c_shape"),
            "simulations": ~F.coalesce("c_whole", F.lit(False)) | (F.col("simulations") == want),
        },
    )
    topo = workers.groupBy("cell_id", "repeat").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("worker").alias("k"), F.min("worker").alias("lo"), F.max("worker").alias("hi")
    ).join(c.select("cell_id", "c_workers"), "cell_id")
    w = F.col("c_workers")
    ok = (F.col("n") == w) & (F.col("k") == w) & (F.col("lo") == 0) & (F.col("hi") == w - 1)
    return rows.unionByName(check_rows(topo, F.concat_ws("/", "cell_id", F.col("repeat").cast("string")), {"topology": ok}))


def violations_workload(games: DataFrame, commands_per_game: int | None, simulations: int, max_decisions: int, key: str = "game_id") -> DataFrame:
    """V-08: commands, terminal state, decision count and traversals = decisions × simulations."""
    d = F.col("decisions")
    rules = {
        "terminal": F.col("terminal"), "decision_count": (d > 0) & (d <= max_decisions),
        "rows_match_decisions": F.col("rows") == d, "traversals": F.col("traversals") == d * simulations,
    }
    if commands_per_game is not None:
        rules["commands"] = F.col("commands") == commands_per_game
    return check_rows(games, F.col(key), rules)


def violations_contract(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """V-09: scalars of a manifest that differ from the contract (key, value)."""
    from scoreloom.operators.comparisons import fingerprint_diff

    return fingerprint_diff(expected, actual).select(
        *violation("contract_mismatch", F.col("key"), F.concat_ws("->", F.coalesce("expected", F.lit("~")), F.coalesce("actual", F.lit("~"))))
    )


def violations_calibration_points(points: DataFrame, key: str = "point_id") -> DataFrame:
    """V-10: truth inside both supports, finite log losses and ratio."""
    return check_rows(
        points, F.col(key),
        {
            "truth_in_support": (F.col("posterior_index").isNotNull()) & (F.col("prior_index").isNotNull()),
            "finite_log_loss": E.finite("posterior_log_loss") & E.finite("prior_log_loss"), "finite_ratio": E.finite("mass_ratio"),
        },
    )


def contains_forbidden_key(document: Column, forbidden: Sequence[str]) -> Column:
    """V-11: whether a key occurs anywhere in a nested JSON document; NULL if it is not JSON."""
    names = frozenset(forbidden)

    def walk(value) -> bool:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                if names & v.keys():
                    return True
                stack.extend(v.values())
            elif isinstance(v, list):
                stack.extend(v)
        return False

    def found(text):
        try:
            return None if text is None else walk(json.loads(text))
        except ValueError:
            return None

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return run(document)


def violations_forbidden_keys(df: DataFrame, key: str, document: str, forbidden: Sequence[str]) -> DataFrame:
    hit = df.select(F.col(key).alias("__key"), document, contains_forbidden_key(F.col(document), forbidden).alias("__hit"))
    bad = hit.filter("__hit").select(*violation("forbidden_key", F.col("__key")))
    broken = hit.filter(F.col("__hit").isNull() & F.col(document).isNotNull()).select(*violation("invalid_document", F.col("__key")))
    return bad.unionByName(broken)


def violations_probe_rows(rows: DataFrame, run: str, position: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """V-12: probe rows must be identical at every position of every run."""
    d = canonical_sha256(rows.select(run, *position, *cols), list(cols), name="digest")
    n = rows.select(run).distinct().agg(F.count(F.lit(1)).alias("__n"))
    g = d.groupBy(*position).agg(F.count(F.lit(1)).alias("rows"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    text = F.concat_ws("/", *[F.col(p).cast("string") for p in position])
    return check_rows(attach_row(g, n), text, {"identical_row": F.col("lo") == F.col("hi"), "in_every_run": F.col("rows") == F.col("__n")})


def multiset_digest(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(by, rows, digest) of the rows of a table, whatever their order or partitioning.

    Rows become texts (columns by name, null as ``\\N``, doubles rounded to ``digits``), texts MD5 digests, and the four words of these are added up
    modulo 2^64 each. Sums are partial aggregates, so two tables are compared whole without a join of their keys. Repeated rows
    count as often as they occur. An empty table gives one row of zeros, or none with ``by``.
    """
    kinds = dict(df.dtypes)
    shown = lambda c: (F.round(c, digits) + F.lit(0.0)) if kinds[c] in ("double", "float") else F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
    named = sorted(c for c in columns or df.columns if c not in by)
    text = F.concat_ws(chr(31), *[F.coalesce(shown(c).cast("string"), F.lit("\\N")) for c in named])
    d = df.select(*by, F.md5(text.cast("binary")).alias("__h"))
    words = [F.sum(F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    wrapped = lambda c: F.lpad(F.lower(F.conv(F.pmod(F.coalesce(c, F.lit(0)), F.expr("18446744073709551616BD")).cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[w.alias(f"__w{k}") for k, w in enumerate(words)])
    return g.select(*by, "rows", F.concat(*[wrapped(F.col(f"__w{k}")) for k in range(4)]).alias("digest"))


def violations_artifacts(artifacts: Mapping[str, tuple[DataFrame, DataFrame]], digits: int = 9) -> DataFrame:
    """V-13: stored artifacts against their recomputation, each compared whole by its multiset digest.

    ``artifacts``: name -> (stored, recomputed). Only the columns of the recomputed table count; one that is not stored is a violation too.
    """
    found = []
    for name, (stored, again) in sorted(artifacts.items()):
        lacking = sorted(set(again.columns) - set(stored.columns))
        if lacking:
            found.append(again.limit(1).select(*violation("artifact_columns", F.lit(name), F.lit(",".join(lacking)))).distinct())
            continue
        typed = stored.select(*[F.col(c).cast(t).alias(c) for c, t in again.dtypes])
        both = attach_row(multiset_digest(typed, digits=digits), multiset_digest(again, digits=digits).withColumnsRenamed({"rows": "__rows", "digest": "__digest"}))
        counts = F.concat_ws("/", F.col("rows").cast("string"), F.col("__rows").cast("string"))
        found.append(both.filter("digest <> __digest OR rows <> __rows").select(*violation("artifact_mismatch", F.lit(name), counts)))
    return reduce(DataFrame.unionByName, found)


def violations_digests(kind: str, declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """V-13: declared digests (key, digest) against actual ones: missing, undeclared and different."""
    j = declared.select(F.col(key).cast("string").alias("__k"), F.col("digest").alias("__d")).join(
        actual.select(F.col(key).cast("string").alias("__a"), F.col("digest").alias("__e")), F.col("__k").eqNullSafe(F.col("__a")), "full_outer")
    rule = F.when(F.col("__e").isNull(), "missing").when(F.col("__d").isNull(), "undeclared").when(F.col("__d") != F.col("__e"), "digest")
    return j.withColumn("__rule", rule).filter("__rule IS NOT NULL").select(
        F.concat(F.lit(f"{kind}_"), "__rule").alias("rule"), F.coalesce("__k", "__a").alias("key"), F.lit("").alias("detail"))


SHIPPED_ROWS = 1_000_000


def _shipped(few: DataFrame) -> DataFrame:
    """A stored result, sent to the tasks if it is small; its size alone would be known too late to spare the other side a shuffle."""
    return F.broadcast(few) if few.count() <= SHIPPED_ROWS else few


def _bound_apart(matches: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(game_trace_sha256, match_id) of the rows and of the traces, without digests that one row and one trace have and bind to one match.

    Those break no rule about traces and are most of a bundle. They are told by 128 bits of hashes of digest and match, so the texts
    of the others alone are shuffled; if these are many too, nothing is left out.
    """
    cols = ["game_trace_sha256", "match_id"]
    rows, held = matches.select(*cols), traces.select(*cols)
    digest, match = F.xxhash64("game_trace_sha256"), F.xxhash64("match_id")
    unknown = F.col("game_trace_sha256").isNull() | F.col("match_id").isNull()
    tagged = rows.select(digest.alias("__h"), match.alias("__m"), F.lit(True).alias("__row"), unknown.alias("__trace")).unionByName(
        held.select(digest.alias("__h"), match.alias("__m"), unknown.alias("__row"), F.lit(True).alias("__trace")))
    met = tagged.groupBy("__h").agg(F.count_if("__row").alias("__rows"), F.count_if("__trace").alias("__traces"), F.bit_xor("__m").alias("__x"))
    apart = cut_lineage(met.filter("NOT (__rows = 1 AND __traces = 1 AND __x = 0)").select("__h"))
    if apart.count() > SHIPPED_ROWS:
        return rows, held
    some = lambda df: df.withColumn("__h", digest).join(F.broadcast(apart), "__h", "left_semi").drop("__h")
    return some(rows), some(held)


def violations_bundle(
    matches: DataFrame, registrations: DataFrame, traces: DataFrame, players: DataFrame, blocks: int, deal_seed_of_block: DataFrame,
    stored_payoff: DataFrame | None = None, artifacts: Mapping[str, tuple[DataFrame, DataFrame]] | None = None,
    digests: Mapping[str, tuple[DataFrame, DataFrame, str]] | None = None,
) -> DataFrame:
    """V-13: an evidence bundle: unique trace digests, complete schedule, block to seed mapping, bindings of
    rows to traces and registrations, stored payoff cells equal to recomputation, and whole artifacts and declared digests.

    ``traces``: game_trace_sha256, match_id; ``registrations``: player_id; ``deal_seed_of_block``: deal_block, deal_seed. ``artifacts``: name -> (stored,
    recomputed), such as rating, payoff, competency, cost, root and decision tables; ``digests``: kind -> (declared, actual, key column) of registrations, trace
    shards (``multiset_digest`` by shard) or the seed set.
    """
    from scoreloom.operators.comparisons import schedule_gaps
    from scoreloom.operators.ratings import payoff_matrix

    bound, traced = _bound_apart(matches, traces)
    dup = bound.groupBy("game_trace_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *violation("trace_digest_repeated", F.col("game_trace_sha256"), F.col("n"))
    )
    gaps = schedule_gaps(matches, players, blocks).withColumn("rule", F.concat(F.lit("schedule_"), "rule"))
    # Blocks and seeds are compared before they meet the rows that have them: one row of the result for each seed that is not the row's.
    keys = ["deal_block", "deal_seed"]
    wrong = matches.select(*keys).distinct().join(deal_seed_of_block.select("deal_block", F.col("deal_seed").alias("__s")), "deal_block", "left").filter(
        ~F.coalesce(F.col("deal_seed") == F.col("__s"), F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__times"))
    seeds = join_back(matches.select(*keys, "match_id"), _shipped(cut_lineage(wrong)), keys).select(
        F.explode(F.array_repeat(F.lit("deal_seed"), F.col("__times"))).alias("rule"), F.col("match_id").cast("string").alias("key"), F.lit("").alias("detail"))
    lost = bound.join(traced, ["game_trace_sha256", "match_id"], "left_anti").select(*violation("row_without_trace", F.col("match_id")))
    extra = traced.join(bound, ["game_trace_sha256", "match_id"], "left_anti").select(*violation("trace_without_row", F.col("match_id")))
    seats = matches.select("match_id", F.explode(F.array("player_a", "player_b")).alias("player_id"))
    unknown = seats.join(registrations.select("player_id"), "player_id", "left_anti").select(*violation("unregistered_player", F.col("match_id"), F.col("player_id")))
    out = dup.unionByName(gaps).unionByName(seeds).unionByName(lost).unionByName(extra).unionByName(unknown)
    if stored_payoff is not None:
        cols = ["games", "score_a", "wins_a", "draws", "wins_b", "sweeps_a", "splits", "sweeps_b", "draw_or_mixed"]
        again = violations_rederived(stored_payoff, payoff_matrix(matches), ["cell_id"], cols, 1e-9)
        out = out.unionByName(again.withColumn("rule", F.concat(F.lit("payoff_"), "rule")))
    if artifacts:
        out = out.unionByName(violations_artifacts(artifacts))
    for kind, (declared, actual, key) in sorted((digests or {}).items()):
        out = out.unionByName(violations_digests(kind, declared, actual, key))
    return out
