"""B-09/B-15: a sparse table of transition links, and the fold of beliefs over it.

What a move (exits, returns, hidden draws) does to the worlds of a space doesn't depend on who makes it. ``transition_links`` computes it
once per distinct move; all games that make the move share the rows. The tracker then is an ordered pass: each (game, viewer) holds one
belief, and every transition row brings the links, the likelihoods and the next space's worlds that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.worlds import continuity_violations, prior
from scoreloom.session import cut_lineage

KEY = ["game", "viewer"]
MOVE = ["before_space", "after_space", "exits", "returns", "hidden_draws"]


def with_move_id(transitions: DataFrame) -> DataFrame:
    """``transitions`` with the id of its move: spaces, exits and returns as multisets, and number of hidden draws."""
    d = transitions.withColumns({"exits": F.array_sort("exits"), "returns": F.array_sort("returns"), "hidden_draws": F.col("hidden_draws").cast("int")})
    return d.withColumn("move_id", F.md5(F.to_json(F.struct(*MOVE)).cast("binary")))


def moves(transitions: DataFrame) -> DataFrame:
    """The distinct moves of ``transitions``: move_id, before_space, after_space, exits, returns, hidden_draws."""
    return with_move_id(transitions).select("move_id", *MOVE).distinct()


def transition_links(moves: DataFrame, pools: DataFrame, worlds: DataFrame) -> DataFrame:
    """B-09: move_id, source, target, hand_key, factor: how probable a target world is after a source world.

    Known cards leave, then known cards come back, then cards are drawn unseen; a source without the leaving cards has no links. Drawn
    hands are enumerated as multisets, one explode a draw over names in order, and the factor is the hypergeometric
    probability in closed form. ``target`` is null where the hand is no world of the next space (``hand_key`` tells
    which); mass that arrives there violates the support. The factors of a source add up to 1.
    """
    p = pools.select(F.col("space_id").alias("before_space"), "pool")
    sources = worlds.select(F.col("space_id").alias("before_space"), F.col("world_index").alias("source"), "hand")
    count = lambda name, m: f"coalesce(try_element_at({m}, {name}), 0)"
    times = lambda name, a: f"size(filter({a}, x -> x = {name}))"
    d = moves.select("move_id", *MOVE).join(p, "before_space").join(sources, "before_space").filter(
        f"forall(array_distinct(exits), e -> {count('e', 'hand')} >= {times('e', 'exits')})")
    d = d.withColumn("names", F.expr("array_sort(array_union(map_keys(pool), returns))")).selectExpr(
        "move_id", "after_space", "source", "hidden_draws", "names",
        f"transform(names, n -> {count('n', 'hand')} - {times('n', 'exits')} + {times('n', 'returns')}) AS held",
        f"transform(names, n -> {count('n', 'pool')} - {count('n', 'hand')}) AS hidden", "transform(names, n -> 0) AS drawn", "0 AS at")
    most = moves.agg(F.max("hidden_draws").alias("n")).first()["n"] or 0
    for i in range(most):
        more = f"hidden_draws > {i}"
        d = d.selectExpr("*", f"explode(CASE WHEN {more} THEN filter(sequence(at, size(names) - 1), k -> hidden[k] > drawn[k]) ELSE array(at) END) AS k").selectExpr(
            "move_id", "after_space", "source", "hidden_draws", "names", "held", "hidden",
            f"CASE WHEN {more} THEN transform(drawn, (x, j) -> CASE WHEN j = k THEN x + 1 ELSE x END) ELSE drawn END AS drawn", "k AS at")
    choose = lambda n, k: f"CASE WHEN {k} > 0 THEN aggregate(sequence(1, {k}), 1D, (c, j) -> c * ({n} - j + 1) / j) ELSE 1D END"
    ways = f"aggregate(zip_with(hidden, drawn, (n, k) -> {choose('n', 'k')}), 1D, (a, x) -> a * x)"
    d = d.withColumn("library", F.expr("aggregate(hidden, 0, (a, x) -> a + x)")).selectExpr(
        "move_id", "after_space", "source", f"{ways} / {choose('library', 'hidden_draws')} AS factor",
        "concat_ws(';', filter(zip_with(names, zip_with(held, drawn, (a, b) -> a + b), (x, n) -> CASE WHEN n > 0 THEN concat_ws('=', x, CAST(n AS STRING)) END), x -> x IS NOT NULL)) AS hand_key")
    targets = worlds.select(F.col("space_id").alias("after_space"), F.col("world_index").alias("target"), "hand_key")
    return d.join(targets, ["after_space", "hand_key"], "left").select("move_id", "source", "target", "hand_key", "factor")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def packed_links(links: DataFrame) -> DataFrame:
    """One row per move: sources, targets and factors side by side in order of target, and the links that leave the support.

    A row is as large as its move, which a tracked belief, held in one place, bounds too.
    """
    inside, outside = F.col("target").isNotNull(), F.col("target").isNull()
    rows = links.groupBy("move_id").agg(
        F.array_sort(F.collect_list(F.when(inside, F.struct("target", "source", "factor")))).alias("l"),
        F.array_sort(F.collect_list(F.when(outside, F.struct("source", "hand_key")))).alias("outside"))
    return rows.select("move_id", *(_field("l", c).alias(c + "s") for c in ("source", "target", "factor")), "outside")


def packed_worlds(worlds: DataFrame) -> DataFrame:
    """One row per space: space_id, its world indexes in order and the logarithm of their prior."""
    rows = prior(worlds).groupBy("space_id").agg(F.array_sort(F.collect_list(F.struct("world_index", "log_p"))).alias("w"))
    return rows.select("space_id", _field("w", "world_index").alias("worlds"), _field("w", "log_p").alias("log_prior"))


def packed_likelihoods(likelihoods: DataFrame) -> DataFrame:
    """One row per commitment: game, viewer, sequence and the likelihood, legal and matching offers of its worlds in order."""
    fields = ["world_index", "likelihood", "legal", "matching"]
    typed = likelihoods.select(*KEY, "sequence", F.col("world_index").cast("long").alias("world_index"), F.col("likelihood").cast("double").alias("likelihood"),
                               *(F.col(c).cast("long").alias(c) for c in ("legal", "matching")))
    rows = typed.groupBy(*KEY, "sequence").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("l"))
    return rows.select(*KEY, "sequence", *(_field("l", c).alias("l_" + c) for c in fields))


def _normalised(log_p: np.ndarray) -> np.ndarray | None:
    top = log_p.max(initial=-np.inf)
    return None if top == -np.inf else log_p - (top + np.log(np.exp(log_p - top).sum()))


def _told(worlds, log_p, l_world, likelihood, legal, matching, epsilon):
    """B-06 on arrays: (new log probabilities or None, [(rule, world)])."""
    place = np.minimum(np.searchsorted(l_world, worlds), max(len(l_world) - 1, 0))
    there = l_world[place] == worlds if len(l_world) else np.zeros(len(worlds), bool)
    bad = [("missing_likelihood", w) for w in worlds[~there]]
    kept, like, legal, match = worlds[there], *(v[place[there]] if len(l_world) else v for v in (likelihood, legal, matching))
    for rule, broken in (("missing_likelihood", np.isnan(like)), ("likelihood_range", ~np.isnan(like) & ~((like >= 0) & (like <= 1))),
                         ("negative_count", (legal < 0) | (match < 0)), ("matching_exceeds_legal", match > legal)):
        bad += [(rule, w) for w in kept[broken]]
    if bad:
        return None, bad
    mixed = np.where((legal > 0) & (match > 0), (1.0 - epsilon) * like + epsilon * match / np.maximum(legal, 1), 0.0)
    with np.errstate(divide="ignore"):
        return np.where(mixed > 0, log_p + np.log(mixed), -np.inf), []


def _fold(epsilon: float, schema: pa.Schema):
    """One belief is held: of the (game, viewer) whose rows are passing by."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict = {}
        out: list[dict] = []
        weight = 0

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], schema.field(n).type) for n in names], schema=schema)

        def final() -> None:
            if here.get("log_p") is not None:
                out.append({**here["key"], "kind": "state", "space": here["space"], "worlds": here["worlds"], "values": here["log_p"]})

        def violated(row: dict, found: list[tuple[str, str]]) -> None:
            here["log_p"] = None
            out.extend({**here["key"], "kind": "violation", "sequence": row["sequence"], "rule": rule, "text": text} for rule, text in found)

        def step(row: dict, arrays) -> None:
            name = "|".join(str(row[k]) for k in KEY)
            log_p = here["log_p"]
            if row["committed"]:
                told, bad = _told(here["worlds"], log_p, *(arrays(c) for c in ("l_world_index", "l_likelihood", "l_legal", "l_matching")), epsilon)
                if bad:
                    return violated(row, [(rule, f"{name}/{w}") for rule, w in bad])
                log_p = _normalised(told)
                if log_p is None:
                    return violated(row, [("no_finite_mass", name)])
            mass = dict(zip(here["worlds"].tolist(), log_p.tolist())) if row["outside"] else {}
            lost = {x["hand_key"] for x in row["outside"] or () if mass.get(x["source"], -np.inf) > -np.inf}
            if lost:
                return violated(row, [("left_support", f"{name}/{h}") for h in sorted(lost)])
            worlds, sources, targets, factors = (arrays(c) for c in ("worlds", "sources", "targets", "factors"))
            moved = np.full(len(worlds), -np.inf)
            if len(targets):
                place = np.searchsorted(here["worlds"], sources)
                first = np.flatnonzero(np.diff(targets, prepend=targets[0] - 1))
                moved[np.searchsorted(worlds, targets[first])] = np.logaddexp.reduceat(log_p[place] + np.log(factors), first)
            moved = _normalised(moved)
            if moved is None:
                return violated(row, [("no_finite_mass", name)])
            p = np.exp(moved)
            here.update(log_p=moved, worlds=worlds, space=row["after_space"])
            out.append({
                **here["key"], "kind": "record", "sequence": row["sequence"], "support_size": len(p), "positive_support": int((moved > -np.inf).sum()),
                "normalisation_error": abs(float(p.sum()) - 1.0), "effective_size": 1.0 / float((p * p).sum()), "top_mass": float(p.max())})

        for batch in batches:
            plain = ["sequence", "committed", "before_space", "after_space", "outside", *KEY]
            columns = [batch.column(c).to_pylist() for c in plain]
            for k, values in enumerate(zip(*columns)):
                row = dict(zip(plain, values))

                def arrays(c: str, k: int = k, batch: pa.RecordBatch = batch) -> np.ndarray:
                    found = batch.column(c)[k]
                    kind = np.float64 if c in ("factors", "l_likelihood", "log_prior") else np.int64
                    return found.values.to_numpy(zero_copy_only=False).astype(kind) if found.is_valid else np.empty(0, kind)

                if row["sequence"] < 0:
                    final()
                    here = {"key": {c: row[c] for c in KEY}, "space": row["before_space"], "worlds": arrays("worlds"), "log_p": arrays("log_prior")}
                    weight += len(here["worlds"])
                elif here.get("log_p") is not None and all(here["key"][c] == row[c] for c in KEY):
                    step(row, arrays)
            if out and weight + len(out) > 1 << 14:
                yield emitted()
                out.clear()
                weight = 0
        final()
        yield emitted()

    return run


def track(
    transitions: DataFrame, starts: DataFrame, pools: DataFrame, worlds: DataFrame, likelihoods: DataFrame, epsilon: float, links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B-15: fold every game's transitions: condition on opponent commitments, transport, record.

    (records, final beliefs, violations). ``transitions``: game, viewer, sequence (0..), before/after
    revision, before/after space, acting, commitment_kind (NULL without a commitment), exits,
    returns, hidden_draws. ``likelihoods``: game, viewer, sequence, world_index, likelihood, legal,
    matching. ``links``: of ``transition_links`` for the moves of the transitions, if there are some already.

    All games are folded in one stage, each in order of its sequence numbers; nothing is written between
    transitions, and a game's length is only the number of rows that pass. A key that meets a violation stops there.
    """
    if not 0.0 <= epsilon < 1.0:
        raise ValueError("epsilon must be in [0, 1)")
    bad = continuity_violations(transitions, starts)
    text = F.concat_ws("/", F.col("game").cast("string"), F.col("viewer").cast("string"), F.col("sequence").cast("string"))
    broken = transitions.join(bad.select("key").distinct(), text == F.col("key"), "left_semi").groupBy(*KEY).agg(F.min("sequence").alias("__stop"))
    live = cut_lineage(
        with_move_id(transitions.join(broken, KEY, "left").filter(F.col("__stop").isNull() | (F.col("sequence") < F.col("__stop"))).drop("__stop"))
        .withColumn("committed", F.col("commitment_kind").isNotNull() & (F.col("acting") != F.col("viewer")))
    )
    if links is None:
        links = transition_links(live.select("move_id", *MOVE).distinct(), pools, worlds)
    spaces = cut_lineage(packed_worlds(worlds))
    steps = (
        live.select(*KEY, F.col("sequence").cast("long").alias("sequence"), "committed", "before_space", "after_space", "move_id")
        .join(packed_links(links), "move_id", "left").drop("move_id")
        .join(spaces.select(F.col("space_id").alias("after_space"), "worlds"), "after_space", "left")
        .join(packed_likelihoods(likelihoods).withColumn("sequence", F.col("sequence").cast("long")), [*KEY, "sequence"], "left")
    )
    begins = starts.select(*KEY, F.lit(-1).cast("long").alias("sequence"), F.lit(False).alias("committed"), F.col("space_id").alias("before_space")).join(
        spaces.withColumnRenamed("space_id", "before_space"), "before_space")
    rows = begins.unionByName(steps, allowMissingColumns=True).repartition(*KEY).sortWithinPartitions(*KEY, "sequence")
    kind = {f.name: f.dataType.simpleString() for f in live.schema.fields}
    layout = (
        f"game {kind['game']}, viewer {kind['viewer']}, kind string, sequence long, support_size long, positive_support long, normalisation_error double, "
        f"effective_size double, top_mass double, space {kind['after_space']}, worlds array<long>, values array<double>, rule string, text string"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(layout))
    done = cut_lineage(rows.mapInArrow(_fold(epsilon, schema), layout))
    stats = done.filter("kind = 'record'").select(*KEY, "sequence", "support_size", "positive_support", "normalisation_error", "effective_size", "top_mass")
    records = live.select(
        *KEY, "sequence", "before_space", "after_space", F.size("exits").alias("known_exits"), F.size("returns").alias("known_returns"),
        "hidden_draws", F.col("committed").alias("action_update")).join(stats, [*KEY, "sequence"])
    last = done.filter("kind = 'state'").select(
        F.concat_ws("|", F.col("game").cast("string"), F.col("viewer").cast("string")).alias("sid"), "space", F.explode(F.arrays_zip("worlds", "values")).alias("w"))
    state = last.select("sid", F.col("space").alias("real_space"), F.col("w.worlds").alias("world_index"), F.col("w.values").alias("log_p")).join(
        worlds.select(F.col("space_id").alias("real_space"), "world_index", "hand", "hand_key"), ["real_space", "world_index"]
    ).select(F.col("sid").alias("space_id"), "real_space", "world_index", "hand", "hand_key", "log_p")
    found = done.filter("kind = 'violation'").select("rule", F.col("text").alias("key"), F.lit("").alias("detail"))
    return records, state, bad.unionByName(found)
