"""J- and D-ops: aligned comparisons, completeness, parity and set differences."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O
from scoreloom.functions.canonical import canonical_sha256
from scoreloom.functions.joins import attach_row
from scoreloom.operators.ratings import missing_pairs
from scoreloom.operators.sequences import violation


def _text(keys: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


# ------------------------------------------------------------------ J-ops


def agreement(left: DataFrame, right: DataFrame, bucket: Sequence[str] = ("action_space_kind", "legal_action_count")) -> tuple[DataFrame, DataFrame]:
    """J-02: (agreement overall and by bucket, violations for roots present on one side only)."""
    r = right.select("root_id", F.col("action").alias("__ra"))
    j = left.join(r, "root_id", "full_outer")
    both = F.col("action").isNotNull() & F.col("__ra").isNotNull()
    bad = j.filter(~both).select(*violation("unmatched_root", F.col("root_id")))
    tag = F.concat_ws("__legal-", *[F.col(b).cast("string") for b in bucket])
    rows = j.filter(both).select(
        F.explode(F.array(F.lit("aggregate"), tag)).alias("bucket"),
        F.when(F.col("action") == F.col("__ra"), 1).otherwise(0).alias("a"),
    )
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.sum("a").alias("agreements"))
    return out.withColumn("rate", E.rate("agreements", "roots", None)), bad


def anchor_cells(
    matches: DataFrame, candidates: DataFrame, anchors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """J-03: (score per candidate arm and (opponent, block, leg), violations for incomplete cells).

    ``candidates``: (player, arm); ``anchors``: (player). Every arm must have every cell.
    """
    a = candidates.select(F.col("player").alias("me"), "arm")
    sides = F.array(
        F.struct(F.col("player_a").alias("me"), F.col("player_b").alias("opponent"), F.col("score_a").alias("score")),
        F.struct(F.col("player_b").alias("me"), F.col("player_a").alias("opponent"), (1.0 - F.col("score_a")).alias("score")),
    )
    rows = matches.select("deal_block", "leg", F.explode(sides).alias("s")).select("deal_block", "leg", "s.*")
    rows = rows.join(anchors.select(F.col("player").alias("opponent")), "opponent", "left_semi").join(a, "me")
    cell = ["opponent", "deal_block", "leg"]
    cells = rows.groupBy("arm", *cell).agg(F.avg("score").alias("score"))
    arms = candidates.select("arm").distinct().agg(F.collect_set("arm").alias("arms"))
    have = cells.groupBy(*cell).agg(F.collect_set("arm").alias("have"))
    gaps = attach_row(have, arms).withColumn("missing", F.array_sort(F.array_except("arms", "have"))).filter(F.size("missing") > 0)
    return cells, gaps.select(*violation("incomplete_cell", _text(cell), F.concat_ws(",", "missing")))


def within_seed(matches: DataFrame, regs: DataFrame) -> DataFrame:
    """J-04: rows between candidates of the same seed and different arms: (arm, seed, score), both sides."""
    a = regs.select(F.col("player").alias("player_a"), F.col("arm").alias("__aa"), F.col("seed").alias("__sa"))
    b = regs.select(F.col("player").alias("player_b"), F.col("arm").alias("__ab"), F.col("seed").alias("__sb"))
    j = matches.join(a, "player_a").join(b, "player_b").filter((F.col("__sa") == F.col("__sb")) & (F.col("__aa") != F.col("__ab")))
    sides = F.array(
        F.struct(F.col("__aa").alias("arm"), F.col("player_a").alias("player"), F.col("score_a").alias("score")),
        F.struct(F.col("__ab").alias("arm"), F.col("player_b").alias("player"), (1.0 - F.col("score_a")).alias("score")),
    )
    return j.select(F.col("__sa").alias("seed"), F.explode(sides).alias("s")).select("s.arm", "seed", "s.player", "s.score")


def continuation(decisions: DataFrame, events: DataFrame, replay: str = "replay_id", heads: DataFrame | None = None) -> DataFrame:
    """J-05: (replay, viewer, ordinal, seq): the events that follow a decision up to the viewer's next one.

    A viewer's intervals [cursor, next cursor) are disjoint, the first one starts at 0, so
    instead of a range join the decisions and events of a viewer are merged into one
    sequence and each event takes the last decision at or before it. Of decisions with
    equal cursors only the last has a non-empty interval, except that the events before the first cursor belong
    to its first decision. ``heads`` (replay, viewer, head)
    bounds the last interval.
    """
    keys = [replay, "viewer"]
    marks = decisions.groupBy(*keys, "cursor").agg(F.max("ordinal").alias("ordinal"))
    first = decisions.groupBy(*keys).agg(F.min_by("ordinal", F.struct("cursor", "ordinal")).alias("__first"))
    merged = marks.select(*keys, (F.col("cursor") * 2).alias("__at"), F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("seq")).unionByName(
        events.select(*keys, (F.col("seq") * 2 + 1).alias("__at"), F.lit(None).cast("bigint").alias("ordinal"), F.col("seq").cast("bigint").alias("seq"))
    )
    filled = O.running_max(merged, keys, "__at", {"__ord": "ordinal"}).filter(F.col("seq").isNotNull())
    out = filled.join(first, keys).select(*keys, F.coalesce("__ord", "__first").alias("ordinal"), "seq")
    if heads is not None:
        out = out.join(heads, keys).filter(F.col("seq") < F.col("head")).drop("head")
    return out


QUANTITIES = ("q", "robustness", "uncertainty")


def compare_scenarios(left: DataFrame, right: DataFrame, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """J-06: (per action deltas, violations). A delta is available only if both sides are.

    Input: action, position, probability and nullable q, robustness, uncertainty.
    """
    keys = [*key, "action"]
    cols = ("position", "probability", *QUANTITIES)
    l = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols])
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols])
    j = l.join(r, keys, "full_outer")
    same = F.coalesce(F.col("l_position") == F.col("r_position"), F.lit(False))
    bad = j.filter(~same).select(*violation("action_identity_mismatch", _text(keys)))
    out = j.filter(same).select(
        *keys, (F.col("l_probability") - F.col("r_probability")).alias("policy_probability"),
        *[(F.col(f"l_{c}") - F.col(f"r_{c}")).alias(c) for c in QUANTITIES],
        *[
            F.when((F.col(f"l_{c}") - F.col(f"r_{c}")).isNull(), "comparison_quantity_unavailable").alias(f"{c}_reason")
            for c in QUANTITIES
        ],
    )
    return out, bad


def compare_spans(base: DataFrame, current: DataFrame) -> DataFrame:
    """J-07: spans side by side; within one percent counts as unchanged."""
    b = base.select("path", F.col("total_time").alias("baseline"), F.col("count").alias("__bc"))
    c = current.select("path", F.col("total_time").alias("current"), F.col("count").alias("__cc"))
    j = b.join(c, "path", "full_outer")
    pct = F.when(F.col("baseline") > 0, (F.col("current") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0)
    label = (
        F.when(F.col("current").isNull(), "-100%").when(F.col("baseline").isNull(), "+NEW")
        .when(pct > 1, F.concat(F.lit("+"), F.format_string("%.1f", pct), F.lit("%")))
        .when(pct < -1, F.concat(F.format_string("%.1f", pct), F.lit("%"))).otherwise("~0%")
    )
    state = F.when(F.col("current").isNull(), "(removed)").when(F.col("baseline").isNull(), "(new)").otherwise("both")
    count = F.when(F.col("baseline").isNull(), F.col("__cc")).otherwise(F.col("__cc") - F.col("__bc"))
    return j.select("path", "baseline", "current", state.alias("state"), label.alias("change"), count.alias("count_delta"))


# Roles of visible objects.
OBJECT_ROLES = {"agent_card": 0, "opponent_card": 1, "stack_ability": 2}


def project_objects(observations: DataFrame, catalog: DataFrame, identity: bool = False) -> tuple[DataFrame, DataFrame]:
    """J-08: (visible objects joined to their definition row, violations for unadmitted ones).

    ``observations``: observation_id, agent_cards and opponent_cards array<bigint>, and
    stack_objects array<struct<kind,source>>; stack spells (kind 0) are already visible cards.
    """
    def cards(col: str, role: str) -> DataFrame:
        return observations.select(
            "observation_id", F.lit(role).alias("role"), F.posexplode(col).alias("slot", "registry_key")
        )

    stack = observations.select(
        "observation_id", F.lit("stack_ability").alias("role"), F.posexplode("stack_objects").alias("slot", "o")
    ).filter(F.col("o.kind") != 0).select("observation_id", "role", "slot", F.col("o.source").alias("registry_key"))
    objects = cards("agent_cards", "agent_card").unionByName(cards("opponent_cards", "opponent_card")).unionByName(stack)
    hit = objects.join(catalog.select("registry_key", "definition_row"), "registry_key", "left")
    bad = hit.filter(F.col("definition_row").isNull()).select(
        *violation("unadmitted_definition", _text(["observation_id", "role", "slot"]), F.col("registry_key"))
    )
    out = hit.filter(F.col("definition_row").isNotNull()).select(
        "observation_id", "role", "slot", "definition_row",
        (F.col("registry_key") if identity else F.lit(-1)).cast("bigint").alias("identity"),
        F.lit(identity).alias("identity_valid"),
    )
    return out, bad


def join_support(rows: DataFrame, target: DataFrame, keys: Sequence[str] = ("space_id", "hand_key")) -> tuple[DataFrame, DataFrame]:
    """J-09: (target worlds with the transported log probability, -inf where nothing arrives; violations)."""
    moved = rows.select(*keys, F.col("log_p").alias("__lp"))
    out = target.join(moved, list(keys), "left").withColumn("log_p", F.coalesce("__lp", F.lit(float("-inf")))).drop("__lp")
    lost = moved.join(target, list(keys), "left_anti").select(*violation("left_support", _text(keys)))
    return out, lost


def schedule_gaps(matches: DataFrame, players: DataFrame, blocks: int, legs: int = 2) -> DataFrame:
    """J-10: missing, unexpected and duplicate (pair, block, leg) rows against the complete schedule.

    The schedule isn't listed: a player's partners of a block and leg are counted, and only those of an incomplete count are looked through.
    """
    cell, slot = ["cell_id", "deal_block", "leg"], ["deal_block", "leg"]
    roster = players.select("player").distinct().filter("player IS NOT NULL")
    spine = roster.select("player", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("deal_block")).select(
        "player", "deal_block", F.explode(F.sequence(F.lit(0), F.lit(legs - 1))).alias("leg"))
    have = matches.select(
        F.least("player_a", "player_b").alias("a"), F.greatest("player_a", "player_b").alias("b"), F.col("deal_block").cast("bigint").alias("deal_block"), F.col("leg").cast("int").alias("leg"),
    ).groupBy("a", "b", *slot).agg(F.count(F.lit(1)).alias("n"))
    known = lambda c: roster.select(F.col("player").alias(c), F.lit(True).alias(f"__{c}"))
    due = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("a") < F.col("b")) & F.col("deal_block").between(0, blocks - 1) & F.col("leg").between(0, legs - 1)
    rule = F.when(~F.coalesce(due, F.lit(False)), "unexpected").when(F.col("n") > 1, "duplicate")
    odd = have.join(known("a"), "a", "left").join(known("b"), "b", "left").withColumn("rule", rule).filter("rule IS NOT NULL")
    lost = missing_pairs(spine, have.select("a", "b", *slot), slot).withColumns({"rule": F.lit("missing"), "n": F.lit(0).cast("bigint")})
    return odd.select("rule", "a", "b", *slot, "n").unionByName(lost.select("rule", "a", "b", *slot, "n")).withColumn("cell_id", F.concat_ws("__", "a", "b")).select(
        "rule", _text(cell).alias("key"), F.col("n").cast("string").alias("detail")
    )


def holdout_audit(records: DataFrame, atoms: DataFrame) -> DataFrame:
    """J-11: per held-out program the atoms unseen in training and training programs with its fingerprint.

    ``records``: program, held_out, fingerprint; ``atoms``: program, atom, and held_out, if it is at hand (atoms then needn't
    meet their records). Atoms may repeat. Gaps and duplicates are
    counted and listed; the lists are bounded by the size of one program and by equal fingerprints.
    """
    tagged = atoms if "held_out" in atoms.columns else atoms.join(records.select("program", "held_out"), "program")
    train = tagged.filter(~F.col("held_out")).select("atom").distinct()
    gaps = (
        tagged.filter("held_out").select("program", "atom").distinct().join(train, "atom", "left_anti")
        .groupBy("program").agg(F.array_sort(F.collect_set("atom")).alias("gaps"))
    )
    dup = records.filter(~F.col("held_out")).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("training_duplicates"), F.min("program").alias("first_duplicate")
    )
    out = records.filter("held_out").join(gaps, "program", "left").join(dup, "fingerprint", "left")
    return out.select(
        "program", "fingerprint", F.coalesce("training_duplicates", F.lit(0)).alias("training_duplicates"), "first_duplicate",
        F.col("training_duplicates").isNull().alias("novel"),
        F.coalesce(F.size("gaps"), F.lit(0)).alias("gap_count"), F.concat_ws(",", F.coalesce("gaps", F.array())).alias("gaps"),
        F.col("gaps").isNull().alias("full_closure"),
    )


def transport_facts(spaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-12: (names leaving and entering the hidden pool and the number of hidden draws, violations).

    ``spaces``: key, before_pool, after_pool map<string,int>, before_hand, after_hand,
    commitment_kind, commitment_card.
    """
    delta = F.map_zip_with(
        "before_pool", "after_pool", lambda k, b, a: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))
    )
    d = spaces.withColumn("delta", delta)

    def expand(sign: int) -> Column:
        names = F.array_sort(F.map_keys(F.map_filter("delta", lambda k, v: v * sign > 0)))
        counts = F.col("delta")
        return F.flatten(F.transform(names, lambda n: F.array_repeat(n, F.abs(F.element_at(counts, n)))))

    d = d.withColumns({"exits": expand(-1), "returns": expand(1)})
    d = d.withColumn(
        "hidden_draws", F.col("after_hand") - F.col("before_hand") + F.size("exits") - F.size("returns")
    )
    public = F.col("commitment_kind").isin("cast", "play_land", "discard")
    rules = [
        F.when((F.size("exits") > 0) & ~F.coalesce(public, F.lit(False)), F.lit("exit_without_commitment")),
        F.when(
            (F.size("exits") > 0) & F.coalesce(public, F.lit(False)) & ~(F.col("exits").eqNullSafe(F.array("commitment_card"))),
            F.lit("commitment_mismatch"),
        ),
        F.when(F.col("hidden_draws") < 0, F.lit("unexplained_exit")),
    ]
    bad = d.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("key").cast("string").alias("key"), F.col("hidden_draws").cast("string").alias("detail"))
    return d.select("key", "exits", "returns", "hidden_draws"), bad


def condition_deltas(conds: DataFrame, key: Sequence[str], base: str = "true") -> DataFrame:
    """J-13: per condition the change against the unconditioned search of the same root."""
    cols = ("root_value", "uncertainty", "visit_counts", "q_values")
    t = conds.filter(F.col("condition") == base).select(*key, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = conds.filter(F.col("condition") != base).join(t, list(key))

    def dist(c: str) -> Column:
        return E.let(
            F.struct(E.doubles(c).alias("v"), E.array_sum(c).alias("s")),
            lambda x: F.transform(x["v"], lambda v: v / F.when(x["s"] == 0, 1.0).otherwise(x["s"])),
        )

    gap = F.array_max(F.zip_with("q_values", "b_q_values", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return j.select(
        *key, "condition", (F.col("root_value") - F.col("b_root_value")).alias("root_value_delta"),
        (F.col("uncertainty") - F.col("b_uncertainty")).alias("uncertainty_delta"),
        E.l1_distance(dist("visit_counts"), dist("b_visit_counts")).alias("visit_dist_l1"),
        gap.alias("q_max_abs_delta"),
        (E.first_argmax("visit_counts") != E.first_argmax("b_visit_counts")).alias("top_action_changed"),
    )


# ------------------------------------------------------------------ D-ops


def split_overlap(df: DataFrame, split: str, signatures: Sequence[str]) -> DataFrame:
    """D-01: number of signature values shared by each pair of splits, per signature column.

    Each distinct value lists the (few, declared) splits it occurs in; pairs come from that
    list, so no value joins with itself.
    """
    rows = df.select(
        split, F.explode(F.array(*[F.struct(F.lit(s).alias("signature"), F.col(s).cast("string").alias("value")) for s in signatures])).alias("s")
    ).select(split, "s.signature", "s.value").distinct()
    sets = rows.groupBy("signature", "value").agg(F.array_sort(F.collect_set(split)).alias("in"))
    pairs = sets.filter(F.size("in") > 1).select("signature", "in", F.posexplode("in").alias("i", "left_split")).select(
        "signature", "left_split", F.explode(F.slice("in", F.col("i") + 2, F.size("in"))).alias("right_split")
    )
    return pairs.groupBy("signature", "left_split", "right_split").agg(F.count(F.lit(1)).alias("overlap"))


def label_contingency(df: DataFrame, fields: Sequence[str], label: str, labels: Sequence) -> DataFrame:
    """D-02: per field value the count of each label and whether the counts are equal."""
    rows = df.select(
        label, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("s")
    )
    out = rows.groupBy("s.field", "s.value").agg(*[E.count_true(F.col(label) == v).alias(f"label_{v}") for v in labels])
    first = F.col(f"label_{labels[0]}")
    same = F.lit(True)
    for v in labels[1:]:
        same = same & (F.col(f"label_{v}") == first)
    return out.withColumn("balanced", same)


def key_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-03: keys missing on the right, unknown on the left, and duplicates on either side."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr"))
    j = l.join(r, list(keys), "full_outer")
    rules = F.array_compact(
        F.array(
            F.when(F.col("nr").isNull(), F.lit("missing")), F.when(F.col("nl").isNull(), F.lit("unknown")),
            F.when(F.col("nl") > 1, F.lit("duplicate_left")), F.when(F.col("nr") > 1, F.lit("duplicate_right")),
        )
    )
    return j.select(F.explode(rules).alias("rule"), _text(keys).alias("key"),
                    F.concat_ws(":", F.coalesce("nl", F.lit(0)).cast("string"), F.coalesce("nr", F.lit(0)).cast("string")).alias("detail"))


def family_index(atoms: DataFrame, mapping: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D-04: (cards per family, families per card, violations for families without cards).

    ``atoms``: card, atom; ``mapping``: atom, family. Both indexes stay rows (key, member).
    """
    pairs = atoms.join(mapping, "atom").select("card", "family").distinct()
    empty = families.join(pairs, "family", "left_anti").select(*violation("family_without_cards", F.col("family")))
    by_family = pairs.select("family", "card")
    return by_family, pairs.select("card", "family"), empty


def coverage_summary(
    cards: DataFrame, decks: DataFrame, references: DataFrame, evidence: DataFrame, sanctioned: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """D-05: (one row per card with roles and status, summary counts).

    ``cards``: card, supported; ``decks`` and ``references``: card; ``evidence``: card (tested);
    ``sanctioned``: card (declared exceptions).
    """
    def flag(other: DataFrame, name: str) -> DataFrame:
        return other.select("card").distinct().withColumn(name, F.lit(True))

    out = cards
    for other, name in ((decks, "in_deck"), (references, "referenced"), (evidence, "tested"), (sanctioned, "sanctioned")):
        out = out.join(flag(other, name), "card", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    role = F.when(F.col("in_deck") & F.col("referenced"), "deck+reference").when(F.col("in_deck"), "deck").when(
        F.col("referenced"), "reference"
    ).otherwise("unused")
    status = F.when(F.col("supported") & F.col("tested"), "covered").when(F.col("supported"), "untested").when(
        F.col("sanctioned"), "sanctioned"
    ).otherwise("unsupported")
    out = out.withColumns({"role": role, "status": status})
    return out, out.groupBy("role", "status").agg(F.count(F.lit(1)).alias("cards"))


def fingerprint_diff(expected: DataFrame, actual: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """D-07: keys whose values differ (a missing key differs from any value)."""
    e = expected.select(key, F.col(value).alias("expected"))
    a = actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def determinism(df: DataFrame, within: Sequence[str], digests: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """D-08: (per group the number of distinct digests, the same over all groups).

    Minimum equal to maximum decides identity with partial aggregation; the exact number of
    distinct values is computed on the already distinct rows.
    """
    long = df.select(
        *within, F.explode(F.array(*[F.struct(F.lit(d).alias("digest"), F.col(d).alias("v")) for d in digests])).alias("s")
    ).select(*within, "s.digest", "s.v").distinct()
    per = long.groupBy(*within, "digest").agg(F.count(F.lit(1)).alias("distinct_values"))
    per = per.withColumn("deterministic", F.col("distinct_values") == 1)
    total = long.select("digest", "v").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("distinct_values"))
    return per, total.withColumn("deterministic", F.col("distinct_values") == 1)


def receipt_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """D-09: missing, extra and changed files between two receipt tables (path, bytes, sha256)."""
    e = expected.select("path", F.struct("bytes", "sha256").alias("e"))
    a = actual.select("path", F.struct("bytes", "sha256").alias("a"))
    j = e.join(a, "path", "full_outer")
    rule = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "changed")
    return j.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", F.col("path").alias("key"), F.lit("").alias("detail"))


def parity(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], revision: str, fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """D-10: (all field mismatches, first divergence per key) of revisions aligned by (keys, revision)."""
    align = [*keys, revision]
    pack = lambda p: F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])).alias(p)
    j = expected.select(*align, pack("e")).join(actual.select(*align, pack("a")), align, "full_outer")
    names = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")
    rows = j.select(*align, "e", "a", names).select(
        *align, "field", F.try_element_at("e", F.col("field")).alias("expected"), F.try_element_at("a", F.col("field")).alias("actual"),
        F.col("e").isNull().alias("__ne"), F.col("a").isNull().alias("__na"),
    )
    bad = rows.filter(~F.col("expected").eqNullSafe(F.col("actual")) | F.col("__ne") | F.col("__na")).drop("__ne", "__na")
    place = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    first = bad.groupBy(*keys).agg(
        F.min_by(F.struct(revision, "field", "expected", "actual"), F.struct(F.col(revision), F.element_at(place, F.col("field")))).alias("m")
    ).select(*keys, "m.*")
    return bad, first


def seen_index(ledger: DataFrame, programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-11: (program, revision) pairs in which the program's definition was met, and programs never met.

    ``ledger``: revision, definitions array<string>; ``programs``: program, definition.
    """
    met = ledger.select("revision", F.explode("definitions").alias("definition")).distinct()
    pairs = programs.join(met, "definition").select("program", "revision").distinct()
    never = programs.select("program").distinct().join(pairs, "program", "left_anti")
    return pairs, never


def logical_diff(variants: DataFrame, variant: str, keys: Sequence[str], logical: Sequence[str]) -> DataFrame:
    """D-12: keys for which the logical fields (no timing or memory) differ between variants or are absent in some."""
    d = canonical_sha256(variants.select(variant, *keys, *logical), list(logical), name="digest")
    n = variants.select(variant).distinct().agg(F.count(F.lit(1)).alias("__v"))
    g = d.groupBy(*keys).agg(F.count_distinct("digest").alias("digests"), F.count_distinct(variant).alias("variants"))
    bad = attach_row(g, n).filter((F.col("digests") > 1) | (F.col("variants") != F.col("__v")))
    return bad.select(*violation("logical_mismatch", _text(keys), F.concat_ws(":", F.col("digests").cast("string"), F.col("variants").cast("string"))))


# ------------------------------------------------------------------ nested documents


# The nested shape of a definition. Per node: the atom it contributes
# (prefix, field) and the fields that lead to further nodes.
DEFINITION_SHAPE = {
    "definition": (None, {"characteristics": "characteristics", "programs": "program"}),
    "program": (("program_kind", "kind"), {"cost": "cost", "targets": "target", "trigger": "trigger", "ops": "instruction"}),
    "cost": (None, {"affinity": "predicate"}),
    "target": (None, {"selector": "selector"}),
    "selector": (("selector", "kind"), {}),
    "trigger": (("trigger_event", "event"), {"subject": "subject", "if": "condition"}),
    "subject": (("trigger_subject", "kind"), {"predicate": "predicate"}),
    "instruction": (
        ("opcode", "op"),
        {"predicate": "predicate", "condition": "condition", "then": "instruction", "otherwise": "instruction", "body": "instruction"},
    ),
    "condition": (("condition", "kind"), {"predicate": "predicate"}),
    "predicate": (("predicate", "kind"), {"predicates": "predicate"}),
    "characteristics": (None, {}),
}


def definition_atoms(document: dict) -> set[str]:
    """Distinct atoms of one definition, found by following the shape table."""
    found: set[str] = set()
    pending = [("definition", document)]
    while pending:
        node, value = pending.pop()
        emits, children = DEFINITION_SHAPE[node]
        if emits:
            found.add(f"{emits[0]}:{value[emits[1]]}")
        if node == "characteristics":
            found.update(f"keyword:{k}" for k in value.get("keywords", []))
            if value.get("token"):
                found.add("characteristic:token")
        if node == "cost":
            found.update(f"cost_feature:{k}" for k in value)
        for field, kind in children.items():
            child = value.get(field)
            pending += [(kind, c) for c in (child if isinstance(child, list) else [child]) if isinstance(c, dict)]
    return found


def atoms(definitions: DataFrame, key: str = "definition", document: str = "document") -> DataFrame:
    """D-06: distinct (definition, atom) from nested JSON documents, walked in Arrow batches.

    A document that is no JSON object of the declared shape gives the single atom ``invalid_document``.
    """

    def run(batches):
        for pdf in batches:
            keys, found = [], []
            for k, text in zip(pdf[key], pdf[document]):
                try:
                    out = definition_atoms(json.loads(text))
                except (ValueError, TypeError, KeyError, AttributeError):
                    out = {"invalid_document"}
                keys += [k] * len(out)
                found += sorted(out)
            yield pd.DataFrame({key: keys, "atom": found})

    kind = dict(definitions.dtypes)[key]
    return definitions.select(key, document).mapInPandas(run, f"`{key}` {kind}, atom string").distinct()


