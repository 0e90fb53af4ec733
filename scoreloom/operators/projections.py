"""P-ops on nested observations and traces: winner, redaction, perspective, fixed slots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E


def winner(index: Column | str, agent_index: Column, agent_life: Column, opponent_index: Column, opponent_life: Column) -> Column:
    """P-07: the declared winner if it reads as an integer, else the side whose opponent has no life."""
    return F.coalesce(
        E.col(index).try_cast("int"),
        F.when(agent_life <= 0, opponent_index).when(opponent_life <= 0, agent_index).cast("int"),
    )


def redact_player(player: Column, zone_counts: str = "zone_counts", hand: str = "hand") -> Column:
    """P-08: a player struct with its hand emptied and the number of hidden cards recorded.

    The zone count wins over the length of the hand; a missing hand is left alone.
    """
    known = F.try_element_at(player[zone_counts], F.lit("HAND"))
    cards = player[hand]
    count = F.when(cards.isNotNull(), F.coalesce(known, F.size(cards)).cast("int"))
    return player.withField("hand_hidden_count", count).withField(hand, F.when(cards.isNotNull(), F.slice(cards, 1, 0)))


def redact(df: DataFrame, observation: str = "observation") -> DataFrame:
    """P-08: hide the opponent's hand of an observation struct."""
    obs = F.col(observation)
    return df.withColumn(observation, obs.withField("opponent", redact_player(obs["opponent"])))


def hero_observation(obs: Column) -> Column:
    """P-09: an observation from player 0's side; sides are swapped and a finished result negated."""
    swap = (obs["agent"]["player_index"] == 1) & (obs["opponent"]["player_index"] == 0)
    swap = F.coalesce(swap, F.lit(False))
    negate = swap & F.coalesce(obs["game_over"], F.lit(False)) & obs["won"].isNotNull()
    return F.struct(
        F.when(swap, obs["opponent"]).otherwise(obs["agent"]).alias("agent"),
        F.when(swap, obs["agent"]).otherwise(obs["opponent"]).alias("opponent"),
        obs["game_over"].alias("game_over"),
        F.when(negate, ~obs["won"]).otherwise(obs["won"]).alias("won"),
    )


def hero_view(df: DataFrame, observation: str = "observation") -> DataFrame:
    return df.withColumn(observation, hero_observation(F.col(observation)))


def prepare_trace(traces: DataFrame, reveal_hidden: bool = False) -> DataFrame:
    """P-08/P-09 over whole traces: every event's and the final observation from the hero's side,
    hands hidden unless revealed, authority-private replay data dropped.

    Observations are transformed as (trace, position) rows so that a long trace is spread over tasks.
    """
    keep = traces.drop("canonical_replay")
    rows = keep.select("trace_id", F.posexplode("events").alias("position", "event"))
    obs = hero_observation(F.col("event.observation"))
    rows = rows.withColumn("observation", obs)
    final = keep.select(
        "trace_id", F.lit(-1).alias("position"), hero_observation(F.col("final_observation")).alias("observation")
    )
    out = rows.select("trace_id", "position", "observation").unionByName(final)
    return out if reveal_hidden else redact(out)


def project_viewer(
    decisions: DataFrame, events: DataFrame, viewer: int | str
) -> tuple[DataFrame, DataFrame]:
    """P-10: only the decisions and the event track of one authorised viewer."""
    return decisions.filter(F.col("viewer") == viewer), events.filter(F.col("viewer") == viewer)


def visible_scenarios(scenarios: DataFrame, viewer_id: str, table_id: str) -> DataFrame:
    """P-10: personal scenarios are visible to their author, table scenarios to their table."""
    personal = (F.col("audience") == "personal") & (F.col("author_viewer_id") == viewer_id)
    table = (F.col("audience") != "personal") & (F.col("table_id") == table_id)
    return scenarios.filter(personal | table)


def fixed_slots(df: DataFrame, column: str, n: int, keep: str = "first", pad: Column | None = None) -> DataFrame:
    """P-11: a list cut or padded to ``n`` slots, its validity mask and a truncation flag.

    ``keep`` is 'first' for objects and 'last' for events; padding goes to the end.
    """
    a = F.col(column)
    kept = F.slice(a, 1, n) if keep == "first" else F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)
    filler = F.lit(0) if pad is None else pad
    missing = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    return df.withColumns(
        {
            f"{column}_slots": F.concat(kept, F.array_repeat(filler, missing)),
            f"{column}_valid": F.concat(F.array_repeat(F.lit(1.0), F.least(F.size(a), F.lit(n))), F.array_repeat(F.lit(0.0), missing)),
            f"{column}_truncated": F.size(a) > n,
        }
    )


def learning_events(events: Column | str, last_kind: int) -> Column:
    """Events up to the last kind that belongs to the learning window."""
    return F.filter(E.col(events), lambda e: e["event_type"] <= last_kind)


def truncation_flags(df: DataFrame, limits: Mapping[str, tuple[list[str], int]]) -> DataFrame:
    """P-11: {flag: (list columns, limit)} -> true if any of the lists is longer than the limit."""
    out = {}
    for flag, (cols, limit) in limits.items():
        out[flag] = E.any_of([F.size(c) > limit for c in cols])
    return df.withColumns(out)


def resolve_slots(df: DataFrame, focus: str, objects: str, width: int, slots: int | None = None) -> DataFrame:
    """P-12: object ids to slot numbers; unknown ids give -1 and short lists are padded with -1.

    ``objects`` lists the ids by slot; only the first ``slots`` of them are addressable.
    """
    known = F.slice(objects, 1, slots) if slots else F.col(objects)
    return df.withColumn(
        f"{focus}_slots",
        E.let(
            F.struct(F.slice(focus, 1, width).alias("f"), known.alias("o")),
            lambda t: F.concat(
                F.transform(t["f"], lambda x: (F.coalesce(F.array_position(t["o"], x), F.lit(0)) - 1).cast("int")),
                F.array_repeat(F.lit(-1), F.lit(width) - F.size(t["f"])),
            ),
        ),
    )
