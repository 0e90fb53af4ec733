import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import tracking as T
from scoreloom.operators import worlds as B

POOL = {"a": 3, "b": 4, "c": 2}
MOVES = "game string, viewer int, sequence bigint, before_revision bigint, after_revision bigint, before_space string, after_space string, acting int, commitment_kind string, exits array<string>, returns array<string>, hidden_draws int"
NONE = "game string, viewer int, sequence bigint, world_index bigint, likelihood double, legal int, matching int"


def spaces(spark, rows):
    return spark.createDataFrame(rows, "space_id string, pool map<string,int>, hand_size int")


def test_links_are_what_transport_does(spark):
    """Exits, returns and two draws: the links of each source add up to 1 and give the same belief as the transport by steps."""
    before = spaces(spark, [("s", POOL, 4)])
    both = before.unionByName(spaces(spark, [("t", {"a": 2, "b": 4, "c": 3}, 6)]))
    worlds = B.enumerate_worlds(both)
    moves = T.moves(spark.createDataFrame([("g", 0, 0, 1, 2, "s", "t", 1, None, ["a"], ["c"], 2), ("h", 1, 0, 1, 2, "s", "t", 1, None, ["a"], ["c"], 2)], MOVES))
    links = T.transition_links(moves, both, worlds)
    assert moves.count() == 1
    sums = [r.s for r in links.groupBy("source").agg(F.sum("factor").alias("s")).collect()]
    assert sums == pytest.approx([1.0] * len(sums)) and links.filter("target is null").count() == 0
    p = {r.world_index: math.exp(r.log_p) for r in B.prior(worlds.filter("space_id = 's'")).collect()}
    got = {}
    for r in links.collect():
        got[r.hand_key] = got.get(r.hand_key, 0.0) + p[r.source] * r.factor
    facts = spark.createDataFrame([("s", "t", ["a"], ["c"], 2)], "space_id string, next_space_id string, exits array<string>, returns array<string>, hidden_draws int")
    out, bad = B.transport(B.prior(worlds.filter("space_id = 's'")), before, facts, worlds)
    want = {r.hand_key: math.exp(r.log_p) for r in out.filter(F.col("log_p") > B.NEG_INF).collect()}
    total = sum(got.values())
    assert {k: v / total for k, v in got.items()} == pytest.approx(want) and bad.count() == 0


def test_mass_outside_the_next_space_ends_a_key(spark):
    both = spaces(spark, [("s", POOL, 3), ("t", {"a": 1, "b": 4, "c": 2}, 3)])
    worlds = B.enumerate_worlds(both)
    moves = spark.createDataFrame([("g", 0, 0, 1, 2, "s", "t", 1, None, [], [], 0), ("g", 0, 1, 2, 3, "t", "t", 1, None, [], [], 0)], MOVES)
    starts = spark.createDataFrame([("g", 0, 1, "s")], "game string, viewer int, revision bigint, space_id string")
    records, state, bad = T.track(moves, starts, both, worlds, spark.createDataFrame([], NONE), 0.0)
    assert records.collect() == [] and state.collect() == []
    rows = bad.collect()
    assert {r.rule for r in rows} == {"left_support"} and {r.key for r in rows} == {"g|0/a=2;b=1", "g|0/a=2;c=1", "g|0/a=3"}


def test_a_long_game(spark):
    """500 moves of one game next to short ones: draw one, give it back, with a commitment each tenth move."""
    both = spaces(spark, [("s", POOL, 2), ("t", POOL, 3)])
    worlds = B.enumerate_worlds(both)
    rows, n = [], 500
    for k in range(n):
        at, to = ("s", "t") if k % 2 == 0 else ("t", "s")
        rows.append(("long", 0, k, k, k + 1, at, to, 1, "cast" if k % 10 == 0 else None, [] if k % 2 == 0 else ["b"], [], 1 if k % 2 == 0 else 0))
    rows += [(f"short{g}", 0, 0, 0, 1, "s", "t", 1, None, [], [], 1) for g in range(20)]
    starts = spark.createDataFrame([("long", 0, 0, "s"), *((f"short{g}", 0, 0, "s") for g in range(20))], "game string, viewer int, revision bigint, space_id string")
    lik = worlds.filter("space_id = 's'").select(F.lit("long").alias("game"), F.lit(0).alias("viewer"), F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(10))).alias("s"), "world_index")
    lik = lik.select("game", "viewer", F.col("s").cast("bigint").alias("sequence"), "world_index", ((F.col("world_index") + 1) / 10.0).alias("likelihood"), F.lit(2).alias("legal"), F.lit(1).alias("matching"))
    records, state, bad = T.track(spark.createDataFrame(rows, MOVES), starts, both, worlds, lik, 0.1)
    assert bad.count() == 0 and records.count() == n + 20
    assert [r.n for r in records.filter("game = 'long'").agg(F.countDistinct("sequence").alias("n")).collect()] == [n]
    # The same by plain sums over hands.
    table = {(r.space_id, r.world_index): r for r in worlds.collect()}
    keys = {(r.space_id, r.hand_key): r.world_index for r in table.values()}
    belief = {w: math.exp(x) for w, x in ((r.world_index, r.log_p) for r in B.prior(worlds.filter("space_id = 's'")).collect())}
    for k in range(n):
        at, to = ("s", "t") if k % 2 == 0 else ("t", "s")
        if k % 10 == 0:
            belief = {w: p * (0.9 * (w + 1) / 10 + 0.1 / 2) for w, p in belief.items()}
        new = {}
        for w, p in belief.items():
            hand = dict(table[at, w].hand)
            if k % 2 == 0:
                left = {c: POOL[c] - hand.get(c, 0) for c in POOL}
                options = [({**hand, c: hand.get(c, 0) + 1}, m / sum(left.values())) for c, m in left.items() if m > 0]
            else:
                options = [({**hand, "b": hand["b"] - 1}, 1.0)] if hand.get("b", 0) > 0 else []
            for h, f in options:
                key = keys[to, ";".join(f"{c}={m}" for c, m in sorted(h.items()) if m > 0)]
                new[key] = new.get(key, 0.0) + p * f
        total = sum(new.values())
        belief = {w: p / total for w, p in new.items()}
    got = {r.world_index: math.exp(r.log_p) for r in state.filter("space_id = 'long|0'").collect()}
    assert {w: p for w, p in got.items() if p > 1e-300} == pytest.approx({w: p for w, p in belief.items() if p > 1e-300}, rel=1e-6)
