import pytest
from pyspark.sql import functions as F

from scoreloom.operators import validation as V
from scoreloom.operators.ratings import missing_pairs
from scoreloom.sources import io as S

TABLES = {
    "rating": ("player string, elo double", [("a", 0.0), ("b", 12.5)]), "payoff": ("cell_id string, draws long", [("a__b", 3), ("a__c", 1)]),
    "competency": ("player string, tasks array<int>", [("a", [1, 2]), ("b", None)]), "cost": ("block int, seconds double", [(0, 1.25), (1, None)]),
    "root": ("root string, stable boolean", [("r", True)]), "decision": ("player string, verdict string", [("a", "keep"), ("b", "\\N")]),
}


def test_digest_is_of_the_multiset(spark):
    df = spark.createDataFrame([(k % 5, f"t{k % 7}", k / 3) for k in range(200)], "a int, b string, c double")
    whole = V.multiset_digest(df).first()
    assert V.multiset_digest(df.repartition(9).select("c", "a", "b")).first() == whole and whole.rows == 200
    assert V.multiset_digest(df.unionByName(df.limit(1))).first().digest != whole.digest
    assert V.multiset_digest(df.limit(0)).first().digest == "0" * 64
    assert V.multiset_digest(df.withColumn("c", F.col("c") + 1e-12)).first() == whole


@pytest.mark.parametrize("name", list(TABLES))
def test_one_mutation_gives_its_own_violation(spark, name):
    frames = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in TABLES.items()}
    stored = {n: f.repartition(3) for n, f in frames.items()}
    assert V.violations_artifacts({n: (stored[n], frames[n]) for n in frames}).count() == 0
    schema, rows = TABLES[name]
    last = rows[-1][-1]
    other = {bool: lambda x: not x, str: lambda x: x + "x", int: lambda x: x + 1, float: lambda x: x + 0.5, type(None): lambda x: [9] if "array" in schema else 9.0}[type(last)](last)
    stored[name] = spark.createDataFrame([*rows[:-1], (*rows[-1][:-1], other)], schema)
    assert [(r.rule, r.key) for r in V.violations_artifacts({n: (stored[n], frames[n]) for n in frames}).collect()] == [("artifact_mismatch", name)]
    stored[name] = frames[name].drop(frames[name].columns[-1])
    assert [(r.rule, r.key) for r in V.violations_artifacts({n: (stored[n], frames[n]) for n in frames}).collect()] == [("artifact_columns", name)]


def test_declared_digests(spark):
    shards = spark.createDataFrame([(k % 4, f"g{k}") for k in range(40)], "shard int, trace string")
    actual = V.multiset_digest(shards, by=["shard"])
    declared = spark.createDataFrame([(r.shard if r.shard != 2 else 7, r.digest if r.shard != 1 else "0") for r in actual.collect()], "shard int, digest string")
    got = {(r.rule, r.key) for r in V.violations_digests("trace", declared, actual, "shard").collect()}
    assert got == {("trace_missing", "7"), ("trace_undeclared", "2"), ("trace_digest", "1")}


def test_missing_pairs(spark):
    names = [f"p{k:03d}" for k in range(120)]
    every = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    gone = {every[k] for k in (0, 1, 118, 119, 500, 3000, len(every) - 1, len(every) - 2)} | {(names[50], b) for b in names[51:]}
    spine = spark.createDataFrame([(n,) for n in names], "player string")
    seen = spark.createDataFrame([p for p in every if p not in gone] * 2 + [("p000", "stranger"), ("p009", "p003"), ("p005", "p005")], "a string, b string")
    got = [(r.a, r.b) for r in missing_pairs(spine, seen).collect()]
    assert len(got) == len(set(got)) and set(got) == gone
    slots = spine.select("player", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"))
    keyed = missing_pairs(slots, seen.withColumn("slot", F.lit(1)), ["slot"])
    assert keyed.filter("slot = 1").count() == len(gone) and keyed.filter("slot = 2").count() == len(every)


@pytest.mark.parametrize("size", [1, 62, 63, 64, 65, 130])
def test_missing_pairs_around_full_words(spark, size):
    names = [f"p{k:03d}" for k in range(size)]
    every = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    spine = spark.createDataFrame([(n,) for n in [*names, *names, None]], "player string")
    whole = spark.createDataFrame([*every, ("p000", None), (None, "p001")], "a string, b string")
    assert missing_pairs(spine, whole.unionByName(whole)).count() == 0
    assert missing_pairs(spine, whole.limit(0)).count() == len(every)
    gone = {p for k, p in enumerate(every) if k % 7 == 3 or p[1] in (names[-1], names[size // 2]) or p[0] == names[size // 3]}
    got = [(r.a, r.b) for r in missing_pairs(spine, whole.filter(~F.concat("a", "b").isin([a + b for a, b in gone]))).collect()]
    assert len(got) == len(set(got)) and set(got) == gone


def test_missing_pairs_shuffles_no_names_of_pairs(spark):
    spine = spark.createDataFrame([(f"p{k}",) for k in range(9)], "player string")
    seen = spark.createDataFrame([("p1", "p2")], "a string, b string")
    plan = missing_pairs(spine, seen)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "hashpartitioning(a#" in line or "hashpartitioning(b#" in line]


@pytest.mark.parametrize("shipped", [1_000_000, 0])
def test_bundle_rules_of_repeated_unknown_and_lost_rows(spark, monkeypatch, shipped):
    monkeypatch.setattr(V, "SHIPPED_ROWS", shipped)
    rows = [(f"t{k}", f"m{k}", k % 4, (k % 4) + 10) for k in range(40)]
    rows += [("t1", "m1", 1, 11), ("t2", "other", 2, 12), (None, "m50", 0, 10), (None, "m51", 3, None), ("t52", None, None, 13), ("t53", "m53", 9, 19), ("t54", "m54", 1, 12)]
    held = [(f"t{k}", f"m{k}") for k in range(40) if k % 9 != 4] + [("t3", "m3"), ("t5", "m6"), ("t60", "m60"), ("t60", "m60"), (None, "m50"), ("t52", None)]
    seeds = [(0, 10), (1, 11), (1, 12), (2, 12), (3, 13), (3, 13), (None, 13)]
    cols = {"player_a": F.lit("a"), "player_b": F.lit("b"), "leg": F.lit(0), "player_a_seat": F.lit(0), "score_a": F.lit(1.0), "truncated": F.lit(False), "termination_reason": F.lit("terminal")}
    matches = spark.createDataFrame(rows, "game_trace_sha256 string, match_id string, deal_block long, deal_seed long").withColumns(cols)
    players = spark.createDataFrame([("a",), ("b",)], "player string")
    got = V.violations_bundle(matches, players.withColumnRenamed("player", "player_id"), spark.createDataFrame(held, "game_trace_sha256 string, match_id string"),
                              players, 4, spark.createDataFrame(seeds, "deal_block long, deal_seed long"))
    want = [("row_without_trace", m) for t, m, *_ in rows if None in (t, m) or (t, m) not in held]
    want += [("trace_without_row", m) for t, m in held if None in (t, m) or (t, m) not in [r[:2] for r in rows]]
    digests = [t for t, *_ in rows]
    want += [("trace_digest_repeated", t) for t in set(digests) if digests.count(t) > 1]
    for _, m, block, seed in rows:
        own = [s for b, s in seeds if b == block] if block is not None else []
        want += [("deal_seed", m)] * (sum(s != seed for s in own) if own else 1)
    found = [(r.rule, r.key) for r in got.collect() if not r.rule.startswith("schedule_")]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_digests_that_agree_are_not_shuffled_as_texts(spark):
    rows = spark.createDataFrame([(f"t{k}", f"m{k}") for k in range(99)], "game_trace_sha256 string, match_id string")
    bound, traced = V._bound_apart(rows, rows.filter("match_id <> 'm7'").unionByName(rows.limit(1)))
    assert {r.match_id for r in bound.collect()} == {"m7", rows.first().match_id} and traced.count() == 2


def test_receipts_by_chunks(spark, tmp_path):
    import hashlib

    contents = {"one": b"x", "even": bytes(range(256)) * 4, "odd": b"abc" * 1001}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path: (r.bytes, r.sha256) for r in S.file_receipts(spark, str(tmp_path), chunk=64).collect()}
    assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in contents.items()}


def test_appends_by_key(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "run_id int, id int, win_rate double")
    first = frame([(1, 1, 0.5), (1, 2, float("nan")), (2, 1, 0.25)])
    assert S.append_table(first, root, "evaluations").count() == 0
    assert S.append_table(first, root, "evaluations").count() == 0
    clash = S.append_table(frame([(1, 1, 0.75), (1, 3, 0.1), (1, 3, 0.1)]), root, "evaluations")
    assert [(r.rule, r.key) for r in clash.collect()] == [("key_clash", "evaluations/1/1")]
    got = sorted((r.run_id, r.id, r.win_rate) for r in S.read_store(spark, root, "evaluations").collect())
    assert got == [(1, 1, 0.5), (1, 2, None), (1, 3, 0.1), (2, 1, 0.25)]
