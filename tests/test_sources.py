import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import datasets as D
from scoreloom.operators import validation as V
from scoreloom.sources import io as S


def test_matches_skip_blank_lines_and_reject_non_objects(spark, tmp_path):
    good = tmp_path / "m.jsonl"
    good.write_text('{"player_a":"a","player_b":"b","score_a":1.0}\n\n{"player_a":"b","player_b":"a","score_a":0.5}\n')
    assert S.read_matches(spark, str(good)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"player_a":"a"}\nnot json\n')
    with pytest.raises(Exception):
        S.read_matches(spark, str(bad)).collect()


def test_traces_are_canonical_gzip_lines(spark, tmp_path):
    games = spark.createDataFrame([("m1", "é", [(3, 0.25)])], "match_id string, game_trace_sha256 string, decisions array<struct<revision:bigint,latency_seconds:double>>")
    S.write_traces(games, str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("*.gz"))
    text = "".join(gzip.open(f, "rt").read() for f in files)
    assert text == '{"decisions":[{"latency_seconds":0.25,"revision":3}],"game_trace_sha256":"\\u00e9","match_id":"m1"}\n'
    row = S.read_traces(spark, str(tmp_path / "t")).first()
    assert (row.match_id, row.ordinal, row.revision) == ("m1", 0, 3)


def test_trace_summaries_skip_unreadable_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"timestamp": "2024-01-01T00:00:00+00:00", "winner": 1, "end_reason": "life", "events": [{"actor": "x"}] * 3}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"timestamp": "2025-01-01T00:00:00+00:00", "winner": None, "end_reason": "cap", "events": []}))
    (tmp_path / "c.json").write_text("{broken")
    rows = S.trace_summaries(spark, str(tmp_path)).collect()
    assert [(r.id, r.winner, r.num_events) for r in rows] == [("b", None, 0), ("a", 1, 3)]
    ts = spark.range(1).select(S.filename_timestamp(F.lit("2024-01-02T03:04:05.678+00:00"))).first()[0]
    assert ts == "20240102T030405_678Z"


def test_shards_keep_only_common_optional_columns_and_offset_games(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, 0.5, 0.1), (3, 2, 0.5, 0.2)], "game_index long, action int, scores double, root_value double")
    b = spark.createDataFrame([(0, 7, 0.5)], "game_index long, action int, scores double")
    a.write.parquet(str(tmp_path / "a.parquet"))
    b.write.parquet(str(tmp_path / "b.parquet"))
    out = S.load_shards(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], [4, 2])
    assert "root_value" not in out.columns and "scores" in out.columns
    got = {(r["round"], r.action): r.game_index for r in D.offset_games(out).collect()}
    assert got == {(2, 7): 0, (4, 1): 1, (4, 2): 4}
    assert {r["round"] for r in S.load_shards(spark, [str(tmp_path / "b.parquet")]).collect()} == {-1}


def test_shard_names_are_cut_without_a_pattern_and_rounds_do_not_shuffle_the_rows(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1)], "game_index long, action int")
    for path in ("a.b.parquet", "part-x/c", "part-d.parquet"):
        rows.write.parquet(str(tmp_path / path))
    paths = [str(tmp_path / p) for p in ("a.b.parquet", "part-x/c", "part-d.parquet")]
    out = S.load_shards(spark, paths, [1, 2, 3])
    assert {(r.shard, r["round"]) for r in out.collect()} == {("a.b", 1), ("c", 2), ("part-d", 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_npz_shards(spark, tmp_path):
    np.savez(tmp_path / "s0.npz", action=np.array([1, 0], np.int16), game_index=np.array([5, 6]), seat=np.array([0, 1]), num_valid=np.array([2, 1]),
             winner=np.array([-1, 1], np.int8), actions_valid=np.ones((2, 3), np.float32), visit_counts=np.eye(2, 3, dtype=np.float32), provenance=np.array('{"round": 3}'),
             board=np.arange(12, dtype=np.int8).reshape(2, 2, 3), condition_weight=np.array([0.25, 0.75]), other=np.zeros(5))
    rows = S.read_npz_shards(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.winner for r in rows] == [None, 1] and rows[0].scores is None and rows[1].visit_counts == [0.0, 1.0, 0.0]
    assert json.loads(rows[0].provenance)["round"] == 3
    assert rows[1].tensors == {"board": [6.0, 7.0, 8.0, 9.0, 10.0, 11.0], "condition_weight": [0.75]}


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    configs = spark.createDataFrame([(1, *['{"seed": 7, "n": {"x": 1}}'] * 6)], "run_id int, " + ", ".join(f"{f}_json string" for f in S.RUN_CONFIG_FIELDS))
    S.append_run(spark.createDataFrame([(1, "lab", "running")], "run_id int, label string, status string"), configs, root)
    ev = spark.createDataFrame([(1, 2, 10, "final", float("nan")), (1, 1, 10, "baseline", 0.4)], "run_id int, id int, step int, kind string, win_rate double")
    cs = spark.createDataFrame([(1, 2, "all", "land+pass", 3.0), (1, 2, "all", "none", 1.0)], "run_id int, evaluation_id int, scope string, choice_set string, count double")
    S.append_evaluation(ev, cs, None, root)
    S.append_status(spark.createDataFrame([(1, 1, "running", "first"), (1, 2, "completed", None)], "run_id int, seq int, status string, notes string"), root)
    S.append_report(spark.createDataFrame([(1, 1, "summary")], "run_id int, id int, report_kind string"), root)
    assert [(r.id, r.win_rate) for r in S.get_evaluations(S.read_store(spark, root, "evaluations"), 1).collect()] == [(1, 0.4), (2, None)]
    assert S.get_choice_sets(S.read_store(spark, root, "evaluation_choice_sets")).first()["counts"] == {"land+pass": 3.0, "none": 1.0}
    status = S.latest_run_status(S.read_store(spark, root, "run_status")).first()
    assert (status.status, status.notes) == ("completed", "first")
    cfg = S.get_run_configs(S.read_store(spark, root, "run_configs"), 1, {"train": "seed int, n struct<x:int>"}).first()
    assert cfg.train.seed == 7 and S.get_reports(S.read_store(spark, root, "reports"), 1).count() == 1


def test_receipts_and_snapshot_mutations(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"shard_{i}.bin").write_bytes(bytes([i]) * (i + 1))
    files = S.file_receipts(spark, str(tmp_path))
    got = {r.path: (r.bytes, r.sha256) for r in files.collect()}
    assert got["shard_2.bin"] == (3, hashlib.sha256(b"\x02\x02\x02").hexdigest())
    m = files.select(F.regexp_extract("path", r"(\d)", 1).cast("int").alias("shard_index"), "path", "sha256", F.lit(8).alias("num_games"), F.lit(100).alias("decisions"), F.lit(0).alias("game_offset"), F.lit("run").alias("run_fingerprint"))
    records, totals, bad = D.freeze_prefix(m, files, 3, "run")
    assert bad.count() == 0 and totals.first()["games"] == 24 and records.count() == 3
    fail = lambda man, fl, n=3: {r.rule for r in D.freeze_prefix(man, fl, n, "run")[2].collect()}
    assert fail(m, files, 4) == {"missing_index"}
    assert fail(m.withColumn("sha256", F.lit("0")), files) == {"digest_mismatch"}
    assert fail(m.unionByName(m.limit(1)), files) >= {"duplicate_index"}
    assert fail(m, files.filter("path <> 'shard_1.bin'")) == {"missing_file"}
    assert D.verify_snapshot(files, files).count() == 0
    assert {r.rule for r in D.verify_snapshot(files, files.limit(2)).collect()} == {"missing"}


def test_split_by_game_has_no_leakage(spark):
    df = spark.range(2000).select((F.col("id") % 95).alias("game_index"), "id").repartition(7)
    out = D.split_by_game(df, 0.1, 3)
    per = out.groupBy("game_index").agg(F.countDistinct("is_validation").alias("n"), F.first("is_validation").alias("v"))
    assert per.filter("n <> 1").count() == 0 and per.filter("v").count() == round(95 * 0.1) and out.count() == 2000
    again = {r.game_index for r in D.split_by_game(df.repartition(2), 0.1, 3).filter("is_validation").collect()}
    assert again == {r.game_index for r in per.filter("v").collect()}


def match_row(**change):
    row = {"match_id": "1", "player_a": "a", "player_b": "b", "cell_id": "a__b", "leg": 0, "player_a_seat": 0, "winner": 0, "score_a": 1.0, "truncated": False, "terminated": True,
           "termination_reason": "life", "trace_sha256": "x", "game_trace_sha256": "x", "trace_path": "traces/a__b.commands.jsonl.gz"}
    return {**row, **change}


@pytest.mark.parametrize(
    "change,rule",
    [({}, None), ({"cell_id": "b__a"}, "cell_identity"), ({"leg": 1}, "leg_is_seat"), ({"score_a": 0.5}, "score_matches_winner"), ({"winner": None}, "score_matches_winner"),
     ({"truncated": True}, "truncation_reason"), ({"terminated": False}, "terminal"), ({"trace_sha256": "y"}, "trace_digest"), ({"trace_path": "/abs"}, "relative_path"),
     ({"trace_path": "traces/../x"}, "relative_path")],
)
def test_match_rows_flag_each_mutation(spark, change, rule):
    schema = "match_id string, player_a string, player_b string, cell_id string, leg int, player_a_seat int, winner int, score_a double, truncated boolean, terminated boolean, termination_reason string, trace_sha256 string, game_trace_sha256 string, trace_path string"
    row = match_row(**change)
    got = {r.rule for r in V.violations_match_rows(spark.createDataFrame([tuple(row[f.split()[0]] for f in schema.split(", "))], schema)).collect()}
    assert (rule in got) if rule else (got == set())


def test_forbidden_keys_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a":[{"hand":1}]}'), (2, '{"hands":{"b":[]}}')], "id int, doc string")
    assert [r.key for r in V.violations_forbidden_keys(df, "id", "doc", ["hand"]).collect()] == ["1"]
