"""Queries against their SQL on tables laid out or grown as larger ones are."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.verify import TABLES, norm

SF = "/root/testdata/sf0.001"


def folder(tmp_path, **changed):
    """A data folder with some tables replaced by folders of files, the others linked."""
    for t in TABLES:
        if t in changed:
            changed[t].write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def equals_sql(spark, name, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    index = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(index) == cols
    want = sorted(tuple(norm(r[index[c]]) for c in cols) for r in cur.fetchall())
    assert want
    assert got == want


def test_declared_repeats_of_root_stability(spark):
    equals_sql(spark, "A22_root_stability", SF)


def test_streams_read_a_file_and_a_folder_of_files(spark, tmp_path):
    chats = spark.read.parquet(f"{SF}/conversations.parquet").repartition(3, "conv_id")
    sf = folder(tmp_path, conversations=chats)
    equals_sql(spark, "Z02_ledger_stream", sf)
    equals_sql(spark, "Z03_running_health", sf)


def test_rss_violations_of_high_event_numbers(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + 2_000_000)
    equals_sql(spark, "W18_rss_violations", folder(tmp_path, events=events))


def test_declared_intervals_of_repeated_names(spark, tmp_path):
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet")
    again = suppliers.withColumn("s_suppkey", F.col("s_suppkey") + 7 * 1000)
    sf = folder(tmp_path, supplier=suppliers)
    equals_sql(spark, "R17_declared_intervals", sf)
    # Equal names are paired once, in more tasks than the table has files.
    from scoreloom.plans.rating_queries import _declared_differences
    from scoreloom.plans.roles import Tables

    (tmp_path / "twice").mkdir()
    both = _declared_differences(Tables(spark, folder(tmp_path / "twice", supplier=suppliers.unionByName(again))))
    once = _declared_differences(Tables(spark, sf))
    assert sorted(both.collect()) == sorted(once.collect())


def test_store_of_many_runs_has_few_folders(spark, tmp_path):
    from scoreloom.sources import io as S

    root = str(tmp_path / "store")
    rows = spark.range(4000).select(F.col("id").alias("run_id"), F.col("id"), F.rand(1).alias("win_rate"))
    assert S.append_table(rows, root, "evaluations").count() == 0
    assert S.append_table(rows.filter("id % 2 = 0").withColumn("win_rate", F.lit(0.5)), root, "evaluations").count() == 2000
    assert len([f for f in os.listdir(f"{root}/evaluations") if "=" in f]) <= S.STORE_BUCKETS
    assert sorted(S.read_store(spark, root, "evaluations").collect()) == sorted(rows.collect())


def test_task_sizes_are_bounded_unless_the_session_sets_them(spark):
    from scoreloom.plans.roles import TASK_SIZES, Tables

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for k in TASK_SIZES:
        spark.conf.unset(k)
    spark.conf.set(key, "50m")
    Tables(spark, SF)
    assert spark.conf.get(key) == "50m"
    spark.conf.unset(key)
    Tables(spark, SF)
    assert {k: spark.conf.get(k) for k in TASK_SIZES} == {k: size for k, (_, size) in TASK_SIZES.items()}


def test_resource_caps_of_repeated_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    equals_sql(spark, "G08_resource_caps", folder(tmp_path, events=events.unionByName(events)))


@pytest.mark.parametrize("name", ["J08_project_objects", "J08_project_object_violations"])
def test_objects_of_keys_below_zero_unknown_and_repeated(spark, tmp_path, name):
    part, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "lineitem"))
    below = part.withColumns({"p_partkey": -F.col("p_partkey"), "p_size": 60 - F.col("p_size")})
    third = lambda c, r: F.when(F.col("l_orderkey") % 5 != r, F.col(c))
    odd = lines.withColumns({"l_partkey": F.when(F.col("l_orderkey") % 7 != 3, third("l_partkey", 1)).otherwise(9_000_000), "l_suppkey": third("l_suppkey", 2)})
    odd = odd.unionByName(lines.withColumns({"l_partkey": -F.col("l_partkey"), "l_orderkey": F.col("l_orderkey") + 1_000_000}))
    equals_sql(spark, name, folder(tmp_path, part=part.unionByName(part).unionByName(below), lineitem=odd))


def test_beliefs_from_unknown_weights(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.when(F.col("event_id") % 9 != 4, F.col("value")))
    equals_sql(spark, "B05_from_weights", folder(tmp_path, events=events))


def test_holdout_audit_shuffles_words_of_training_once_each(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    sf = folder(tmp_path, documents=again)
    equals_sql(spark, "J11_holdout_audit", sf)
    # No pair of a training document and a word is shuffled.
    plan = entry.queries()["J11_holdout_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Aggregate [program" in line and "atom" in line.split("], [")[0]]
    assert not pairs


def test_match_rows_are_written_packed(spark, tmp_path, monkeypatch):
    from scoreloom.sources import io as S

    monkeypatch.setattr(S, "scratch_folder", lambda spark, name: str(tmp_path / name))
    equals_sql(spark, "S01_read_matches", SF)
    rows = [f for f in os.listdir(tmp_path / "matches") if f.startswith("part-")]
    assert rows and all(f.endswith(".json.gz") for f in rows)


@pytest.mark.parametrize("name", ["B09_transport", "B09_transition_links"])
def test_pools_are_read_once(spark, name):
    # The draws, the worlds and the links each took their own pass over all line items.
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan and "FileScan" not in plan


def test_bundle_reads_line_items_once(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    again = lines.withColumn("l_partkey", F.when(F.col("l_orderkey") % 50 == 7, 9).when(F.col("l_orderkey") % 50 == 9, 5).otherwise(F.col("l_partkey")))
    sf = folder(tmp_path, lineitem=again.unionByName(lines.filter("l_orderkey % 9 = 2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is known to be small at any size is sent all the same
    try:
        plan = entry.queries()["V13_bundle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        equals_sql(spark, "V13_bundle", sf)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "lineitem.parquet" not in plan and "matches-" in plan
    assert not spark.catalog.listTables(pattern="kept_matches*")


def test_declared_differences_are_no_product_of_shuffled_rows(spark):
    from scoreloom.plans.rating_queries import _declared_differences
    from scoreloom.plans.roles import Tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _declared_differences(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
