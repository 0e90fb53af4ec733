import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "A01_matchup_summary", "A06_evaluation_metrics", "A25_cell_summary", "A29_span_tree", "C01_reliability_summary", "D01_split_overlap", "G01_gates", "J05_continuation",
    "R13_spearman", "S13_report_rows", "V01_match_rows", "W04_select_landmarks", "X02_split_pairs",
]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_registry_names_follow_operator_ids():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(re.match(r"[A-Z]\d\d_|op\d+_|pipeline$", n) for n in names)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    index = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(index) == cols
    assert got == sorted(tuple(norm(r[index[c]]) for c in cols) for r in cur.fetchall())
