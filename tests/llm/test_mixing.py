import pytest

from scoreloom.llm import mixing
from tests.llm.util import SF, by_sql, rows_of


def fill(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by handing out the budget again and again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if sizes[s] * repeats <= level * weight[s]}
        for s in full or free:
            target[s] = sizes[s] * repeats if full else level * weight[s]
        left -= sum(target[s] for s in full)
        free -= full or free
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target long")


ROWS = [(i, "w " * (i % 7), "abc"[i % 3] if i % 11 else None, 1, 1) for i in range(300)] + [(900, None, "a", 1, 1), (901, "one", "zz", 1, 1), (902, "", "empty", 1, 1)]


def test_targets_and_taken(spark):
    got = mixing.mix_counts(table(spark, ROWS)).collect()
    sizes = {}
    for _, text, source, _, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target, taken = fill(sizes), {}
    assert len(got) == len(ROWS)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.times <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.times
    assert all(abs(taken[s] - target[s]) <= 14 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_mixed_rows_and_reruns(spark):
    df = table(spark, ROWS)
    counts = {r.doc_id: r.times for r in mixing.mix_counts(df.repartition(5)).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}


def test_repeated_rows_and_empty_table(spark):
    df = table(spark, [(1, "a b c", "x", 0, 0)] * 4 + [(2, "a", None, 0, 0)])
    got = mixing.mix_counts(df).collect()
    assert len(got) == 5 and len({r.times for r in got if r.doc_id == 1}) == 1
    assert mixing.mix_counts(df.limit(0)).collect() == []
    assert mixing.mixed(df.limit(0)).collect() == []


def test_only_empty_texts(spark):
    got = mixing.mix_counts(table(spark, [(1, "", "x", 0, 0), (2, None, "y", 0, 0)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.times) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op4_mixing"](spark, SF)) == by_sql(mixing.ORACLE)
