import random

import numpy as np
import pytest

from scoreloom.llm import ngram_join
from scoreloom.llm.components import connected_components
from tests.llm.util import ODD, by_sql, classes, rows_of, words


def documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8)))
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 9])):
            other = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(base).upper())  # equal words, another text
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [3, 256])
def test_equals_all_pairs(spark, block):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df, block=block).collect()}
    assert got == classes(docs)


def test_long_texts_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(20_000))
    docs = [(5, base, 1, 2, 3), (9, base.replace("w77 ", "zz "), 1, 2, 3), (7, "other words only here now", 1, 2, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, node long, bands long, label long")
    got = {r.doc_id: (r.class_id, r.n_links, r.copies) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {5: (5, 1, 1), 9: (5, 1, 1), 7: (7, 0, 1)}
    kept = ngram_join.first_of_each_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7]


def test_repeated_rows_are_copies(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (3, None), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.copies) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(1, 1, 3, 4)] * 3 + [(2, 1, 3, 4)] + [(3, 3, 0, 1)] * 2
    assert sorted(r.doc_id for r in ngram_join.first_of_each_class(df).collect()) == [1, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(df).collect() == []
    assert ngram_join.first_of_each_class(df).collect() == []


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES
    from tests.llm.util import SF

    assert rows_of(QUERIES["op5_ngram_jaccard_join"](spark, SF)) == by_sql(ngram_join.ORACLE)


def test_band_count_reaches_recall():
    for rows in (4, 8):
        n = ngram_join.band_count(0.8, 0.999, rows)
        assert 1 - (1 - 0.8**rows) ** n >= 0.999 > 1 - (1 - 0.8**rows) ** (n - 1)


def test_overlaps():
    rng = np.random.default_rng(3)
    for n in (3, 40):
        sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000))) for _ in range(n)]
        got = ngram_join.overlaps(sets)
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(n) for j in range(n))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in connected_components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    for nodes, n in ((60, 30), (60, 70), (300, 260), (30, 300)):
        edges = [(rng.randrange(nodes) - 20, rng.randrange(nodes) - 20) for _ in range(n)]
        near = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = {}
        for a in near:
            seen, todo = {a}, [a]
            while todo:
                for b in near[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            want[a] = min(seen)
        rows = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert len(rows) == len(want) and {r.node: r.label for r in rows} == want


def test_a_large_family_has_few_edges(spark, monkeypatch):
    """Near copies are tied to a few of them, not each to many; the number of candidate edges is proportional to the texts."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(1500):
        other = list(base)
        other[rng.randrange(120)] = f"x{k}"
        texts.append((k, " ".join(other)))
    seen = []
    real = ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda e, a, b: seen.append(e.where(f"{a} != {b}").select(a, b).distinct().count()) or real(e, a, b))
    got = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), block=64).collect()
    assert all(r.class_id == 0 for r in got) and {r.n_links for r in got} == {1499}
    assert all(n <= 4 * len(texts) for n in seen), seen


def test_words_of_fixture_are_not_trivial():
    assert sum(len(words(t)) > 0 for _, t in documents()) > 40
