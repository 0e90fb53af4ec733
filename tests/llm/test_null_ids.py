"""Rows without a doc_id in the operators that join their results back to the documents, and in the pipeline."""

from scoreloom.llm import decontaminate, mixing, ngram_join, token_pack
from tests.llm.test_decontaminate import FILLER, ITEM

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE + " more"
OTHER = " ".join(f"o{i}" for i in range(60))
SOME = " ".join(f"s{i}" for i in range(60))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string").repartition(3)


def texts(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_near_duplicates(spark):
    df = table(spark, [(None, BASE), (4, NEAR), (None, OTHER), (None, OTHER.upper()), (None, OTHER + " x"), (None, SOME), (None, ""), (7, SOME)])
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.n_links, r.copies) for r in ngram_join.near_duplicates(df).collect()))
    assert got == sorted([(-1, 4, 1, 1), (4, 4, 1, 1), (-1, -1, 2, 2), (-1, -1, 2, 2), (-1, -1, 2, 1), (-1, 7, 1, 2), (7, 7, 1, 2), (-1, -1, 0, 1)])
    kept = texts(ngram_join.first_of_each_class(df))
    assert [r for r in kept if not r[1].lower().startswith("o0 ")] == sorted([(4, NEAR), (7, SOME), (-1, "")])
    assert len(kept) == 4


def test_decontaminated(spark):
    df = table(spark, [(None, FILLER + " " + ITEM), (None, FILLER), (1, ITEM), (2, FILLER), (None, None)])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontaminate.decontaminated(df, items).collect()]
    assert sorted(kept, key=repr) == sorted([(None, FILLER), (2, FILLER), (None, None)], key=repr)


def test_mixed(spark):
    df = table(spark, [(None, BASE), (None, "a b"), (1, OTHER), (None, None)])
    times = sorted((r.doc_id or -1, r.size) for r in mixing.mix_counts(df).collect() for _ in range(r.times))
    assert any(i == -1 for i, _ in times)
    assert sorted((r.doc_id or -1, len(r.text.split())) for r in mixing.mixed(df).collect()) == times


def test_stages_after_the_classifier(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    df = table(spark, [(None, BASE), (None, NEAR), (None, ITEM), (None, SOME), (5, OTHER)])
    kept = decontaminate.decontaminated(ngram_join.first_of_each_class(df), items)
    assert len(rows := texts(kept)) == 3 and {t for _, t in rows} >= {SOME, OTHER}
    out = mixing.mixed(kept)
    assert sorted(r.doc_id or -1 for r in token_pack.written_and_read(out).collect()) == [i for i, _ in texts(out)]
    assert any(r.doc_id is None for r in out.collect())
