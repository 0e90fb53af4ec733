"""Tables whose columns have the names that operators use inside, and many rows without an id."""

from pyspark.sql import functions as F

from scoreloom.llm import decontaminate, mixing, ngram_join
from scoreloom.llm.tables import free_names
from tests.llm.test_decontaminate import FILLER, ITEM
from tests.llm.util import grams, jaccard

INSIDE = ["__key", "__no_id", "__first", "__words", "__place", "__source", "__size", "__times", "__turn", "__my_place", "_" + "__key", "place", "size", "times", "n"]


def clashing(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in INSIDE])


def held(df, source):
    assert df.columns == source.columns
    rows = df.collect()
    assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in INSIDE)
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__KEY int, ___key int, x int")
    assert free_names(df, "__key", "y", "y") == ["____key", "y", "_y"]


def test_operators_keep_the_callers_columns(spark):
    df = clashing(spark, [(1, FILLER), (2, FILLER), (3, FILLER + " " + ITEM), (None, ITEM), (None, "a b c"), (4, None)])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert held(decontaminate.decontaminated(df, items), df) == [-1, 1, 2, 4]
    apart = jaccard(grams(FILLER), grams(FILLER + " " + ITEM)) < 0.8
    assert held(ngram_join.first_of_each_class(df), df) == [-1, -1, 1] + [3] * apart + [4]
    out = held(mixing.mixed(df), df)
    times = [(-1 if r.doc_id is None else r.doc_id) for r in mixing.mix_counts(df).collect() for _ in range(r.times)]
    assert out == sorted(times) and set(out) >= {1, 2, 3}


def test_ten_thousand_rows_without_an_id_reach_their_target(spark):
    df = spark.range(10_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string"), F.repeat(F.lit(" x"), (F.col("id") % 7).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    taken = mixing.mix_counts(df).groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("n"), F.max("target").alias("target")).collect()
    assert all(abs(r.n - r.target) <= 20 for r in taken) and len(taken) == 2
    assert mixing.mixed(df).agg(F.sum(mixing.text_size())).first()[0] == sum(r.n for r in taken)
