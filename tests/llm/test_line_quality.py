import itertools

import numpy as np
import pytest

from scoreloom.llm import line_quality as Q
from tests.llm.util import ODD

GOOD = "This is a plain sentence about the weather in town.\nAnother one follows it, and says a little more."
BAD = "BUY!! NOW!! CHEAP!! PILLS!!\nclick | here | click | here | click | here"


def test_passes_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        emit, move = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(e for e, k in zip(emit, y) if k) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        left, right = Q.Chains(np.array([0, n])).run(emit, move)
        for t in range(n):
            assert Q._sigmoid(left + right)[t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)


def test_chains_side_by_side_equal_single_ones():
    rng = np.random.default_rng(1)
    at = np.array([0, 3, 4, 9, 11])
    emit, move = rng.normal(size=11), rng.normal(size=(2, 2))
    left, right = Q.Chains(at).run(emit, move)
    for a, b in zip(at[:-1], at[1:]):
        l, r = Q.Chains(np.array([0, b - a])).run(emit[a:b], move)
        assert np.allclose(left[a:b], l) and np.allclose(right[a:b], r)


def test_measurements():
    x, size, at = Q.line_measurements([GOOD.encode(), None, b"", BAD.encode(), b"a\na\n"])
    assert at.tolist() == [0, 2, 3, 4, 6, 9] and x.shape == (9, Q.WIDTH) and np.isfinite(x).all()
    assert size.tolist()[:4] == [len(s) for s in GOOD.split("\n")] + [0, 0]
    assert x[4, 5] == 1 and x[0, 5] == 0  # mostly capitals
    assert x[7, 22] == 1 and x[6, 22] == 0  # the line before says the same


def labelled(spark, n=240):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(n):
        good = int(rng.random() < 0.6)
        lines = [(GOOD if good else BAD).split("\n")[rng.integers(2)] + f" {rng.integers(99)}" for _ in range(rng.integers(1, 7))]
        docs.append((k, "\n".join(lines), 7.0, 0))
        labels.append((k, good, 0))
    schema = "doc_id long, text string, score double, quality int"
    odd = [(1000 + k, t, 7.0, 0) for k, t in enumerate(ODD)]
    return spark.createDataFrame(docs + odd, schema), spark.createDataFrame(labels + [(None, 1, 0), (3, 9, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int"), dict((i, g) for i, g, _ in labels)


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels, truth = labelled(spark)
    model = Q.train(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(unseen) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    model = Q.LineModel(rng.normal(size=3 * Q.WIDTH + 2), 0.3, rng.normal(size=(2, 2)), np.zeros(3 * Q.WIDTH + 2), np.ones(3 * Q.WIDTH + 2))
    texts = [None if t is None else t.encode() for t in ODD] + [GOOD.encode(), BAD.encode() * 30]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_no_labels_and_empty_table(spark):
    docs, labels, _ = labelled(spark, 5)
    model = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, model).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).collect() == [] and Q.keep_good(docs.limit(0), model).collect() == []
    assert np.array_equal(Q.train(docs.limit(0), labels).weights, Q.neutral_model().weights)


def test_one_class_only(spark):
    docs, labels, _ = labelled(spark)
    rows = Q.score(docs, Q.train(docs, labels.where("quality = 1"))).collect()
    assert all(np.isfinite(r.score) for r in rows)


def test_sample_is_whole_documents_within_its_bounds(spark):
    docs, labels, truth = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    every = Q.train_sample(docs, labels).collect()
    wanted = {k for k in truth if k in texts} - {r.doc_id for r in Q.score(docs, Q.neutral_model()).where("held_out").collect()}
    assert {r.doc_id for r in every} == wanted and all(r.text == texts[r.doc_id] and r.quality == truth[r.doc_id] for r in every)
    some = Q.train_sample(docs, labels, train_lines=320).collect()
    lines = sum(r.text.count("\n") + 1 for r in some)
    assert 300 < lines <= 320 and {r.doc_id for r in some} < wanted
    assert len(Q.train_sample(docs, labels, train_docs=17).collect()) == 17
    long = docs.select("doc_id", Q.F.repeat(Q.F.concat("text", Q.F.lit("\n")), 200).alias("text"))
    assert all(r.text.count("\n") + 1 <= 10_000 // 32 for r in Q.train_sample(long, labels, train_lines=10_000).collect())
    assert len(Q.train_sample(docs.union(docs), labels).collect()) == len(wanted)
