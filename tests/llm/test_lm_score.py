import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import lm_score as L
from tests.llm.util import ODD, words

GOOD = "the cat sat on the mat and the dog sat on the log"
BAD = "buy now cheap pills buy now click here cheap cheap"


def brute(docs, targets, size, smoothing):
    """Leave-one-out losses with exact bigram counts."""
    tokens = {}
    total = Counter(w for _, t in docs for w in words(t))
    order = sorted(total, key=lambda w: (-total[w], int(np.array([word(w)]).view(np.int64)[0])))
    kept = set(order[:size])
    for i, t in docs:
        tokens[i] = [w if w in kept else "<unk>" for w in words(t)]
    v = len(kept) + 1
    out = {}
    for i, _ in docs:
        losses = []
        for which in (set(targets), set(tokens)):
            single, context, pair = Counter(), Counter(), Counter()
            for j in which - {i}:
                w = tokens[j]
                single.update(w)
                context.update(["<s>", *w][: len(w)])
                pair.update(zip(["<s>", *w], w))
            losses.append((single, context, pair))
        n_all, n_target = sum(map(len, tokens.values())), sum(len(tokens[j]) for j in targets)
        sums = []
        for (single, context, pair), scale in zip(losses, (1.0, n_target / n_all)):
            s = 0.0
            for a, b in zip(["<s>", *tokens[i]], tokens[i]):
                one = (single[b] * scale + 1) / (sum(single.values()) * scale + v)
                s -= math.log((pair[a, b] * scale + smoothing * one) / (context[a] * scale + smoothing))
            sums.append(s)
        n = len(tokens[i])
        out[i] = (n, *(x / n for x in sums)) if n else (0, None, None)
    return out


def word(w):
    from scoreloom.llm.textwords import word_hash

    return word_hash(w)


def frames(spark, docs, labels):
    return (spark.createDataFrame([(i, t, "x", True) for i, t in docs], "doc_id long, text string, target string, good boolean"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


DOCS = [(k, GOOD + f" w{k}") for k in range(8)] + [(10 + k, BAD + f" v{k}") for k in range(6)] + [(100 + k, t) for k, t in enumerate(ODD)]
LABELS = [(k, 1, 0) for k in range(5)] + [(5, 1, 1), (6, 0, 0), (10, 0, 0), (7, None, 0), (None, 1, 0), (0, 1, 0)]


@pytest.mark.parametrize("size", [10, 1000])
def test_equals_brute_force(spark, size):
    docs, labels = frames(spark, DOCS, LABELS)
    got = {r.doc_id: r for r in L.cross_entropy_difference(docs.repartition(3), labels, size=size).collect()}
    for i, (n, target, background) in brute(DOCS, range(5), size, L.SMOOTHING).items():
        assert got[i].n_tokens == n
        if n:
            assert (got[i].target_loss, got[i].background_loss) == (pytest.approx(target), pytest.approx(background))
            assert got[i].score == pytest.approx(target - background)
        else:
            assert got[i].target_loss is None and got[i].score is None
    assert max(got[k].score for k in range(8)) < min(got[10 + k].score for k in range(6))


def test_no_targets_repeats_and_empty_table(spark):
    docs, labels = frames(spark, [(1, GOOD), (1, GOOD), (2, None)], [])
    rows = L.cross_entropy_difference(docs, labels).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert L.cross_entropy_difference(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("piece_bytes", [200, 5_000])
def test_many_pieces_equal_one(spark, piece_bytes):
    """Whatever the texts are dealt to, every count meets every document; rows without an id and repeated rows too."""
    docs = spark.createDataFrame([*DOCS, (None, GOOD), (None, BAD), (None, None), (0, GOOD + " w0")], "doc_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    one, many = (sorted(L.cross_entropy_difference(docs, labels, piece_bytes=b).collect(), key=repr) for b in (1 << 30, piece_bytes))
    assert len(one) == len(many) == len(DOCS) + 4
    for a, b in zip(one, many):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_every_word_and_bigram_counts_of_its_own(spark):
    """More words than the former vocabulary held, and more bigrams than fit its slots without sharing them."""
    docs = [(k, " ".join(f"n{k}x{j % 1_000}" for j in range(1_500))) for k in range(80)] + [(900, GOOD), (901, GOOD + " z"), (902, BAD)]
    frame, labels = frames(spark, docs, [(900, 1, 0), (3, 1, 0)])
    pairs = L.bigram_counts(L.mark_target(frame, labels)).collect()
    exact = Counter(pair for _, t in docs for pair in zip(["<s>", *words(t)], words(t)))
    assert sorted(r.seen for r in pairs) == sorted(exact.values())
    assert len({r.word for r in pairs}) == len({w for _, t in docs for w in words(t)}) > 65_534
    got = {r.doc_id: r for r in L.cross_entropy_difference(frame, labels).collect()}
    lists, v = {i: words(t) for i, t in docs}, len({w for _, t in docs for w in words(t)}) + 1
    share = sum(len(lists[i]) for i in (900, 3)) / sum(map(len, lists.values()))
    for i in (3, 7, 901):
        for name, which, scale in (("target_loss", {900, 3} - {i}, 1.0), ("background_loss", set(lists) - {i}, share)):
            single, context, pair = Counter(), Counter(), Counter()
            for j in which:
                single.update(lists[j])
                context.update(["<s>", *lists[j]][:-1])
                pair.update(zip(["<s>", *lists[j]], lists[j]))
            n, loss = sum(single.values()) * scale + v, 0.0
            for a, b in zip(["<s>", *lists[i]], lists[i]):
                loss -= math.log((pair[a, b] * scale + L.SMOOTHING * (single[b] * scale + 1) / n) / (context[a] * scale + L.SMOOTHING))
            assert got[i][name] == pytest.approx(loss / len(lists[i]))


def test_memory_of_a_piece_and_of_a_range():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.2, 2000) % 40_000) for _ in range(400)]
    docs = pa.table({"piece": pa.array([0] * len(texts), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    good = pa.table({"id": pa.array(range(0, len(texts), 3), pa.int64())})

    def peak(run, *tables):
        tracemalloc.start()
        out = run(*tables)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / sum(map(len, texts))

    requests, asked = peak(L._requests(1, None), docs, good)
    replies, answered = peak(L._replies, requests)
    other = replies.select(["range", "seen", "wanted"]).append_column("id", pa.nulls(replies.num_rows, pa.int64()))
    scores, scored = peak(L._scores(None, 40_000, 800_000, 270_000, 20.0), docs, other)
    assert scores.num_rows == len(texts)
    # Bytes held at once for each byte of text.
    assert asked < 19 and answered < 12 and scored < 25, (asked, answered, scored)
