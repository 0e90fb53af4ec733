import math
import zlib
from collections import Counter

import numpy as np

from scoreloom.llm import language_id as L
from tests.llm.util import ODD, SF


def plain_bits(text, samples):
    """Code length of ``text`` by counting in ``samples`` directly: contexts from longest to shortest, escapes with exclusion."""
    pad = b"\n" * L.ORDER
    followers = {}
    for s in samples:
        raw = pad + s
        for i in range(L.ORDER, len(raw)):
            for k in range(L.ORDER + 1):
                followers.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    total, raw = 0.0, pad + text
    for i in range(L.ORDER, len(raw)):
        out: set = set()
        for k in range(L.ORDER, -1, -1):
            left = {b: n for b, n in followers.get(raw[i - k : i], {}).items() if b not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if raw[i] in left:
                total += math.log2(whole / left[raw[i]])
                break
            total += math.log2(whole / len(left))
            out |= set(left)
        else:
            total += math.log2(256 - len(out))
    return total


def test_code_lengths():
    samples = {"en": [b"the theory of the thing", b"then that", b""], "de": ["der größte Bär".encode(), b"da\n\nder"]}
    counts = {}
    for lang, texts in samples.items():
        keys, n = np.unique(L.windows(texts)[0], return_counts=True)
        counts[lang] = (keys, n.astype(float))
    model = L.LanguageModel.of(counts)
    texts = [b"the other day", "größer als der Bär".encode(), b"", bytes(range(256)), b"\n\n\n\n\n", b"x", b"then that"]
    got = model.totals(texts) / 65536
    for k, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert abs(got[k, j] - plain_bits(t, samples[lang])) < 1e-3 * (len(t) + 1)


def test_all_bytes_have_probability_one():
    keys, n = np.unique(L.windows([b"abracadabra", b"abba"])[0], return_counts=True)
    tree = L.ContextTree(keys, n.astype(float))
    for before in (b"\n\n\n\n", b"abra", b"zzzz", b"zzzb", b"raca"):
        context = int.from_bytes(before, "big") << 8
        assert abs(np.exp2(-tree.bits(np.arange(256) + context)).sum() - 1) < 1e-9


def test_long_texts_are_whole_and_order_does_not_matter(spark):
    model = L.train(spark.read.parquet(f"{SF}/documents.parquet"))
    long = ("the and of " * 200_000 + "ß").encode()
    alone, beside = model.totals([long]), model.totals([b"a b", long, b""])
    assert (alone[0] == beside[1]).all() and (beside[2] == 0).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.predict(docs, L.train(docs)).join(docs.select("doc_id", "lang").distinct(), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_learned_from_held_out_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "nur dieses", "de") for i in ids] + [(1 if zlib.crc32(b"1") % 4 != 2 else 3, "only this", "en"), (None, "ni esto", "es"), (5, None, "it"), (6, "x", None)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en"]


def test_shares_and_bounds(spark):
    rows = [(i, f"text number {i}", "ab"[i % 5 == 0]) for i in range(400)] + [(900, "rare", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(frame, train_docs=20, train_langs=2).langs == ["a", "b"]
    first = L.train(frame, train_docs=20)
    again = L.train(frame.repartition(7), train_docs=20)
    assert (first.known == again.known).all() and (first.lengths == again.lengths).all()


def test_oddities(spark):
    rows = [(k, t, "en", 1, "x", True) for k, t in enumerate(ODD)] + [(None, "the word", None, 1, "x", True), (0, "1234 !?", "en", 1, "x", True), (50, "a b", "en", 1, "x", True), (50, "a b", "en", 1, "x", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string, lettered boolean").repartition(3)
    got = L.predict(frame, L.train(frame)).collect()
    assert len(got) == len(rows)
    und = sorted(r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None)
    assert und == sorted([0, *(k for k, t in enumerate(ODD) if not any(c.isalpha() for c in t or ""))])
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and [r.held_out for r in got if r.doc_id is None] == [False]
    twice = [(r.lang_pred, r.score) for r in got if r.doc_id == 50]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.predict(empty, L.train(empty)).collect() == []
    words = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in L.predict(words, L.train(empty)).collect()] == [("und", 0.0)]
