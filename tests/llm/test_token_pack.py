import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreloom.llm import token_pack as T
from tests.llm.util import ODD, SF

TEXTS = [*ODD, "It's <|endoftext|> Σας ΣΑΣ ... word,. Word, İstanbul ǅ ﬁ Ⅷ é 2nd x y z\x1cq", "ab " * 3000, "ÉCOLE école, naïve. straße."]


def expected(rows):
    tokenizer, out, at = Tokenizer.from_file(T.default_tokenizer()), [], 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def digests(df):
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_digests_equal_the_tokenizer(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    assert digests(T.written_and_read(df)) == expected(rows)
    assert digests(T.written_and_read(df, block_ids=10)) == expected(rows)


def test_query_on_given_table(spark):
    from scoreloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert digests(QUERIES["op2_token_blocks"](spark, SF)) == expected(rows)


def test_repeated_ids_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(4, "b c", 1), (4, "b c", 1), (4, "d", 1), (1, "a", 1)], "doc_id long, text string, shard int")
    got = digests(T.written_and_read(df))
    assert [g[0] for g in got] == [1, 4, 4, 4] and got[0][1] == 0
    assert sorted(g[1] for g in got) == [0, *np.cumsum([g[2] for g in sorted(got, key=lambda g: g[1])])[:-1]]
    assert T.written_and_read(df.limit(0)).collect() == []


def check(ids, lens, **options):
    alphabet, rules, sizes, symbols = T.compress(np.array(ids, dtype=np.uint32), np.array(lens), **options)
    full = np.concatenate((np.ones(len(alphabet), np.int64), sizes))
    assert T.expand(alphabet, rules, full, symbols).tolist() == list(ids)
    wide = symbols.dtype == np.uint64
    block = T.Block(alphabet.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), wide, symbols.astype("<u4" if wide else "<u2").tobytes())
    ends = np.cumsum(full[symbols])
    assert set(np.cumsum(lens).tolist()) - {0} <= set(ends.tolist())  # no symbol crosses the end of a document
    for a, b in ((0, len(ids)), (1, len(ids) - 1), (len(ids) // 3, len(ids) // 2)):
        if 0 <= a < b:
            assert block.read(a, b).tolist() == list(ids[a:b])
    return rules, symbols


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=6))
def test_round_trip(docs):
    check([x for d in docs for x in d], [len(d) for d in docs], least=2)


def test_repetition_shrinks():
    rules, symbols = check([1, 2, 3, 4] * 5000, [20_000])
    assert len(symbols) < 5000 and len(rules) > 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=60), min_size=1, max_size=4), st.integers(2, 4))
def test_no_pair_is_left_that_occurs_often(docs, least):
    lens = [len(d) for d in docs]
    rules, symbols = check([x for d in docs for x in d], lens, least=least)
    alphabet, _, sizes, _ = T.compress(np.array([x for d in docs for x in d], dtype=np.uint32), np.array(lens), least=least)
    ends = np.cumsum(np.concatenate((np.ones(len(alphabet), np.int64), sizes))[symbols])
    left = {}
    for k in range(len(symbols) - 1):
        if ends[k] not in np.cumsum(lens):
            pair = (int(symbols[k]), int(symbols[k + 1]))
            left[pair] = left.get(pair, 0) + 1
    assert not left or max(left.values()) < least


def test_a_long_passage_becomes_one_symbol_and_long_runs_end():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 5_000, 60)
    ids = np.concatenate([np.append(passage, rng.integers(5_000, 9_000, 3)) for _ in range(2_000)])
    rules, symbols = check(ids.tolist(), [len(ids)])
    assert len(symbols) < 4.5 * 2_000
    rules, symbols = check([7] * 200_000, [200_000])
    assert len(symbols) < 40


def test_symbols_grow_wide_when_rules_need_it():
    rng = np.random.default_rng(5)
    ids = np.concatenate((np.arange(60_000), np.tile(rng.integers(0, 60_000, 8_000), 8)))
    rules, symbols = check(ids.tolist(), [60_000, 64_000])
    assert symbols.dtype == np.uint64 and len(rules) > 5_536


@pytest.mark.parametrize("n", [70_000, 65_000])
def test_large_alphabets(n):
    ids = np.concatenate((np.arange(n), np.tile([5, 6], 500)))
    check(ids.tolist(), [n, 1000])


def test_no_ids():
    alphabet, rules, sizes, symbols = T.compress(np.empty(0, np.uint32), np.array([0]))
    assert len(T.expand(alphabet, rules, sizes, symbols)) == 0
