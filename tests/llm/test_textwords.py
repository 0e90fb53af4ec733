import random

import numpy as np
import pytest

from scoreloom.llm import textwords
from tests.llm.util import ODD, words


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abC9 \n.,é漢-_"
    return [None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(80)] + ODD


@pytest.mark.parametrize("piece", [7, 64, 1 << 21])
def test_words_equal_the_pattern(monkeypatch, piece):
    monkeypatch.setattr(textwords, "PIECE", piece)
    given = texts(piece)
    hashes, at = textwords.words_of([None if t is None else t.encode() for t in given])
    want = [words(t) for t in given]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist()))
    assert len(set(known.values())) == len(known)


def test_no_texts():
    hashes, at = textwords.words_of([])
    assert len(hashes) == 0 and at.tolist() == [0]


def test_shingles():
    h, _ = textwords.words_of([b"a b c d e f a b c d e"])
    s = textwords.shingles_of(h, 5)
    assert len(s) == 7 and s[0] == s[6] and len(set(s.tolist())) == 6
    short, _ = textwords.words_of([b"a b"])
    assert len(textwords.shingles_of(short, 5)) == 1
    assert len(textwords.shingles_of(h[:0], 5)) == 0
