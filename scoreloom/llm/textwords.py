"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a run of ASCII digits, ASCII letters (A-Z read as a-z) and bytes of non-ASCII
characters. All work is done on the UTF-8 bytes with numpy, so a batch of texts costs a few
passes over its bytes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled at a time; bounds the memory of the intermediate arrays.
PIECE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = _powers(256)


def hash_runs(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of every run of bytes that are ``inside``."""
    global _POWERS
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    length = last - first
    if not len(first):
        return np.empty(0, np.uint64), first, length
    if (longest := int(length.max())) > len(_POWERS):
        _POWERS = _powers(2 * longest)
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    position = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[position]
    return mix(np.add.reduceat(terms, at) + length.astype(np.uint64)), first, length


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece that starts and ends outside a word."""
    folded = _FOLD[raw]
    hashes, first, _ = hash_runs(folded, _IS_WORD[folded])
    return hashes, first


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the offset of each text's first word (one more
    offset than texts). A null text has no words."""
    texts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    hashes, places, low = [], [], 0
    while low < len(raw):
        high = min(low + PIECE, len(raw))
        if high < len(raw):
            inside = _IS_WORD[_FOLD[raw[low:high]]]
            stops = np.flatnonzero(~inside)
            if len(stops):
                high = low + int(stops[-1]) + 1
            else:  # one word longer than a piece: go on to its end
                rest = np.flatnonzero(~_IS_WORD[_FOLD[raw[high:]]])
                high += int(rest[0]) + 1
        h, p = _piece(raw[low:high])
        hashes.append(h)
        places.append(p + low)
        low = high
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.searchsorted(place, ends)))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), offsets.astype(np.int64)


def word_hash(word: str) -> np.uint64:
    """Hash of a single word, equal to what ``words_of`` gives for it."""
    h, _ = words_of([word.encode()])
    if len(h) != 1:
        raise ValueError(f"not one word: {word!r}")
    return h[0]


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; a shorter text is one run of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    value = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        value = mix(value + hashes[j : n - width + 1 + j] * np.uint64(2 * j + 3))
    return value


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Row ranges of an Arrow batch with their texts as bytes, about ``limit`` bytes at a time."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit or i + 1 == len(texts):
            yield low, i + 1, texts[low : i + 1]
            low, size = i + 1, 0
