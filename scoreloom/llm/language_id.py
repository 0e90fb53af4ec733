"""Language of texts by prediction by partial matching.

Every language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that followed them. A byte's code
length in a language is found in the longest known context; where the byte was never seen there, an escape is paid and the next
shorter context is asked, without the bytes that the longer one has already ruled out (escapes by the number of distinct followers,
method C, with full exclusion). The statistics are frozen: scoring a text changes nothing, so a byte's code length depends only on
itself and the ``ORDER`` bytes before it, and a text's is an exact sum. The language with the shortest code is predicted.

The trees are fitted on a bounded sample of labelled documents, whole texts, counted in Spark. They reach the executors as one
broadcast value, whose size is bounded by that sample. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.textwords import text_batches

ORDER = 4

# Bounds of the training sample: documents of all languages together (an equal share for each), and languages.
TRAIN_DOCS = 4000
TRAIN_LANGS = 100

# Code lengths are whole numbers of 2**-16 bits, so that sums don't depend on their order.
_UNIT = 65536.0
_PAD = b"\n" * ORDER


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``ORDER`` bytes before it as one integer, and the offset of each text's first one.

    Before a text stand ``ORDER`` line feeds.
    """
    raw = np.frombuffer(b"".join(part for t in texts for part in (_PAD, t)), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    if not at[-1]:
        return np.empty(0, np.int64), at
    keys = np.zeros(len(raw) - ORDER, dtype=np.int64)
    for j in range(ORDER + 1):
        keys = (keys << 8) | raw[j : j + len(keys)]
    skipped = np.arange(int(at[-1])) + ORDER * np.repeat(np.arange(len(texts)), size)
    return keys[skipped], at


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in ``sorted_keys`` (any place if it isn't there) and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return place, sorted_keys[place] == keys


@dataclass(frozen=True)
class _Level:
    """Contexts of one length: total and number of followers, and the followers' counts in the next shorter context."""

    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    shorter_total: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray


class ContextTree:
    """Frozen counts of one language; ``keys`` are windows of ``ORDER`` + 1 bytes, ``counts`` how often each was seen."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels, shorter = [], None
        for order in range(ORDER + 1):
            symbols, at = np.unique(keys & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.bincount(at, weights=counts, minlength=len(symbols))
            contexts, at = np.unique(symbols >> 8, return_inverse=True)
            if shorter is None:
                below = np.zeros(len(symbols))
            else:
                below = shorter.counts[_lookup(shorter.symbols, symbols & ((1 << 8 * order) - 1))[0]]
            shorter = _Level(
                contexts, np.bincount(at, weights=seen, minlength=len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float),
                np.bincount(at, weights=below, minlength=len(contexts)), symbols, seen)
            levels.append(shorter)
        self.levels = levels

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window after the bytes before it."""
        spent = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        ruled_total, ruled_distinct = np.zeros(len(keys)), np.zeros(len(keys))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            mine = keys[open_]
            place, known = _lookup(level.contexts, (mine >> 8) & ((1 << 8 * order) - 1))
            if not known.any():
                continue
            total = np.where(known, level.total[place], 0.0) - ruled_total
            distinct = np.where(known, level.distinct[place], 0.0) - ruled_distinct
            where, found = _lookup(level.symbols, mine & ((1 << 8 * (order + 1)) - 1))
            spent[open_[found]] += np.log2(total[found] + distinct[found]) - np.log2(level.counts[where[found]])
            escaped = known & ~found & (distinct > 0)
            spent[open_[escaped]] += np.log2(total[escaped] + distinct[escaped]) - np.log2(distinct[escaped])
            ruled_total = np.where(known, level.shorter_total[place], 0.0)[~found]
            ruled_distinct = np.where(known, level.distinct[place], 0.0)[~found]
            open_ = open_[~found]
        spent[open_] += np.log2(256.0 - ruled_distinct)
        return spent


@dataclass(frozen=True)
class LanguageModel:
    """Trees by language, and the code lengths of all windows that occur in the sample."""

    langs: list[str]
    trees: list[ContextTree]
    known: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        langs = sorted(counts)
        trees = [ContextTree(*counts[lang]) for lang in langs]
        known = np.unique(np.concatenate([counts[lang][0] for lang in langs])) if langs else np.empty(0, np.int64)
        model = LanguageModel(langs, trees, known, np.empty((0, len(langs)), np.int32))
        return LanguageModel(langs, trees, known, model._exact(known))

    def _exact(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(t.bits(keys) * _UNIT) for t in self.trees], axis=1).astype(np.int32) if self.trees else np.empty((len(keys), 0), np.int32)

    def lengths_of(self, keys: np.ndarray) -> np.ndarray:
        place, found = _lookup(self.known, keys)
        out = self.lengths[place] if len(self.known) else np.empty((len(keys), len(self.langs)), np.int32)
        new, at = np.unique(keys[~found], return_inverse=True)
        out[~found] = self._exact(new)[at]
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (rows) in each language (columns), in units of 2**-16 bits."""
        sums = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        keys, at = windows(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        step = max(1 << 12, (1 << 21) // max(1, len(self.langs)))
        for low in range(0, len(keys), step):
            part, whose = self.lengths_of(keys[low : low + step]), owner[low : low + step]
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            sums[whose[first]] += np.add.reduceat(part, first, axis=0, dtype=np.int64)
        return sums


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for low, high, texts in text_batches(batch, "text"):
            mine = langs[low:high]
            for lang in sorted(set(mine)):
                keys, counts = np.unique(windows([t for t, other in zip(texts, mine) if t and other == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], ["lang", "key", "n"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_langs: int = TRAIN_LANGS) -> LanguageModel:
    """Trees of the languages of ``docs`` (doc_id, text, lang).

    Learned from: whole texts of rows with an id, not held out, a language and a text. At most ``train_docs`` of them: the same
    number for each language, by the hash of the id, of the ``train_langs`` most frequent languages
    (ties to the smaller name). Repeated rows count again. Without such rows there are no languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    langs = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(train_langs, train_docs)).collect()]
    if not langs:
        return LanguageModel.of({})
    # The smallest hashes lie in the first of 1,024 ranges; only ranges that are needed to fill a share are ordered, so that
    # a frequent language's ids never meet in one task.
    share = train_docs // len(langs)
    ranged = usable.where(F.col("lang").isin(langs)).select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).withColumn("range", F.pmod("hash", F.lit(1024)))
    held = ranged.groupBy("lang", "range").agg(F.approx_count_distinct("doc_id").alias("ids"))
    filled = held.withColumn("before", F.sum("ids").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    wanted = filled.where(F.coalesce("before", F.lit(0)) < 1.3 * share + 30).select("lang", "range")
    order = Window.partitionBy("lang").orderBy("range", "hash", "doc_id")
    chosen = (
        ranged.join(F.broadcast(wanted), ["lang", "range"]).distinct()  # at most 1,024 ranges of train_langs languages
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= share).select("lang", "doc_id")
    )
    sample = usable.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most train_docs keys
    counted = (
        sample.select("lang", "text").mapInArrow(_window_counts, "lang string, key long, n long")
        .groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    )
    name, keys, n = (counted.column(c).to_numpy() for c in ("lang", "key", "n"))
    found = {}
    for lang in langs:
        mine = np.flatnonzero(name == lang)
        mine = mine[np.argsort(keys[mine])]
        if len(mine):
            found[lang] = (keys[mine], n[mine].astype(float))
    return LanguageModel.of(found)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text); its other columns are not read.

    The score is the probability of the predicted language, all languages being equally likely before. Ties go to the smaller
    name. A null text, one without a letter, and every text when nothing was learned: ``und`` and 0. Repeated rows get equal
    results; a null doc_id is not held out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                lettered = np.flatnonzero(batch.column("lettered").slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool))
                if len(lettered) and model.langs:
                    totals = model.totals([texts[k] for k in lettered])
                    best = totals.argmin(axis=1)
                    behind = (totals - totals.min(axis=1, keepdims=True)) / _UNIT
                    scores[lettered] = 1.0 / np.exp2(-behind).sum(axis=1)
                    for k, b in zip(lettered, best):
                        langs[k] = model.langs[b]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
