"""Cross-entropy difference of documents between two matched bigram models.

The target model counts the documents marked as target, the background model all documents. Both share one vocabulary (every word
of the documents, and one unknown word) and one smoothing; the background's counts are scaled to the target's number of tokens, so
that both have the same weight against the smoothing. A document's own counts are taken out of both before it is scored. The
score is the mean over tokens of target loss minus background loss: the lower, the more like the target.

Every document, word and bigram is counted exactly, at every size; bigrams, words and contexts are told apart by 62-bit digests.
Documents are dealt to pieces of about ``PIECE_BYTES`` of text, and digests to as many ranges, so both grow in number with the
documents. A piece sends every range the counts of its own distinct digests, packed in a row; a range adds up what came and answers
each piece with the counts of all others, in the order of the request; the piece then scores its documents. So a bigram costs
one entry per piece that holds it, however frequent it is, and an answer of mostly zeros. Only the number of pieces, words and
tokens reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import written
from scoreloom.llm.textwords import mix, text_batches, words_of

SMOOTHING = 20.0
# Bytes of text in a piece.
PIECE_BYTES = 8 << 20

# Bytes of text scored at a time; scoring takes more memory a token than counting.
_SCORED_BYTES = 1 << 19

# Digests of the unknown word and of the start of a text.
_UNKNOWN, _START = np.uint64(0), np.uint64(1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's words, a piece of text at a time."""
    for batch in batches:
        for _, _, texts in text_batches(batch, "text"):
            words, counts = np.unique(words_of(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])


def learn_vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the ``size`` most frequent words of all documents, ties to the smaller hash."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_word_counts, "word long, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def _tokens(texts: list[bytes | None], vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the distinct words (the start of a text first), ids of the tokens and of those before them, and text offsets."""
    hashes, at = words_of(texts)
    if vocabulary is not None:
        hashes = np.where(np.isin(hashes, vocabulary), hashes, _UNKNOWN)
    words, ids = np.unique(hashes, return_inverse=True)
    ids = ids.astype(np.int64) + 1
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1][np.diff(at) > 0]] = 0
    return np.concatenate(([_START], words)), ids, before, at


def _bigrams(vocabulary: np.ndarray | None):
    """Counts of the bigrams of a piece of text in all and in target documents: context, word, seen, seen_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                words, ids, before, at = _tokens(texts, vocabulary)
                target = batch.column("target").slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
                pairs, which = np.unique(before * len(words) + ids, return_inverse=True)
                seen = np.bincount(which, minlength=len(pairs))
                wanted = np.bincount(which[np.repeat(target, np.diff(at))], minlength=len(pairs))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(words[k].view(np.int64)) for k in np.divmod(pairs, len(words))), pa.array(seen.astype(np.int64)), pa.array(wanted.astype(np.int64))],
                    ["context", "word", "seen", "seen_target"],
                )

    return run


def bigram_counts(marked: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(context, word, seen, seen_target) of every distinct bigram of ``marked`` (text, target boolean)."""
    parts = marked.select("text", "target").mapInArrow(_bigrams(vocabulary), "context long, word long, seen long, seen_target long")
    return parts.groupBy("context", "word").agg(F.sum("seen").alias("seen"), F.sum("seen_target").alias("seen_target"))


def _good_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids with a label of quality 1 and none that is toxic or of quality 0."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), good.alias("good")).where("id is not null")
    return marks.groupBy("id").agg(F.min("good").alias("good"))


def mark_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): target rows are those with a label of quality 1 and none that is toxic or of quality 0.

    Labels grow with the documents, so both sides are shuffled at every size, and skewed ids can be split.
    """
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(_good_ids(labels).hint("merge"), F.col("doc_id") == F.col("id"), "left")
        .select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("target"))
    )


def _planes(values: np.ndarray) -> bytes:
    """Integers with their bytes ordered by significance, so that the zeros of small ones lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


_BIGRAM, _WORD, _CONTEXT = (np.uint64(k) for k in range(3))


def _digest(kind: np.uint64, context: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    return (mix(mix(word) + context * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(3)) | kind


class _Batch:
    """Tokens of some texts, and the distinct digests that they hold."""

    def __init__(self, texts: list[bytes | None], target: np.ndarray, vocabulary: np.ndarray | None):
        words, ids, before, self.at = _tokens(texts, vocabulary)
        self.target, self.size = target, np.diff(self.at)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        pairs, bigram = np.unique(before * len(words) + ids, return_inverse=True)
        first, second = np.divmod(pairs, len(words))
        self.values = tuple(v.astype(np.int32) for v in (bigram, ids, before))  # a batch has fewer than 2^31 tokens
        self.digests = (_digest(_BIGRAM, words[first], words[second]), _digest(_WORD, np.uint64(0), words), _digest(_CONTEXT, np.uint64(0), words))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests with their counts in all texts and in target texts."""
        wanted = self.target[self.owner]
        seen = [np.bincount(v, minlength=len(d)) for v, d in zip(self.values, self.digests)]
        good = [np.bincount(v[wanted], minlength=len(d)) for v, d in zip(self.values, self.digests)]
        every = np.concatenate(seen)
        there = every > 0  # the start is no word, and some words are no context
        return np.concatenate(self.digests)[there], every[there], np.concatenate(good)[there]

    def own(self, k: int) -> np.ndarray:
        """How often each token's bigram, word or context occurs in the token's own text."""
        _, which, count = np.unique(self.owner.astype(np.int64) * len(self.digests[k]) + self.values[k], return_inverse=True, return_counts=True)
        return count[which]


def _added(digests: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct digests in order, and the sums of their counts."""
    order = np.argsort(digests, kind="stable")
    ranked = digests[order]
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
    distinct = ranked[begin]
    del ranked
    return distinct, *(np.add.reduceat(c[order], begin) if len(c) else c for c in counts)


def _batches(docs: pa.Table, good: np.ndarray, vocabulary: np.ndarray | None, limit: int = 1 << 21) -> Iterator[_Batch]:
    for batch in docs.to_batches():
        ids = batch.column("doc_id")
        target = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good) & ids.is_valid().to_numpy(zero_copy_only=False)
        for low, high, texts in text_batches(batch, "text", limit):
            yield _Batch(texts, target[low:high], vocabulary)


def _piece(batches: Iterator[_Batch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece's distinct digests with their counts."""
    parts = [b.counts() for b in batches]
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64))
    joined = [np.concatenate(p) for p in zip(*parts)]
    del parts
    return _added(*joined)


def _raw(table: pa.Table, name: str) -> Iterator[pa.Buffer]:
    """Binary values of a column, one at a time and not copied."""
    return (value.as_buffer() for value in table.column(name))


def _good_of(other: pa.Table) -> np.ndarray:
    return other.column("id").drop_null().to_numpy()


_REQUEST = "range long, piece long, digests binary, seen binary, wanted binary"


def _requests(pieces: int, vocabulary: np.ndarray | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A piece's digests and counts, a row for each range of digests that it meets."""

    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        digests, *counts = _piece(_batches(docs, _good_of(good), vocabulary))
        bounds = np.array([(k << 64) // pieces for k in range(1, pieces)], dtype=np.uint64)
        edge = np.concatenate(([0], np.searchsorted(digests, bounds), [len(digests)]))
        met = np.flatnonzero(np.diff(edge))
        spans = [slice(edge[k], edge[k + 1]) for k in met]
        piece = docs.column("piece")[0].as_py() if docs.num_rows else 0
        return pa.table({
            "range": pa.array(met.astype(np.int64)), "piece": pa.array([piece] * len(met), pa.int64()),
            "digests": pa.array([_planes(np.diff(digests[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
            **{name: pa.array([_planes(c[s]) for s in spans], pa.binary()) for name, c in zip(("seen", "wanted"), counts)},
        })

    return run


_REPLY = "piece long, range long, seen binary, wanted binary, n_words long, n_all long, n_target long"


def _replies(requests: pa.Table) -> pa.Table:
    """For each request of a range the counts of all other pieces; the range's words and tokens are in the first row."""
    digests = [np.cumsum(_from_planes(raw), dtype=np.uint64) for raw in _raw(requests, "digests")]
    ends = np.cumsum([len(d) for d in digests])[:-1]
    given = np.concatenate(digests)
    del digests
    own = [np.concatenate([_from_planes(raw).view(np.int64) for raw in _raw(requests, name)]) for name in ("seen", "wanted")]
    distinct, *sums = _added(given, *own)
    which = np.searchsorted(distinct, given).astype(np.int32)
    del given
    others = [np.split(total[which] - c, ends) for total, c in zip(sums, own)]
    del own, which
    is_word = (distinct & np.uint64(3)) == _WORD
    totals = [int(is_word.sum()), *(int(total[is_word].sum()) for total in sums)]
    return pa.table({
        "piece": requests.column("piece"), "range": requests.column("range"),
        **{name: pa.array([_planes(c) for c in kind], pa.binary()) for name, kind in zip(("seen", "wanted"), others)},
        **{name: pa.array([n] + [0] * (requests.num_rows - 1), pa.int64()) for name, n in zip(("n_words", "n_all", "n_target"), totals)},
    })


def _scores(vocabulary: np.ndarray | None, n_words: int, n_all: int, n_target: int, smoothing: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Losses of a piece's documents from its own counts and the replies."""

    def run(docs: pa.Table, other: pa.Table) -> pa.Table:
        good = _good_of(other)
        digests, *counts = _piece(_batches(docs, good, vocabulary))
        replies = other.select(["range", "seen", "wanted"]).filter(pc.is_valid(other.column("range"))).sort_by("range")
        if replies.num_rows:
            for c, name in zip(counts, ("seen", "wanted")):
                low = 0
                for raw in _raw(replies, name):
                    more = _from_planes(raw).view(np.int64)
                    c[low:low + len(more)] += more
                    low += len(more)
        seen, wanted = counts
        size, target_loss, background_loss = [], [], []
        for b in _batches(docs, good, vocabulary, _SCORED_BYTES):
            mine = b.target[b.owner]
            own, length = [b.own(k) for k in range(3)], b.size[b.owner]
            place = [np.searchsorted(digests, d) for d in b.digests]
            for out, total, tokens, scale, left_out in (
                (target_loss, wanted, n_target, 1.0, mine), (background_loss, seen, n_all, n_target / n_all if n_all else 0.0, np.ones(len(mine), bool)),
            ):
                bigram, word, context = ((total[p[v]] - left_out * o) * scale for p, v, o in zip(place, b.values, own))
                single = (word + 1.0) / ((tokens - left_out * length) * scale + n_words + 1)
                loss = -np.log((bigram + smoothing * single) / (context + smoothing))
                out.append(np.bincount(b.owner, loss, len(b.size)))
            size.append(b.size)
        n = np.concatenate(size) if size else np.empty(0, np.int64)
        mean = lambda parts: pa.array(np.concatenate(parts) / np.maximum(n, 1) if parts else n.astype(float), mask=n == 0)
        return pa.table({
            "doc_id": docs.column("doc_id") if docs.num_rows else pa.array([], pa.int64()), "n_tokens": pa.array(n.astype(np.int64)),
            "target_loss": mean(target_loss), "background_loss": mean(background_loss)})

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, size: int | None = None, smoothing: float = SMOOTHING, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs`` (doc_id, text).

    Losses are means over tokens in nats; the score is their difference. Null, empty and wordless texts have no tokens and null
    losses and score. Repeated rows each get a row and all count in the background; rows of one doc_id share a piece, rows
    without one are dealt by their text. Without target rows the target model is the uniform one of the smoothing. An empty
    table gives no rows. ``size`` keeps only the most frequent words and reads the others as the unknown word; by
    default none are dropped.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = -(-n_bytes // piece_bytes) or 1
    vocabulary = None if size is None else learn_vocabulary(texts, size)
    dealt = lambda key: F.pmod(F.xxhash64(key), F.lit(pieces)).alias("piece")
    by_piece = texts.select(dealt(F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", "text").groupBy("piece")
    good = _good_ids(labels).where("good").select(dealt("id"), "id")
    requests = by_piece.cogroup(good.groupBy("piece")).applyInArrow(_requests(pieces, vocabulary), _REQUEST)
    replies = written(requests.groupBy("range").applyInArrow(_replies, _REPLY))
    every = replies.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_words", "n_all", "n_target"))).first()
    n_words = every["n_words"] if vocabulary is None else len(vocabulary)
    other = replies.select("piece", "range", "seen", "wanted").unionByName(good, allowMissingColumns=True)
    scores = _scores(vocabulary, n_words, every["n_all"], every["n_target"], smoothing)
    return (
        by_piece.cogroup(other.groupBy("piece")).applyInArrow(scores, "doc_id long, n_tokens long, target_loss double, background_loss double")
        .withColumn("score", F.col("target_loss") - F.col("background_loss"))
    )
