"""Document quality from a linear-chain conditional random field over lines.

Every line gets measurements of itself and of the lines before and after it. A two-state chain (bad, good)
is fitted by its exact gradient; forward-backward gives the probability of "good" for every line, and the
document's score is their mean weighted by line length. Only documents carry labels, so in training every line of a
document takes the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.tables import written
from scoreloom.llm.textwords import mix, text_batches, words_of

# Bounds of the training sample: labelled documents, and lines of all of them together. Documents are read whole.
TRAIN_DOCS = 6000
TRAIN_LINES = 120_000

# Byte classes, counted per line.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'\"()-",
    "mark": b"!?#$%&*",
    "rule": b"|<>{}[]\\/=+_~^@`",
    "lead": bytes(range(192, 256)),
    "inner": bytes(range(128, 192)),
}
_FIELDS = list(_CLASSES)


def _tables() -> list[np.ndarray]:
    out = []
    for a, b in zip(_FIELDS[::2], _FIELDS[1::2]):
        t = np.zeros(256, dtype=np.uint64)
        t[list(_CLASSES[a])] += np.uint64(1)
        t[list(_CLASSES[b])] += np.uint64(1 << 32)
        out.append(t)
    return out


_TABLES = _tables()
WIDTH = 25


def line_measurements(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measurements (lines x WIDTH), line lengths in bytes, and the offset of each text's first line.

    Lines are split at line feeds; a null or empty text is one empty line.
    """
    texts = [t or b"" for t in texts]
    if not texts:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(1, np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(raw == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    size = (end - start).astype(np.float64)
    at = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for t in texts])))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))

    count = {}
    for k, table in enumerate(_TABLES):
        both = np.add.reduceat(table[raw], start)
        count[_FIELDS[2 * k]] = (both & np.uint64(0xFFFFFFFF)).astype(np.float64)
        count[_FIELDS[2 * k + 1]] = (both >> np.uint64(32)).astype(np.float64)
    chars = size - count["inner"]

    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    opens = ~blank & np.concatenate(([True], blank[:-1]))
    pieces = np.add.reduceat(opens.astype(np.int64), start).astype(np.float64)
    closes = ~blank & np.concatenate((blank[1:], [True]))
    marked = closes & (np.isin(raw, np.frombuffer(_CLASSES["mark"] + _CLASSES["rule"], dtype=np.uint8)))
    marked = np.add.reduceat(marked.astype(np.int64), start).astype(np.float64)

    # Words of each line; lines are the texts here, so an offset per line comes back.
    lines = b"\n".join(texts).split(b"\n")
    words, word_at = words_of(lines)
    n_words = np.diff(word_at).astype(np.float64)
    line_of = np.repeat(np.arange(len(lines)), np.diff(word_at))
    same_line = line_of[1:] == line_of[:-1]
    again = np.bincount(line_of[1:][same_line & (words[1:] == words[:-1])], minlength=len(lines))
    # A repeated word of a line is a repeated key.
    if len(words):
        key = mix(words + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], line_of[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        distinct = np.bincount(owner[fresh], minlength=len(lines)).astype(np.float64)
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(words), dtype=np.uint64)))
        content = total[word_at[1:]] - total[word_at[:-1]]
    else:
        distinct, content = np.zeros(len(lines)), np.zeros(len(lines), np.uint64)
    place = mix(content + mix(doc.astype(np.uint64)))
    order = np.argsort(place, kind="stable")
    seen = np.zeros(len(lines), dtype=bool)
    seen[order[1:]] = place[order[1:]] == place[order[:-1]]
    seen &= n_words > 0

    first = raw[np.minimum(start, len(raw) - 1)]
    last = raw[np.maximum(end - 1, 0)]
    letters = count["upper"] + count["lower"] + count["lead"]
    c, w, l = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(letters, 1)
    upper, unlike = count["upper"] / l, distinct / w
    columns = [
        np.log1p(chars), np.log1p(n_words), size == 0, n_words == 1,
        upper, upper > 0.5, count["digit"] / c, count["digit"] / c > 0.3,
        count["stop"] / c, count["mark"] / c, count["mark"] > 0.02 * c, count["rule"] / c, count["rule"] > 0.02 * c,
        count["lead"] / c, letters / c, chars / w / 10, pieces / w,
        unlike * (n_words > 0), (unlike < 0.3) & (n_words > 5), again / w, again > 0.2 * w,
        marked / np.maximum(pieces, 1), seen,
        (first >= 65) & (first <= 90) | (first >= 192), (size > 0) & np.isin(last, np.frombuffer(b".!?", dtype=np.uint8)),
    ]
    return np.stack(columns, axis=1).astype(np.float32), size, at.astype(np.int64)


def with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's measurements, those of the line before and after, and flags for a missing neighbour."""
    n = len(x)
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    first[at[:-1]] = True
    last[at[1:] - 1] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None]], axis=1, dtype=np.float32)


class Chains:
    """Forward and backward passes over many two-state chains side by side.

    Messages are log-odds of good against bad. Chains are ordered by length, so step t touches
    only those that are longer than t.
    """

    def __init__(self, at: np.ndarray):
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        starts, length = at[:-1][order], length[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        self.steps = [starts[:k] + t for t, k in enumerate(active)]
        self.n = int(at[-1])

    def run(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds messages from the left (with the own line) and from the right."""
        left, right = np.array(emit, dtype=np.float64), np.zeros(self.n)
        for t in range(1, len(self.steps)):
            here = self.steps[t]
            a = left[here - 1]
            left[here] += np.logaddexp(a + move[1, 1], move[0, 1]) - np.logaddexp(a + move[1, 0], move[0, 0])
        for t in range(len(self.steps) - 2, -1, -1):
            here = self.steps[t + 1] - 1
            b = emit[here + 1] + right[here + 1]
            right[here] = np.logaddexp(b + move[1, 1], move[1, 0]) - np.logaddexp(b + move[0, 1], move[0, 0])
        return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class LineModel:
    """Weights of a line's measurements and neighbours, the bias, transitions [from, to], and the scaling."""

    weights: np.ndarray
    bias: float
    move: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def line_odds(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        full = (with_neighbours(x, at) - self.mean) / self.scale
        return full @ self.weights + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Score of each text: mean probability of good lines, weighted by bytes with the line end."""
        x, size, at = line_measurements(texts)
        if len(at) == 1:
            return np.zeros(0)
        emit = self.line_odds(x, at).astype(np.float64)
        left, right = Chains(at).run(emit, self.move)
        weight = size + 1
        return np.add.reduceat(_sigmoid(left + right) * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])


def neutral_model() -> LineModel:
    """Gives every text 0.5: what is used when there is no labelled document."""
    n = 3 * WIDTH + 2
    return LineModel(np.zeros(n), 0.0, np.zeros((2, 2)), np.zeros(n), np.ones(n))


def fit(x: np.ndarray, at: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 1.0) -> LineModel:
    """Maximum likelihood with a ridge penalty, by Adam on the exact gradient; ``good``: label of each chain."""
    full = with_neighbours(x, at).astype(np.float64)
    mean, scale = full.mean(axis=0), full.std(axis=0)
    scale[scale < 1e-6] = 1.0
    full = (full - mean) / scale
    y = np.repeat(good.astype(np.float64), np.diff(at))
    chains = Chains(at)
    inner = np.ones(len(y), dtype=bool)
    inner[at[1:] - 1] = False  # lines that are followed by another
    here = np.flatnonzero(inner)
    observed = np.array([[np.sum((1 - y[here]) * (1 - y[here + 1])), np.sum((1 - y[here]) * y[here + 1])],
                         [np.sum(y[here] * (1 - y[here + 1])), np.sum(y[here] * y[here + 1])]])
    theta = np.zeros(full.shape[1] + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, bias, move = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        emit = full @ weights + bias
        left, right = chains.run(emit, move)
        gap = y - _sigmoid(left + right)
        a, b = left[here], emit[here + 1] + right[here + 1]
        joint = np.stack([np.full_like(a, move[0, 0]), move[0, 1] + b, move[1, 0] + a, move[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0))
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        gradient = np.concatenate([full.T @ gap - ridge * weights, [gap.sum()], observed.ravel() - joint - ridge * theta[-4:]]) / len(y)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineModel(theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2).copy(), mean, scale)


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The measurements of all lines of every document."""
    for batch in batches:
        for low, high, texts in text_batches(batch, "text"):
            x, _, at = line_measurements(texts)
            rows = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), batch.column("quality").slice(low, high - low), pa.array(rows, pa.binary())],
                ["doc_id", "quality", "lines"],
            )


def train_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """doc_id, quality, text: at most ``train_docs`` labelled, not held-out documents of at most ``train_lines`` lines together.

    They are the documents of smallest hash as far as the lines reach, each of them whole; one of more than a 32nd of
    ``train_lines`` is passed over. Equal rows count once.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    )
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    order = [F.xxhash64("doc_id"), "doc_id", "mark"]
    sizes = (
        rows.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "mark", "quality", (F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1).alias("lines"))
        .where(F.col("lines") <= train_lines // 32).distinct().orderBy(*order).limit(train_docs)
    )
    # At most ``train_docs`` rows.
    upto = F.sum("lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = written(sizes.withColumn("upto", upto).where(F.col("upto") <= train_lines).select("doc_id", "mark", "quality"))
    return rows.join(F.broadcast(kept), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineModel:
    """Fit on the documents of ``train_sample``.

    The sample's measurements (bounded by the two parameters) are gathered and fitted in one place. Labels other than 0
    and 1 are ignored; of several labels of a document the lowest counts. Without labelled documents the model is neutral.
    """
    found = (
        train_sample(docs, labels, train_docs, train_lines).mapInArrow(_measured, "doc_id long, quality int, lines binary")
        .toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("lines", "ascending")])
    )
    if not found.num_rows:
        return neutral_model()
    parts = [np.frombuffer(b, dtype=np.float32).reshape(-1, WIDTH) for b in found.column("lines").to_pylist()]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return fit(np.concatenate(parts), at, found.column("quality").to_numpy())


def score(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.5) of every row.

    A null or empty text is one empty line and is scored like any other. Repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.clip(model.scores(texts), 0, 1), pa.float64())], ["doc_id", "score"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: LineModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least 0.5. One pass, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                yield batch.slice(low, high - low).filter(pa.array(model.scores(texts) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
