"""Spelling variants: words one edit apart, found by pivotal grams.

All bigrams of the vocabulary are ordered by how many words hold them, rarest first. A word's gram prefix is its first three
bigrams in that order; its pivots are the two disjoint bigrams of the prefix that are rarest together, chosen by dynamic programming. One edit touches at most one of two disjoint bigrams, so of two near words, the one whose
prefix ends earlier in the order has a pivot that stands in the other's prefix: pivots are looked up among prefixes.

Position limits: an edit to the right of a word's left pivot leaves all before it as it was, at the same places; an edit to the
left of the right pivot leaves all behind it, at the same places counted from the end. The edited side itself is cut in the
middle, and one of its halves is intact. A key holds what is intact and the length of the word in the index, so that a lookup meets
few other words. Every pair met is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import written
from scoreloom.llm.textwords import text_batches

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5

# Distinct words that a task counts before it gives its partial counts away.
_HELD = 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_PRIME = (1 << 61) - 1
_BASE = 1_000_003


def document_words(doc_id: int | None, text: str | None) -> Counter:
    """Words of one text with their counts; of every 199th (by the digest of id and word) one letter is lost."""
    found = Counter(_RUN.findall((text or "").encode("utf-8", "replace").lower().decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        digest = zlib.crc32(word.encode(), start)
        if digest % 199 == 0:
            lost = digest % len(word)
            word = word[:lost] + word[lost + 1 :]
        out[word] += n
    return out


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            held.update(document_words(doc_id, text.as_py()))
            if len(held) >= _HELD:
                yield given(held)
                held = Counter()
    yield given(held)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with at least that many code points and occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (
        rows.mapInArrow(_partial_counts, "word string, n long").where(F.length("word") >= least_length)
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    )


def gram_order(words: DataFrame) -> dict[str, int]:
    """Rank of every bigram, the one in fewest words first, ties by code point.

    Words have 90 letters (a-z and U+00C0 to U+00FF), so there are at most 8,100 bigrams.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") >= 2).select(F.explode(F.array_distinct(F.transform(places, lambda i: F.col("word").substr(i, F.lit(2))))).alias("gram"))
    ordered = grams.groupBy("gram").count().orderBy("count", "gram").select("gram").collect()
    return {r["gram"]: k for k, r in enumerate(ordered)}


def gram_prefix(word: str, rank: dict[str, int]) -> tuple[dict[int, int], dict[int, int]]:
    """The bigrams that rank no later than the third of ``word``: their first places with their ranks, and their last places.

    If all up to a bigram is the same in two words, its first place is the same; if all behind it is, its last place is.
    """
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[min(3, len(ranks)) - 1]
    held = [(i, r) for i, r in enumerate(ranks) if r <= last]
    first_place = {r: i for i, r in reversed(held)}
    last_place = {r: i for i, r in held}
    return {i: r for r, i in first_place.items()}, {i: r for r, i in last_place.items()}


def pivots(firsts: dict[int, int], lasts: dict[int, int]) -> tuple[int, int]:
    """The disjoint bigrams, one at a first place and one behind it at a last place, with the smallest sum of ranks; the leftmost of equal ones.

    Going through the places, the state is the cheapest first place that a bigram here doesn't overlap. Three places always hold
    two that don't overlap, and moving the left one to its bigram's first place and the right one to its last keeps them apart.
    """
    starts = sorted(firsts)
    best, cheapest, passed = None, None, 0
    for place in sorted(lasts):
        while passed < len(starts) and starts[passed] <= place - 2:
            free = (firsts[starts[passed]], starts[passed])
            cheapest = free if cheapest is None else min(cheapest, free)
            passed += 1
        if cheapest is not None:
            found = (cheapest[0] + lasts[place], cheapest[1], place)
            best = found if best is None else min(best, found)
    return best[1], best[2]


class _Keys:
    """Keys of parts of one word; equal parts of any two words give equal keys."""

    def __init__(self, word: str):
        self.size = len(word)
        self.sums, self.powers = [0], [1]
        for letter in word:
            self.sums.append((self.sums[-1] * _BASE + ord(letter)) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _part(self, low: int, high: int) -> int:
        return (self.sums[high] - self.sums[low] * self.powers[high - low]) % _PRIME

    def _key(self, kind: int, place: int, head: int, tail: int, length: int) -> int:
        """Digest of the first ``head`` and the last ``tail`` letters, with what they are compared under."""
        value = kind
        for part in (place, length, self._part(0, min(head, self.size)), self._part(max(0, self.size - tail), self.size)):
            value = (value * 0x9E3779B97F4A7C15 + part + 1) % _PRIME
        return value

    def left(self, kept: int, length: int) -> set[int]:
        """The first ``kept`` letters are intact, in an indexed word of ``length`` letters; so is a half of the rest."""
        middle = (kept + length + 1) // 2
        return {self._key(0, kept, kept, length - middle, length), self._key(1, kept, middle, 0, length)}

    def right(self, kept: int, length: int) -> set[int]:
        """The last ``kept`` letters are intact; so is a half of what stands before them."""
        middle = (length - kept) // 2
        return {self._key(2, kept, middle, kept, length), self._key(3, kept, 0, length - middle, length)}


def indexed_keys(word: str, prefix: tuple[dict[int, int], dict[int, int]]) -> set[int]:
    """What ``word`` is found under: every bigram of its prefix, as a left and as a right pivot of another word."""
    keys, size = _Keys(word), len(word)
    return set().union(*(keys.left(i + 2, size) for i in prefix[0]), *(keys.right(size - i, size) for i in prefix[1]))


def lookup_keys(word: str, prefix: tuple[dict[int, int], dict[int, int]]) -> set[int]:
    """What ``word`` looks up: its two pivots, in words as long as it or one letter longer or shorter."""
    keys, size = _Keys(word), len(word)
    low, high = pivots(*prefix)
    return set().union(*(
        (keys.left(low + 2, length) if low + 2 <= length else set()) | (keys.right(size - high, length) if size - high <= length else set())
        for length in (size - 1, size, size + 1)
    ))


def _keyed(rank: dict[str, int], keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_batches(batch, "word", 1 << 18):
                part = batch.slice(low, high - low)
                keys = [sorted(keys_of(w, gram_prefix(w, rank))) for w in (t.decode() for t in texts)]
                whose = pa.array([k for k, found in enumerate(keys) for _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key for found in keys for key in found], pa.int64()), part.column("word").take(whose), part.column("n").take(whose)], ["key", "word", "n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words of ``words`` (word, n) that are exactly one edit apart.

    ``words`` are distinct, of at least four letters each; they are read several times, so give a written table.
    """
    rank = gram_order(words)
    schema = "key long, word string, n long"
    index = words.mapInArrow(_keyed(rank, indexed_keys), schema).withColumnsRenamed({"word": "near", "n": "near_n"})
    lookups = words.mapInArrow(_keyed(rank, lookup_keys), schema)
    met = (
        lookups.join(index.hint("merge"), "key").where("word != near")
        .where(F.expr("levenshtein(word, near, 1) = 1"))
    )
    # A pair may be met under several keys and from both sides.
    forward = F.col("word") < F.col("near")
    one = F.struct("word", "n")
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"))
    pairs = met.select(F.when(forward, one).otherwise(other).alias("a"), F.when(forward, other).otherwise(one).alias("b")).distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    return pairs.select(both).select(
        F.col("p.a.word").alias("word"), F.col("p.a.n").alias("n"), F.col("p.b.word").alias("near"), F.col("p.b.n").alias("near_n"))


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n).

    ``form``: the near word of largest n (ties: the first in code-point order), if it has at least ``ratio`` times the word's n.
    Forms are followed to the last by doubling steps: each step of a chain multiplies n by ``ratio``, so chains are short and the loop
    ends after the logarithm of their length. An empty table gives no rows.
    """
    words = written(words)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word")))
    chosen = written(
        near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best")).alias("best"))
        .select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.order")).alias("form_n"))
    )
    roots = chosen.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            break
    return (
        words.join(chosen, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )


def group_spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text); its other columns are not read.

    A null text has no words, a null doc_id counts as an empty one, repeated rows count again. An empty table gives no rows.
    """
    return variants(vocabulary(docs))


ORACLE = """
WITH crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || [0::BIGINT for _ in range(8)],
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (
    SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word
        FROM documents) GROUP BY ALL),
coded AS (
    SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || word, ''), lambda c:
           CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END)) AS bytes
    FROM runs),
hashed AS (
    SELECT word, n, xor(list_reduce([4294967295] || bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
w AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN left(word, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2) ELSE word END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n, any_value(n) AS n FROM near GROUP BY word),
chosen AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
    FROM w LEFT JOIN best USING (word)),
steps AS (
    WITH RECURSIVE s(word, root, step) AS (
        SELECT word, word, 0 FROM chosen
        UNION ALL SELECT s.word, c.form, step + 1 FROM s JOIN chosen c ON c.word = s.root WHERE c.form IS NOT NULL)
    SELECT word, last(root ORDER BY step) AS root FROM s GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN steps USING (word)
"""
