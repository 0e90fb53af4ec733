"""Benchmark passages inside documents: SimHash of item-sized windows, found by multi-index Hamming blocks and verified.

Texts are words in lower case; a shingle is five consecutive words. Windows have the size of an item and are laid
where a shared shingle places that item (elsewhere the similarity is zero, so no window is needed). Equal windows are
folded into one. Each window's and each item's 64-bit SimHash weighs shingles by their count. Fingerprints are cut into four
blocks; the item's blocks are indexed with every variant within half of the block radius r and the window's are looked up
with every variant within the rest of it, so that two fingerprints within 4 * (r + 1) - 1 bits always meet. Whatever meets within that radius is verified: weighted Jaccard similarity of the two
multisets of shingles, sum of smaller counts over sum of larger counts.

Everything here is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import free_names, row_key, written

SIZE = 5
THRESHOLD = 0.8
# Fingerprints of similarity 0.8 differ in 9.7 bits on average: 15 bits (radius 3) would miss 2.7% of such pairs, 23 bits (radius 5)
# about 0.001%.
BLOCK_RADIUS = 5
# Item shingles that are broadcast at a time; a larger benchmark is met in several blocks.
SHINGLES_AT_ONCE = 500_000

_BLOCKS = 4
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), _SEPARATORS), "")


def _shingle(words: str, at: str) -> Column:
    """Hash of the shingle that starts at word ``at`` (from 0)."""
    return F.xxhash64(*[F.get(F.col(words), F.col(at) + j) for j in range(SIZE)])


def _starts(words: str) -> Column:
    n = F.size(words)
    return F.when(n >= SIZE, F.sequence(F.lit(0), n - SIZE))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of rows of (keys, words): adds ``print``, ``total`` (shingles) and ``bag``, the multiset of shingles as
    an array of distinct longs (the n-th occurrence of a shingle is an element of its own)."""
    counted = (
        texts.select(*keys, "words", F.explode(_starts("words")).alias("__at"))
        .select(*keys, _shingle("words", "__at").alias("__h")).groupBy(*keys, "__h").agg(F.count(F.lit(1)).alias("__c"))
    )
    # Two 32-bit counters per sum: bits k and k + 32.
    sums = [
        F.expr(f"sum(__c * ((shiftrightunsigned(__h, {k}) & 1L) + shiftleft(shiftrightunsigned(__h, {k + 32}) & 1L, 32)))").alias(f"__s{k}")
        for k in range(32)
    ]
    bag = F.expr("flatten(collect_list(transform(sequence(1L, __c), n -> xxhash64(__h, n))))").alias("bag")
    summed = counted.groupBy(*keys).agg(F.sum("__c").alias("total"), bag, *sums)
    bits = [f"if(2 * (__s{k} & 4294967295L) > total, shiftleft(1L, {k}), 0L)" for k in range(32)]
    bits += [f"if(2 * shiftrightunsigned(__s{k}, 32) > total, shiftleft(1L, {k + 32}), 0L)" for k in range(32)]
    return summed.select(*keys, "total", "bag", F.expr(" | ".join(bits)).alias("print"))


def _blocks(column: str) -> Column:
    width = 64 // _BLOCKS
    return F.array(*[F.expr(f"cast(shiftrightunsigned({column}, {width * b}) & {(1 << width) - 1}L as int)") for b in range(_BLOCKS)])


def _variants(prints: DataFrame, key: str, radius: int) -> DataFrame:
    """(key, print, slot): every block value within ``radius`` of the fingerprint's, with the block's number."""
    width = 64 // _BLOCKS
    masks = F.expr(f"filter(sequence(0, {(1 << width) - 1}), x -> bit_count(x) <= {radius})")
    return (
        prints.select(key, "print", F.posexplode(_blocks("print")).alias("b", "v"))
        .select(key, "print", "b", "v", F.explode(masks).alias("m"))
        .select(key, "print", F.expr(f"b * {1 << width} + (v ^ m)").alias("slot"))
    )


def _index(items: DataFrame, radius: int) -> DataFrame:
    """(slot, item, item_print): every block value within ``radius`` of the item's, with the block's number."""
    return _variants(items, "item", radius).withColumnRenamed("print", "item_print")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_radius: int = BLOCK_RADIUS,
                 shingles_at_once: int = SHINGLES_AT_ONCE) -> DataFrame:
    """Pairs of document and benchmark item with a window at or above ``threshold``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Returns doc_id,
    item_id, similarity (the best window's), first_word and n_words (that window; of equally similar ones the
    first, then the shortest). Windows that reach over an end of the document are clipped. Null and empty texts, and items
    under five words, match nothing. Repeated rows change nothing; rows that share an id but not a text are looked
    at one by one and reported under their id. Empty tables give no rows. A pair is missed only if its fingerprints differ in more
    than 4 * (block_radius + 1) - 1 bits: by default about 1 of 100,000 pairs at the threshold, fewer above it.
    """
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "first", "length"))
    return (
        _matches(docs, benchmark, threshold, block_radius, shingles_at_once).groupBy("doc_id", "item_id").agg(best.alias("b"))
        .select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.first").cast("long").alias("first_word"), F.col("b.length").cast("long").alias("n_words"))
    )


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_radius: int = BLOCK_RADIUS,
             shingles_at_once: int = SHINGLES_AT_ONCE) -> DataFrame:
    """(doc_id, version, first, length, item_id, similarity) of every window that matches; ``version`` is a digest of its text."""
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words")).distinct()
        .select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")
    )
    items = written(items.where(F.size("words") >= SIZE))
    places = written(
        items.select("words", F.explode(_starts("words")).alias("offset"))
        .select(_shingle("words", "offset").alias("shingle"), "offset", F.size("words").alias("length")).distinct()
    )
    rounds = max(1, math.ceil(places.count() / shingles_at_once))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), _words("text").alias("words"))
    shingles = texts.select("doc_id", "version", "words", F.explode(_starts("words")).alias("at")).withColumn("shingle", _shingle("words", "at"))
    hits = None
    for part in range(rounds):
        known = places if rounds == 1 else places.where(F.pmod(F.xxhash64("shingle"), F.lit(rounds)) == part)
        met = shingles.join(F.broadcast(known), "shingle").select(
            "doc_id", "version", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("first"),
            F.least(F.col("at") - F.col("offset") + F.col("length"), F.size("words")).alias("stop"), "words",
        ).select("doc_id", "version", "first", (F.col("stop") - F.col("first")).alias("length"), F.slice("words", F.col("first") + 1, F.col("stop") - F.col("first")).alias("words"))
        hits = met if hits is None else hits.unionByName(met)
    windows = written(
        hits.groupBy("doc_id", "version", "first", "length").agg(F.first("words").alias("words"))
        .withColumn("content", F.xxhash64("words"))
    )
    contents = windows.groupBy("content").agg(F.first("words").alias("words"))
    prints = written(fingerprints(contents, ["content"]))
    item_prints = written(fingerprints(items, ["item"]))
    radius = _BLOCKS * (block_radius + 1) - 1
    probes = _variants(prints, "content", block_radius - block_radius // 2)
    near = (
        # The index is hundreds of rows per item, which the planner cannot foresee; it is shuffled, never broadcast.
        probes.join(_index(item_prints, block_radius // 2).hint("merge"), "slot")
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("content", "item").distinct()
    )
    shared = F.size(F.array_intersect("bag", "item_bag"))
    verified = (
        near.join(prints, "content")
        .join(item_prints.select("item", F.col("bag").alias("item_bag"), F.col("total").alias("item_total")), "item")
        .select("content", "item", (shared / (F.col("total") + F.col("item_total") - shared)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .join(items.select("item", "item_id"), "item").select("content", "item_id", "similarity")
    )
    return windows.select("doc_id", "version", "first", "length", "content").join(written(verified), "content").drop("content")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id has no match. Rows without an id are judged by their own text."""
    names = free_names(docs, "__key", "__no_id")
    bad = written(_matches(docs, benchmark, **options).select(
        F.coalesce("doc_id", "version").alias(names[0]), F.col("doc_id").isNull().alias(names[1])).distinct())
    return docs.select("*", *row_key(*names)).join(bad, names, "left_anti").select(*docs.columns)


ORACLE = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS length, unnest(range(0, len(w) - 4)) AS o, w FROM b WHERE len(w) >= 5),
ig2 AS (SELECT item_id, length, o, array_to_string(w[o + 1:o + 5], ' ') AS g FROM ig),
place AS (SELECT DISTINCT g, o, length FROM ig2),
dg AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS a FROM d WHERE len(w) >= 5),
hit AS (
    SELECT DISTINCT doc_id, greatest(a - o, 0) AS first, least(a - o + length, len(w)) AS stop
    FROM (SELECT doc_id, w, a, array_to_string(w[a + 1:a + 5], ' ') AS g FROM dg) JOIN place USING (g)),
win AS (SELECT doc_id, first, stop - first AS length, w[first + 1:stop] AS w FROM hit JOIN d USING (doc_id)),
wg AS (SELECT doc_id, first, length, w, unnest(range(0, length - 4)) AS a FROM win),
wc AS (SELECT doc_id, first, length, array_to_string(w[a + 1:a + 5], ' ') AS g, count(*) AS c FROM wg GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ig2 GROUP BY ALL),
n AS (SELECT item_id, sum(c) AS n FROM ic GROUP BY ALL),
m AS (SELECT doc_id, first, length, item_id, sum(least(wc.c, ic.c)) AS s FROM wc JOIN ic USING (g) GROUP BY ALL),
f AS (
    SELECT doc_id, item_id, first, length, s::DOUBLE / (length - 4 + n - s) AS similarity
    FROM m JOIN n USING (item_id) WHERE s::DOUBLE / (length - 4 + n - s) >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first, length) AS k FROM f)
SELECT doc_id, item_id, similarity, first::BIGINT AS first_word, length::BIGINT AS n_words FROM r WHERE k = 1
"""
