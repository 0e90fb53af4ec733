"""N-gram Jaccard join of texts: MinHash banding, then exact comparison of full n-gram sets.

Each text becomes the set of its word n-grams (64-bit hashes). Band and row counts follow from the target
recall. Equal texts are folded into one node before anything is compared. Band hashes are shuffled; a
bucket is compared in blocks of bounded size on short MinHash sketches, whose cut lies six standard errors below the
threshold, which only serves to find families of candidates. Inside a family every pair is verified on the
full sets, again block against block, so that each text is shipped once per block and no pair ever becomes a row.
What comes out per document is its class and its number of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.components import connected_components
from scoreloom.llm.tables import free_names, row_key, written
from scoreloom.llm.textwords import mix, shingles_of, text_batches, words_of

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 8
SKETCH = 128
BLOCK = 256

_SIGNED = "doc_id long, key long, no_id boolean, node long, bands array<long>, sketch binary"


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` MinHash values so that a pair at the threshold meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _MinHash:
    """Signatures of ``bands * rows`` values; the numbers follow from a fixed seed."""

    def __init__(self, bands: int, rows: int, sketch: int):
        rng = np.random.default_rng(5)
        n = max(bands * rows, sketch)
        self.bands, self.rows, self.sketch = bands, rows, sketch
        self.factor = (rng.integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.shift = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
        self.fold = rng.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        for low in range(0, len(x), 512):
            value = self.factor * x[None, low : low + 512]
            value += self.shift
            np.minimum(least, value.min(axis=1), out=least)
        rows = least[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        keys = mix((rows * self.fold).sum(axis=1, dtype=np.uint64) + self.salt)
        return keys.view(np.int64), (least[: self.sketch] & np.uint32(255)).astype(np.uint8).tobytes()


def _node(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(words.tobytes()).digest()[:8], "little", signed=True)


def _sign(size: int, bands: int, rows: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = _MinHash(bands, rows, sketch)
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                words, at = words_of(texts)
                nodes, keys, short = [], [], []
                for a, b in zip(at[:-1], at[1:]):
                    if a == b:
                        nodes.append(None), keys.append(None), short.append(None)
                        continue
                    k, s = minhash(np.unique(shingles_of(words[a:b], size)))
                    nodes.append(_node(words[a:b])), keys.append(k), short.append(s)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("doc_id", "key", "no_id")), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    ["doc_id", "key", "no_id", "node", "bands", "sketch"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition; only one run is held besides the current batch."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _lowest(near: np.ndarray) -> np.ndarray:
    """Index of the first row in each row's component of a boolean adjacency matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        heard = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        heard = heard[heard]
        if (heard == label).all():
            return label
        label = heard


def _facing(block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which rows are compared in the block pair (i, j)."""
    if i == j:
        return ~np.eye(len(block), dtype=bool)
    return block[:, None] != block[None, :]


def _tied(like: np.ndarray, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Index of the row that each row of the block pair (i, j) is tied to; itself if to none.

    A block's own pair ties each row to the first one of its part of the block; between two blocks only those are tied to each other.
    """
    to = _lowest(like)
    if i == j:
        return to
    inside = _lowest(like & (block[:, None] == block[None, :]))
    rows = np.arange(len(block))
    return np.where(inside == rows, to, rows)


def _similar_sketches(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for t in _groups(batches, ["bucket", "i", "j"]):
            node = t.column("node").to_numpy()
            if len(node) < 2:
                continue
            order = np.argsort(node)
            node, block = node[order], t.column("block").to_numpy()[order]
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), -1)[order]
            same = np.empty((len(node), len(node)), dtype=np.float32)
            for a in range(0, len(node), 32):
                same[a : a + 32] = (sketch[a : a + 32, None, :] == sketch[None, :, :]).mean(axis=2)
            near = (same - 1 / 256) / (1 - 1 / 256) >= cut
            to = _tied(near, block, t.column("i")[0].as_py(), t.column("j")[0].as_py())
            moved = to != np.arange(len(node))
            left.append(node[moved])
            right.append(node[to[moved]])
            if len(left) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def _grams(size: int):
    """Full n-gram sets of the texts whose node is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_batches(batch, "text"):
                part = batch.slice(low, high - low)
                wanted = part.column("node").to_numpy()
                words, at = words_of(texts)
                keep, sets = [], []
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    if a < b and _node(words[a:b]) == wanted[k]:
                        keep.append(k)
                        sets.append(np.unique(shingles_of(words[a:b], size)).view(np.int64))
                part = part.take(pa.array(keep, pa.int64()))
                names = ["node", "copies", "label", "blocks"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sets, pa.list_(pa.int64()))], [*names, "grams"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of integers."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    if n <= 6:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    column = np.cumsum(np.concatenate(([False], value[1:] != value[:-1])))
    shared = np.bincount(column)[column] > 1
    owner = owner[shared]
    column = np.cumsum(np.concatenate(([0], np.diff(column[shared]) != 0)))
    total = np.zeros((n, n), dtype=np.float64)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            part = np.zeros((n, width), dtype=np.float32)
            part[owner[a:b], column[a:b] - column[a] // width * width] = 1
            total += part @ part.T
    np.fill_diagonal(total, np.diag(out))
    return total.astype(np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["label", "i", "j"]):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            t = t.take(pa.array(first))
            sets = [x.values.to_numpy(zero_copy_only=False) for x in t.column("grams")]
            copies, block = t.column("copies").to_numpy(), t.column("block").to_numpy()
            shared = overlaps(sets)
            own = np.diag(shared)
            like = shared / (own[:, None] + own[None, :] - shared) >= threshold
            np.fill_diagonal(like, False)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            links = (like & _facing(block, i, j)) @ copies
            to = _tied(like, block, i, j)
            some = links > 0
            some |= to != np.arange(len(node))
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(node[to[some]]), pa.array(links[some].astype(np.int64))], ["node", "other", "links"]
                )

    return run


def _thinned(edges: DataFrame) -> DataFrame:
    """(a, b) with the same components: of each text's edges the one to its first text stays, and those texts are linked in a row.

    The first texts of blocks are few and the same for many texts, so their links are too. A text has at most an edge a band and
    block, and its edges pass one by one.
    """
    before = F.lag("b").over(Window.partitionBy("a").orderBy("b"))
    return edges.select(F.coalesce(before, F.col("a")).alias("a"), "b").distinct()


def _block_pairs(df: DataFrame, blocks: str) -> DataFrame:
    """One copy of each row for every block that its own block is compared with, its own included."""
    return (
        df.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)))
        .withColumn("to", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("i", F.least("block", "to").cast("int")).withColumn("j", F.greatest("block", "to").cast("int")).drop("to")
    )


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL,
                    rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Class and number of links of every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, class_id (smallest doc_id of the class), n_links (other rows whose n-gram Jaccard
    similarity is at least ``threshold``), copies (rows with equal words, itself included). Texts with fewer
    than ``size`` words are one n-gram of all their words. Null, empty and wordless texts link to nothing
    and are classes of their own. Rows without an id take part as all others; a class without any id has a null class_id. Repeated rows are copies of each other. Texts count as equal when their words are,
    compared by a 64-bit digest. Pairs at the threshold are found with probability ``recall``, more similar
    ones more surely; a link that is reported is exact.
    """
    return _classed(docs, size, threshold, recall, rows, block).select("doc_id", F.when(~F.col("first.no_id"), F.col("first.key")).alias("class_id"), "n_links", "copies")


def _classed(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, key, no_id, first (no_id and key of the class's first row: the smallest id, or digest if none has an id), n_links, copies."""
    bands = band_count(threshold, recall, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key("key", "no_id"))
    signed = written(texts.mapInArrow(_sign(size, bands, rows, SKETCH), _SIGNED))
    nodes = written(
        signed.where("node is not null").groupBy("node").agg(
            F.min(F.struct("no_id", "key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    band = nodes.select("node", F.explode("bands").alias("bucket"))
    crowd = band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1")
    crowd = written(crowd)
    couples = (
        crowd.where("n = 2").select("a", "b").distinct()
        .select(F.xxhash64("a", "b").alias("bucket"), F.lit(2).cast("long").alias("n"), F.explode(F.array("a", "b")).alias("node"))
    )
    members = couples.unionByName(band.join(crowd.where("n > 2").select("bucket", "n"), "bucket").select("bucket", "n", "node"))
    cut = threshold - 6 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    # Powers of two, so that buckets of about the same texts are cut alike and tie them to the same ones.
    facing = _block_pairs(members.withColumn("blocks", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / block, F.lit(1.0))))).cast("long")), "blocks")
    edges = written(
        facing.select("node", "bucket", "i", "j", "block").join(nodes.select("node", "sketch"), "node")
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_similar_sketches(cut), "a long, b long").distinct()
    )
    family = connected_components(_thinned(edges), "a", "b")
    extent = family.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    wanted = family.join(extent, "label").join(nodes.select("node", "rep", "copies"), "node")
    sets = (
        texts.join(wanted.select("node", "copies", "label", "blocks", "rep.key", "rep.no_id"), ["key", "no_id"])
        .select("node", "copies", "label", "blocks", "text")
        .mapInArrow(_grams(size), "node long, copies long, label long, blocks long, grams array<long>")
    )
    links = written(
        _block_pairs(sets, "blocks").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
        .mapInArrow(_verify(threshold), "node long, other long, links long")
    )
    label = connected_components(links, "node", "other")
    linked = (
        links.groupBy("node").agg(F.sum("links").alias("links")).join(label, "node").join(nodes.select("node", "rep"), "node")
    )
    lowest = linked.groupBy("label").agg(F.min("rep").alias("first"))
    found = linked.join(lowest, "label").select("node", "links", "first")
    # Written, so that the join below shuffles both sides itself and can split a text with very many copies.
    per_node = written(nodes.select("node", "rep", "copies").join(found, "node", "left"))
    return signed.select("doc_id", "key", "no_id", "node").join(per_node, "node", "left").select(
        "doc_id", "key", "no_id",
        F.coalesce("first", "rep", F.struct("no_id", "key")).alias("first"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def first_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` (all columns) for each class: the one with the class's smallest doc_id.

    Rows that share an id share its fate; of equal rows one stays. Rows without an id come after those with one, in order of
    a digest of their text.
    """
    key, no_id, first = free_names(docs, "__key", "__no_id", "__first")
    keys = [key, no_id]
    classes = written(
        _classed(docs, **options).groupBy("key", "no_id")
        .agg(F.max(F.struct("no_id", "key") == F.col("first")).alias(first), F.count(F.lit(1)).alias("n"))
        .where(~F.col(first) | (F.col("n") > 1)).select(F.col("key").alias(key), F.col("no_id").alias(no_id), first)
    )
    gone, again = classes.where(~F.col(first)).drop(first), classes.where(F.col(first)).drop(first)
    kept = docs.select("*", *row_key(*keys)).join(gone, keys, "left_anti")
    single = kept.join(again, keys, "left_anti")
    repeated = kept.join(again, keys, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t
    FROM documents),
g AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i+4], ' '))) AS s
    FROM w WHERE len(t) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
same AS (SELECT doc_id, count(*) OVER (PARTITION BY array_to_string(t, ' ')) AS copies FROM w WHERE len(t) > 0),
e AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
    JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING count(*)::DOUBLE / (nx.n + ny.n - count(*)) >= 0.8),
reach AS (SELECT a AS node, a AS other FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0)::BIGINT AS n_links,
       coalesce(same.copies, 1)::BIGINT AS copies
FROM documents d LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN same ON same.doc_id = d.doc_id
"""
