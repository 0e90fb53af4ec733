"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Vectors get one more component that makes all lengths equal, so that the largest inner product is the smallest angle. Several rotations
are learned on a bounded sample (iterative quantization from different starts); the signs of the rotated vectors are
the code. Codes are cut into substrings of 16 bits. The rows are dealt to blocks of bounded size; inside a block every
substring has an inverted index. A query probes all keys within r bits of its own substring, in every substring: by the pigeonhole
principle this meets every code within substrings * (r + 1) - 1 bits. r grows until that ball holds enough rows of the block; the
whole ball is ranked by exact inner products. Queries are dealt to all blocks, and each block returns only its best rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import written

NEIGHBOURS = 20
ROTATIONS = 4
PART = 16
SAMPLE = 20_000
BLOCK = 16_384
QUERY_BLOCK = 2_048
# Bits within which a substring is probed at first; smaller balls hardly ever hold enough rows of a block.
FIRST_RADIUS = 5
# Rows that a ball must hold, per neighbour wanted.
BALL = 15


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Rotation of the principal axes that brings the rotated rows close to the corners of a cube."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1]
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = x @ axes
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return axes @ turn


def learn_codes(sample: np.ndarray, rotations: int = ROTATIONS) -> np.ndarray:
    """Projection of vectors to code bits: ``rotations`` learned rotations side by side. The number of bits is a multiple of PART."""
    d = sample.shape[1]
    scale = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = sample / np.where(scale > 0, scale, 1.0)
    if len(unit) < d:  # too few rows to learn from: plain rotations
        unit = np.concatenate([unit, np.eye(d)])
    found, bits, seed = [], 0, 0
    while bits < rotations * d or bits % PART:
        more = learn_rotation(unit, seed)
        found.append(more[:, : d if bits + d <= rotations * d else PART - bits % PART])
        bits += found[-1].shape[1]
        seed += 1
    return np.concatenate(found, axis=1)


def codes_of(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """One 16-bit word per substring."""
    return np.packbits(x @ projection >= 0, axis=1).view(">u2").astype(np.uint16)


class MultiIndex:
    """Inverted indexes of all substrings of the codes of one block, laid end to end."""

    def __init__(self, codes: np.ndarray):
        self.n, self.parts = codes.shape
        keys, first, size, order = [], [], [], []
        for p in range(self.parts):
            rows = np.argsort(codes[:, p], kind="stable")
            own, at, count = np.unique(codes[rows, p], return_index=True, return_counts=True)
            keys.append(own)
            first.append(at + p * self.n)
            size.append(count)
            order.append(rows)
        self.cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        self.keys = np.concatenate(keys)
        self.first, self.size, self.order = (np.concatenate(x).astype(np.int32) for x in (first, size, order))
        self.wide = self._wide(codes)

    @staticmethod
    def _wide(codes: np.ndarray) -> np.ndarray:
        """Codes as columns of 64-bit words."""
        spare = -codes.shape[1] % 4
        return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, spare))).view(np.uint64).T)

    def ball(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows of every code within a Hamming radius that is guaranteed complete and holds ``least`` rows (or all)."""
        near = np.empty(len(self.keys), dtype=np.uint8)
        for p in range(self.parts):
            part = slice(self.cuts[p], self.cuts[p + 1])
            np.bitwise_count(self.keys[part] ^ code[p], out=near[part])
        least = min(least, self.n)
        met = np.zeros(self.n, dtype=bool)
        distance = None
        for r in range(FIRST_RADIUS, PART + 1):
            at = np.flatnonzero(near <= r if r == FIRST_RADIUS else near == r)
            size = self.size[at]
            listed = np.repeat(self.first[at] - (np.cumsum(size, dtype=np.int32) - size), size)
            listed += np.arange(len(listed), dtype=np.int32)
            met[self.order[listed]] = True
            if np.count_nonzero(met) < least:
                continue
            if distance is None:
                own = self._wide(code[None, :])
                distance = sum(np.bitwise_count(w ^ q).astype(np.int16) for w, q in zip(self.wide, own))
            inside = np.flatnonzero(met & (distance <= self.parts * (r + 1) - 1))
            if len(inside) >= least:
                return inside
        return np.arange(self.n)


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, lift: np.ndarray, projection: np.ndarray,
                  k: int, ball: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's up to ``k`` best rows of each query: query ids, row ids, inner products."""
    index = MultiIndex(codes_of(np.concatenate([x, lift[:, None]], axis=1), projection))
    probes = codes_of(np.concatenate([q, np.zeros((len(q), 1))], axis=1), projection)
    out_q, out_i, out_s = [], [], []
    distinct = len(np.unique(ids)) == len(ids)
    for n in range(len(q)):
        rows = index.ball(probes[n], (k + 1) * ball)
        rows = rows[ids[rows] != query_ids[n]]
        score = x[rows] @ q[n]
        if distinct and len(rows) > k:
            near = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[near], score[near]
        order = np.lexsort((ids[rows], -score))
        _, once = np.unique(ids[rows][order], return_index=True)  # a repeated id counts by its best row
        top = order[np.sort(once)][:k]
        out_q.append(np.full(len(top), query_ids[n]))
        out_i.append(ids[rows][top])
        out_s.append(score[top])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _search(projection: np.ndarray, longest: float, k: int, ball: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _vectors(table.column("x").combine_chunks())
        asked = table.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        rows = ~asked
        if not asked.any() or not rows.any():
            q, i, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            order = np.flatnonzero(rows)[np.argsort(ids[rows], kind="stable")]
            own = x[order]
            lift = np.sqrt(np.maximum(longest**2 - (own**2).sum(axis=1), 0))
            q, i, s = best_of_block(ids[order], own, ids[asked], x[asked], lift, projection, k, ball)
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, every: int = 20, k: int = NEIGHBOURS, rotations: int = ROTATIONS, sample: int = SAMPLE,
            block: int = BLOCK, query_block: int = QUERY_BLOCK, ball: int = BALL) -> DataFrame:
    """The ``k`` largest inner products found for every row whose vec_id is divisible by ``every``, among all other rows.

    ``embeddings`` has vec_id and embedding (an array of numbers); other columns are ignored. Returns query_id, rank (from 1), vec_id,
    score (the inner product of the original vectors in double precision), nearest first, ties to the smaller vec_id.
    Vectors that are null, zero, or hold a null or a component that is not finite take no part, nor do those whose length differs
    from the commonest (of equally common ones the longest). Rows of the query's own id are no candidates; a repeated id counts once,
    by its best row, and repeated queries are one. With fewer than ``k`` candidates all are returned. An empty table gives no rows.

    ``sample`` bounds the rows (of smallest hash) from which the rotations are learned; all rows are indexed.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("x")).where(
        F.col("vec_id").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False)) & F.exists("x", lambda v: v != 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    clean = written(clean)
    sizes = clean.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = clean.where(F.size("x") == sizes[0]["d"])
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    longest = rows.agg(F.max(length)).first()[0]
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow().column("x").combine_chunks()
    seen = _vectors(seen)
    lift = np.sqrt(np.maximum(longest**2 - (seen**2).sum(axis=1, keepdims=True), 0))
    projection = learn_codes(np.concatenate([seen, lift], axis=1), rotations)
    blocks = max(1, math.ceil(sizes[0]["n"] / block))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    query_blocks = max(1, math.ceil(sizes[0]["n"] / every / query_block))
    queries = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("row_block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("query_block"), F.lit(True).alias("asked"), "vec_id", "x")
    dealt = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")).alias("query_block"), F.lit(False).alias("asked"), "vec_id", "x")
    found = (
        dealt.unionByName(queries).groupBy("row_block", "query_block")
        .applyInArrow(_search(projection, longest, k, ball), "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def brute_force(ids: np.ndarray, x: np.ndarray, every: int = 20, k: int = NEIGHBOURS) -> dict[int, list[int]]:
    """Exact neighbours, for measuring recall."""
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        score = x @ x[n]
        order = np.lexsort((ids, -score))
        out[int(ids[n])] = [int(ids[o]) for o in order if o != n][:k]
    return out
