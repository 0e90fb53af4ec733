import numpy as np
import pytest

from scoreloom.llm import ann
from tests.llm.util import SF


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x long, asked boolean")
    out = {}
    for r in sorted(ann.nearest(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def vectors(n, d, seed=0, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x * rng.uniform(0.2, 3, size=(n, 1)).astype(np.float32) if scale else x


def recall(got, ids, x):
    want = ann.brute_force(ids, x.astype(np.float64))
    assert set(got) == set(want)
    return np.mean([len({v for _, v, _ in got[q]} & set(w)) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("scale", [False, True])
def test_recall_over_several_blocks(spark, scale):
    x = vectors(2500, 24, 1, scale)
    ids = np.arange(2500)
    got = search(spark, [(int(i), v.tolist(), 1, True) for i, v in zip(ids, x)], block=700, query_block=50)
    assert recall(got, ids, x) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [s for _, _, s in found] == pytest.approx([float(x[q].astype(float) @ x[v].astype(float)) for _, v, _ in found])
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))


def test_unusable_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    got = search(spark, [(i, v, 1, False) for i, v in rows])
    assert got == {0: [(1, 1, 0.5), (2, 2, 0.5), (3, 20, -1.0)], 20: [(1, 1, -0.5), (2, 2, -0.5), (3, 0, -1.0)]}


def test_empty_and_single(spark):
    assert search(spark, []) == {}
    assert search(spark, [(20, [1.0], 0, False)]) == {}


def test_ball_is_complete():
    x = vectors(900, 16, 3).astype(np.float64)
    codes = ann.codes_of(x, ann.learn_codes(x, 2))
    index = ann.MultiIndex(codes)
    for q in range(0, 900, 90):
        distance = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        ball = index.ball(codes[q], 60)
        assert len(ball) >= 60
        assert set(np.flatnonzero(distance < distance[ball].max())) <= set(ball.tolist())


def test_recall_on_given_table(spark):
    from scoreloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = {}
    for r in QUERIES["op6_ann"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert recall(got, rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy())) >= 0.95
