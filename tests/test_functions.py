import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import canonical as K
from scoreloom.functions import exprs as E
from scoreloom.functions import ordered as O


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_wilson_known_answers(spark):
    def w(wins, n, **kw):
        lo, hi = E.wilson(F.lit(wins), F.lit(n), **kw)
        return tuple(one(spark, lo.alias("a"), hi.alias("b")))

    assert w(275, 300) == pytest.approx((0.87988, 0.94292), abs=1e-5)
    assert w(34, 100) == pytest.approx((0.25461, 0.43723), abs=1e-5)
    assert w(0, 0) == (0.0, 0.0)
    assert w(0, 0, empty=(0.0, 1.0)) == (0.0, 1.0)
    assert w(0, 0, empty=None) == (None, None)
    assert w(5, 5)[1] == 1.0 and w(0, 5)[0] == 0.0


def test_rate_variants(spark):
    for empty in (0.0, None, math.inf):
        assert one(spark, E.rate(F.lit(1), F.lit(0), empty))[0] == empty
    assert one(spark, E.rate(F.lit(1), F.lit(4)))[0] == 0.25


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "k string, v int")
    got = dict(map(tuple, df.groupBy("k").agg(E.poisoned_sum("v")).collect()))
    assert got == {"a": 3, "b": None}


def test_array_expressions_match_numpy(spark):
    rng = np.random.default_rng(3)
    p, q = rng.random(9), rng.random(9)
    p[2] = 0.0
    row = one(
        spark,
        E.normalised(F.lit(p.tolist())).alias("n"), E.softmax(F.lit(p.tolist()), 0.5).alias("s"), E.log_softmax(F.lit(q.tolist())).alias("l"),
        E.entropy(E.normalised(F.lit(p.tolist()))).alias("e"),
        E.js_divergence(E.normalised(F.lit(p.tolist())), E.normalised(F.lit(q.tolist()))).alias("j"),
        E.first_argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("a"),
    )
    pn, qn = p / p.sum(), q / q.sum()
    soft = np.exp(p / 0.5 - (p / 0.5).max())
    pos = pn > 0
    m = (pn + qn) / 2
    js = 0.5 * np.sum(pn[pos] * np.log(pn[pos] / m[pos])) + 0.5 * np.sum(qn * np.log(qn / m))
    assert np.allclose(row.n, pn) and np.allclose(row.s, soft / soft.sum())
    assert np.allclose(row.l, q - q.max() - math.log(np.exp(q - q.max()).sum()))
    assert row.e == pytest.approx(-np.sum(pn[pos] * np.log(pn[pos]))) and row.j == pytest.approx(js) and row.a == 1


def test_canonical_text_dialects():
    value = {"b": [1.0, 2], "a": "é", "c": {"y": None, "x": True}}
    assert K.canonical_text(value) == '{"a":"\\u00e9","b":[1.0,2],"c":{"x":true,"y":null}}'
    assert K.canonical_text(value, "unicode") == '{"a":"é","b":[1.0,2],"c":{"x":true,"y":null}}'
    assert K.canonical_text({"a": float("nan")}, "unicode") == '{"a":NaN}'
    with pytest.raises(ValueError):
        K.canonical_text({"a": float("nan")}, "unicode_strict")


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_ordered_scans_do_not_depend_on_chunks(spark, width):
    rng = np.random.default_rng(width)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 300), "v": rng.integers(-5, 9, 300).astype(float)})
    pdf["s"] = rng.permutation(1000)[:300]
    df = spark.createDataFrame(pdf).repartition(5)
    out = O.neighbour(df, ["k"], "s", {"p": "v"}, "lag", width)
    out = O.neighbour(out, ["k"], "s", {"n": "v"}, "lead", width)
    out = O.running(out, ["k"], "s", {"t": "v", "rn": F.lit(1)}, width)
    out = O.running_max(out, ["k"], "s", {"m": "v"}, width)
    out = O.islands(out, ["k"], "s", ["v"], "isl", width)
    got = out.toPandas().sort_values(["k", "s"]).reset_index(drop=True)
    ref = pdf.sort_values(["k", "s"]).reset_index(drop=True)
    g = ref.groupby("k")["v"]
    assert got["p"].equals(g.shift(1)) and got["n"].equals(g.shift(-1))
    assert np.allclose(got["t"], g.cumsum()) and np.allclose(got["m"], g.cummax())
    assert (got["rn"] == g.cumcount() + 1).all()
    change = (g.shift(1) != ref["v"]).astype(int).groupby(ref["k"]).cumsum()
    assert (got["isl"] == change).all()


@pytest.mark.parametrize("width", [4, 64])
def test_affine_scan_back(spark, width):
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame({"k": [0] * n, "s": range(n), "m": rng.random(n) * 1.02, "a": rng.normal(size=n)})
    x, want = 0.0, np.zeros(n)
    for i in reversed(range(n)):
        x = pdf.a[i] + pdf.m[i] * x
        want[i] = x
    got = O.affine_scan_back(spark.createDataFrame(pdf), ["k"], "s", "m", "a", "x", width).orderBy("s").toPandas()
    assert np.allclose(got["x"], want)


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_match_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    frames = [
        pd.DataFrame({"k": "normal", "v": rng.normal(size=501)}), pd.DataFrame({"k": "ties", "v": rng.integers(0, 3, 400).astype(float)}),
        pd.DataFrame({"k": "tail", "v": np.exp(rng.normal(size=300) * 8)}), pd.DataFrame({"k": "one", "v": [4.25]}),
        pd.DataFrame({"k": "flat", "v": [2.0] * 37}),
    ]
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).repartition(4)
    qs = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.99}
    lin = O.exact_quantiles(df, ["k"], "v", qs).toPandas().set_index("k")
    near = O.exact_quantiles(df, ["k"], "v", qs, "nearest_rank").toPandas().set_index("k")
    rnd = O.exact_quantiles(df, ["k"], "v", qs, "rounded").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v = np.sort(g["v"].to_numpy())
        for n, q in qs.items():
            assert lin.loc[k, n] == pytest.approx(np.percentile(v, 100 * q), rel=1e-12)
            assert near.loc[k, n] == v[max(0, math.ceil(q * len(v)) - 1)]
            assert rnd.loc[k, n] == v[round((len(v) - 1) * q)]


def test_value_ranks(spark):
    v = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    rows = O.value_ranks(spark.createDataFrame([(x,) for x in v], "v double"), [], "v").orderBy("v").collect()
    assert [(r.v, r.n, r.below, r.total) for r in rows] == [(1.0, 2, 0, 6), (2.0, 1, 2, 6), (3.0, 3, 3, 6)]


def test_content_digest_ignores_partitions(spark):
    df = spark.createDataFrame([(1, "x", [1.5, 2.0])], "a int, b string, c array<double>")
    digest = K.canonical_sha256(df, ["c", "a", "b"]).first()["digest"]
    import hashlib

    text = json.dumps({"a": 1, "b": "x", "c": [1.5, 2.0]}, sort_keys=True, separators=(",", ":"))
    assert digest == hashlib.sha256(text.encode()).hexdigest()
