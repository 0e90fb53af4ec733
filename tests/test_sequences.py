import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.canonical import canonical_text
from scoreloom.operators import sequences as S


def greedy(cands, limit, quota, fill):
    """Plain restatement of the quota rule: one pass per phase in the global order."""
    order = sorted(cands, key=lambda c: (-c[2], c[0]))
    chosen, used = [], {}
    for c in order:
        if c[1] not in used:
            chosen.append(c)
            used[c[1]] = 1
    for c in order:
        if len(chosen) < limit and c not in chosen and used[c[1]] < quota:
            chosen.append(c)
            used[c[1]] += 1
    if len(order) >= fill and len(chosen) < fill:
        chosen += [c for c in order if c not in chosen][: fill - len(chosen)]
    return sorted(c[0] for c in chosen)


@pytest.mark.parametrize("quota", [1, 3])
def test_quota_selection_equals_greedy(spark, quota):
    rng = random.Random(quota)
    rows, want = [], {}
    for g in range(60):
        c = [(f"{g}-{i}", rng.choice("pqr"), rng.randint(0, 4)) for i in range(rng.randint(0, 14))]
        rows += [(g, *x) for x in c]
        if c:
            want[g] = greedy(c, 7, quota, 3)
    df = spark.createDataFrame(rows, "g int, id string, family string, w int").repartition(6)
    out = S.select_landmarks(df, ["g"], limit=7, quota=quota, order=[F.col("w").desc(), F.col("id")], key="id")
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append(r.id)
    assert {g: sorted(v) for g, v in got.items()} == want


def test_gae_matches_reverse_loop(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"env": 0, "t": np.arange(n), "reward": rng.normal(size=n), "value": rng.normal(size=n), "done": rng.random(n) < 0.01,
                        "next_value": 0.7, "next_done": False})
    adv, last = np.zeros(n), 0.0
    for t in reversed(range(n)):
        nv, live = (0.7, 1.0) if t == n - 1 else (pdf.value[t + 1], 1.0 - pdf.done[t + 1])
        last = pdf.reward[t] + 0.99 * nv * live - pdf.value[t] + 0.99 * 0.95 * live * last
        adv[t] = last
    got = S.gae(spark.createDataFrame(pdf).repartition(3), 0.99, 0.95).orderBy("t").toPandas()
    assert np.allclose(got["advantage"], adv) and np.allclose(got["returns"], adv + pdf["value"])


def chain(n=6, key="L"):
    out, prev = [], None
    for i in range(n):
        e = {"kind": "complete" if i == n - 1 else "stage", "previous_event_sha256": prev, "sequence": i + 1, "resources": {"wall": 1.5 * i}}
        e["event_sha256"] = hashlib.sha256(canonical_text(e).encode()).hexdigest()
        prev = e["event_sha256"]
        out.append((key, i, json.dumps(e)))
    return out


def rules(spark, rows):
    df = spark.createDataFrame(rows, "ledger_id string, ordinal int, event string")
    return {r.rule for r in S.verify_chain(df, resources=["wall"], sequence_start=1).collect()}


def test_chain_accepts_and_rejects_mutations(spark):
    good = chain()
    assert rules(spark, good) == set()
    dropped = [r for r in good if r[1] != 2]
    assert "chain_mismatch" in rules(spark, dropped)
    swapped = [*good[:2], ("L", 2, good[3][2]), ("L", 3, good[2][2]), *good[4:]]
    assert {"chain_mismatch", "sequence_mismatch"} <= rules(spark, swapped)
    edited = json.loads(good[3][2])
    edited["resources"]["wall"] = -1.0
    assert {"digest_mismatch", "invalid_wall"} <= rules(spark, [*good[:3], ("L", 3, json.dumps(edited)), *good[4:]])
    assert "incomplete" in rules(spark, good[:-1])
    assert "invalid_json" in rules(spark, [*good[:-1], ("L", 5, "{")])


def test_rolling_gate_statuses(spark):
    def history(name, kinds, ack=None):
        return [(name, i + 1, "kernel_changing" if k == "k" else "content_only", ack) for i, k in enumerate(kinds)]

    rows = history("short", "kk") + history("calm", "kccccccc") + history("loud", "cccckkkk") + history("known", "cccckkkk", 8)
    df = spark.createDataFrame(rows, "h string, sequence int, classification string, ack int")
    got = {r.h: r.gate_status for r in S.rolling_gate(df, ["h"], 6, 4, 1, 2, "ack").collect()}
    assert got == {"short": "insufficient_history", "calm": "within_threshold", "loud": "breached_unacknowledged", "known": "breached_acknowledged"}


def test_sequence_and_cursor_violations(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 4, 6), ("b", 2, 1), ("b", 2, 1)], "k string, s int, c int")
    got = {(r.rule, r.key, r.detail) for r in S.sequence_violations(df, ["k"], "s").collect()}
    assert got == {("gap", "a", "4"), ("wrong_start", "b", "2"), ("duplicate_sequence", "b", "2")}
    assert {r.detail for r in S.cursor_violations(df.filter("k = 'a'"), ["k"], "s", "c").collect()} == {"4"}


def test_normalise_leaves_flat_groups_unscaled(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 9.0)], "k string, v double")
    got = sorted((r.k, round(r.v_normalised, 6)) for r in S.normalise(df, "v", ["k"]).collect())
    assert got == [("a", -0.707107), ("a", 0.707107), ("b", 0.0), ("b", 0.0), ("c", 0.0)]
