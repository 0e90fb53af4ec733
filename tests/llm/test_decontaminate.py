from collections import Counter

from scoreloom.llm import decontaminate
from tests.llm.util import ODD, SF, by_sql, rows_of, words

ITEM = " ".join(f"item{i}" for i in range(30))
SHORT = "only four words here"
FILLER = " ".join(f"fill{i}" for i in range(200))


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items, threshold=0.8):
    """Best similarity of any item-sized window that is laid on a shared shingle."""
    out = {}
    for d, text in docs:
        w = words((text or "").lower())
        for i, item in items:
            v = words((item or "").lower())
            bag = shingles(v)
            for a in range(len(w) - 4):
                for o in range(len(v) - 4):
                    if w[a : a + 5] == v[o : o + 5]:
                        window = shingles(w[max(a - o, 0) : min(a - o + len(v), len(w))])
                        s = sum((window & bag).values()) / sum((window | bag).values())
                        if s >= threshold:
                            out[d, i] = max(out.get((d, i), 0), s)
    return out


DOCS = [
    (1, FILLER + " " + ITEM + " " + FILLER),
    (2, ITEM.upper().replace(" ", ",\n")),
    (3, FILLER),
    (4, " ".join(ITEM.split()[2:])),  # its first two words are missing
    (5, FILLER + " " + ITEM.replace("item15 ", "changed ")),  # too far
    (6, ITEM + " " + ITEM),
    (7, SHORT),
    *((100 + k, t) for k, t in enumerate(ODD)),
]
ITEMS = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, ITEM), (1, ITEM)]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items = frames(spark)
    for at_once in (500_000, 7):
        got = decontaminate.contaminated(docs, items, shingles_at_once=at_once).collect()
        assert {(r.doc_id, r.item_id): r.similarity for r in got} == brute(DOCS, ITEMS)
    assert {d for d, _ in brute(DOCS, ITEMS)} == {1, 2, 4, 6}
    assert [(r.first_word, r.n_words) for r in got if (r.doc_id, r.item_id) == (1, 1)] == [(200, 30)]


def test_keeps_clean_rows_with_all_columns(spark):
    docs = spark.createDataFrame([(i, t, 5, "w") for i, t in DOCS], "doc_id long, text string, item_id long, words string")
    _, items = frames(spark)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in DOCS if i not in (1, 2, 4, 6))


def test_repeated_rows_ties_and_shared_ids(spark):
    docs, items = frames(spark, [(1, ITEM), (1, ITEM), (1, FILLER), (None, ITEM)], [(8, ITEM), (9, ITEM)])
    got = sorted((r.doc_id or 0, r.item_id, r.similarity) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(0, 8, 1.0), (0, 9, 1.0), (1, 8, 1.0), (1, 9, 1.0)]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(DOCS)


def test_blocks_meet_everything_within_the_radius(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = rng.getrandbits(64)
    flipped = []
    for k in range(300):
        x = base
        for b in rng.sample(range(64), rng.randrange(0, 16)):
            x ^= 1 << b
        flipped.append((k, signed(x)))
    items = spark.createDataFrame([(1, signed(base))], "item long, print long")
    probes = spark.createDataFrame(flipped, "content long, print long").select(
        "content", F.posexplode(decontaminate._blocks("print")).alias("b", "v")).selectExpr("content", "b * 65536 + v AS slot")
    assert probes.join(decontaminate._index(items, 3), "slot").select("content").distinct().count() == 300


def test_recall_just_above_the_threshold(spark):
    docs, items = [], []
    near = [(m, k) for m in range(9, 56) for k in range(1, 7) if 0.8 <= (m - k) / (m + k) <= 0.85]
    for i in range(1_000):
        m, k = near[i % len(near)]
        w = [f"i{i}w{j}" for j in range(m + 4)]
        items.append((i, " ".join(w)))
        docs.append((i, " ".join([*w[: m + 4 - k], *(f"c{i}w{j}" for j in range(k))])))
    docs, items = frames(spark, docs, items)
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(1_000)}
    assert all(0.8 <= r.similarity for r in got)


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op1_decontamination"](spark, SF)) == by_sql(decontaminate.ORACLE)


def test_main_path_has_no_python(spark):
    docs, items = frames(spark)
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
