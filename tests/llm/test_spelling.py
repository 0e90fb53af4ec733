import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import spelling as S
from tests.llm.util import ODD, SF, by_sql, rows_of


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(spark, docs):
    frame = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n long, word string, form string")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.group_spellings(frame.repartition(3)).collect()}


def test_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    want = expected(rows)
    assert got(spark, rows) == want and len(want) > 100


def test_chains_ties_and_oddities(spark):
    words = {"colour": 1000, "colours": 150, "coloors": 25, "coloor": 5, "kolour": 200, "aaaaaaaa": 30, "aaaaaaa": 5, "aaaaaab": 5, "zzzzzz": 5, "ÀÀÀÀÀÀ": 30, "ÀÀÀÀÀÁ": 6}
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, " ".join([w] * n)) for w, n in words.items()]
    docs += [(7, "qwertyuiop " * 3), (7, "qwertyuiop " * 3), (8, ("m" * 40_000 + " ") * 6 + ("m" * 39_999 + " ") * 30)]
    want = expected(docs)
    assert got(spark, docs) == want
    chains = {w: (form, root) for w, form, root, *_ in want}
    assert chains["coloor"][1] == "colour" and chains["m" * 40_000] == ("m" * 39_999,) * 2


def test_empty_table(spark):
    assert S.group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("aabcé", min_size=4, max_size=9), min_size=2, max_size=12, unique=True))
def test_every_near_pair_meets(words):
    held = {}
    for w in words:
        for g in {w[i : i + 2] for i in range(len(w) - 1)}:
            held[g] = held.get(g, 0) + 1
    rank = {g: k for k, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
    prefix = {w: S.gram_prefix(w, rank) for w in words}
    for w in words:
        firsts, lasts = prefix[w]
        assert S.pivots(firsts, lasts) == min((firsts[a] + lasts[b], a, b) for a in firsts for b in lasts if a + 2 <= b)[1:]
        assert len(firsts) <= 3 and len(S.indexed_keys(w, prefix[w])) <= 12
    index = {w: S.indexed_keys(w, prefix[w]) for w in words}
    looked = {w: S.lookup_keys(w, prefix[w]) for w in words}
    for a in words:
        for b in words:
            if one_edit(a, b):
                assert looked[a] & index[b] or looked[b] & index[a], (a, b)


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == by_sql(S.ORACLE)
