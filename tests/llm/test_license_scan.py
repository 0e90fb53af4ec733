from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import license_scan as L
from tests.llm.util import ODD, SF, words

MIT = L.TEMPLATES[0][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=30))
def test_matching_statistics(sequences, text):
    automaton = L.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = length = 0
    for i, symbol in enumerate(text, 1):
        state, length = automaton.advance(state, length, symbol)
        longest = max((n for n in range(1, i + 1) if tuple(text[i - n : i]) in runs), default=0)
        assert length == longest
        if length:
            ends = {(k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == text[i - length : i]}
            assert set(automaton.places(state)) == ends


def brute(text):
    w = words(text)
    found = []
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


TEXTS = [
    *ODD, "CC BY cc-by, cc  by", "all rights reserved all rights reserved", "GNU General Public License", "general public", "cc\nby " * 40,
    "Foo " + MIT.title() + " bar", " ".join(MIT.split()[:12] + ["xx", "yy"] + MIT.split()[12:]), " ".join(MIT.split()[:9]), "all rights\x00reserved",
]


def test_base_places_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, base string, spans int").repartition(3)
    got = {r.doc_id: r for r in L.scan_licences(df).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_words, sorted((b.word, b.label) for b in got[i].base)) == brute(t), t
    spans = {i: [(s.label, s.first, s.last, s.covered) for s in got[i].spans] for i in got}
    n = len(MIT.split())
    k = len(ODD) + 5
    assert ("mit", 1, n, n) in spans[k]
    assert ("mit", 0, n + 1, n) in spans[k + 1]  # two words left out in between
    assert spans[k + 2] == []  # too little of it


def test_summary(spark):
    df = spark.createDataFrame([(1, "CC BY and " + MIT + " all rights reserved"), (2, None), (2, None)], "doc_id long, text string")
    rows = sorted(L.licence_summary(L.scan_licences(df)).collect())
    assert rows[0].base_labels == "cc-by,reserved" and rows[0].labels == "cc-by,mit,reserved" and rows[0].score == 1.0
    assert (rows[0].first_word, rows[0].last_word, rows[0].n_base) == (0, 3 + len(MIT.split()), 2)
    assert [tuple(r) for r in rows[1:]] == [(2, 0, 0, None, None, "", "", 0.0)] * 2
    assert L.licence_summary(L.scan_licences(df.limit(0))).collect() == []


def test_other_phrases(spark):
    df = spark.createDataFrame([(1, "free mit mit the mit")], "doc_id long, text string")
    row = L.scan_licences(df, phrases=(("mit", "m"), ("mit the mit", "long")), templates=()).first()
    assert sorted((b.word, b.label) for b in row.base) == [(1, "m"), (2, "long"), (2, "m"), (4, "m")]


def test_query_on_given_table(spark):
    from scoreloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, places = brute(r.text)
        starts = [p for p, _ in places]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert g.base_labels == ",".join(sorted({l for _, l in places})) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
