import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import chat_format as C
from tests.llm.util import SF, by_sql, rows_of

PIECES = st.lists(st.sampled_from(["\\", "### ", "</turn>", ": ", "role=", "Assistant", "</tur", "n>", "#", " ", "\n", "é", "a", "###"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), PIECES), PIECES)
def test_a_turn_reads_back(role, text):
    t = C.Template()
    parts = t.segments(role, text)
    assert t.parse("".join(p for p, _ in parts)) == (role, text)
    assert "".join(t.unescape(p) for p, loss in parts if loss) == (text if role == "assistant" else "")


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long, segments string")


ROWS = [
    (1, 1, "assistant", "b", 9, "x"), (1, 0, "user", "### User: </turn>\\", 9, "x"), (2, 0, "assistant", "first", 9, "x"), (3, None, None, None, 9, "x"),
    (3, 0, "tool: </turn>", "", 9, "x"), (4, 0, "user", "same", 9, "x"), (4, 0, "user", "same", 9, "x"), (None, 0, "user", "nobody's", 9, "x"),
    *((5, k, ("user", "assistant")[k % 2], f"t{k} " * (k % 5), 9, "x") for k in range(400)), (6, 0, "user", "y" * 200_000, 9, "x"),
]


def test_digests(spark):
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(frame(spark, ROWS).repartition(4))).collect()}
    want = {}
    for c, turn, role, text, _, _ in sorted(ROWS, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: got[c].n_violations for c in (1, 2, 4, 5)} == {1: 0, 2: 1, 4: 1, 5: 0}


def test_empty_table(spark):
    assert C.read_back(C.format_conversations(frame(spark, ROWS).limit(0))).collect() == []


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op8_chat_format"](spark, SF)) == by_sql(C.ORACLE)
