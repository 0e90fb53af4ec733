import hashlib
import itertools
import random

import pytest

from scoreloom.llm import turn_repair as T
from tests.llm.util import SF, by_sql, rows_of

SCHEMA = "conv_id long, turn long, role string, text string, pos long, edit string, ways string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def fits(initials):
    body = initials[1:] if initials[:1] == ["s"] else initials
    return initials == [] or (len(body) > 0 and len(body) % 2 == 0 and all(c == "ua"[k % 2] for k, c in enumerate(body)))


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """Every sequence of edits with at most two insertions before each turn and at the end: (cost, audit, repaired text)."""
    found, faults = [], faults_of(turns)
    inserts = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    for before in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product("KUAD", repeat=len(turns)):
            cost = 5 * sum(map(len, before))
            audit, out = "", []
            for extra, edit, (role, text), fault in zip(before, edits, turns, faults):
                audit += "I" * len(extra) + ("R" if edit in "UA" else edit)
                out += [({"u": "user", "a": "assistant"}[x], "") for x in extra]
                if edit != "D":
                    if fault in ("blank", "duplicate"):
                        break
                    out.append((role if edit == "K" else {"U": "user", "A": "assistant"}[edit], text))
                    cost += (edit != "K") + 5 * (fault == "truncated")
                else:
                    cost += 2
            else:
                audit += "I" * len(before[-1])
                out += [({"u": "user", "a": "assistant"}[x], "") for x in before[-1]]
                if fits([r[:1] for r, _ in out]):
                    found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
    return min(found)


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] if r[3] is not None else " "))
        turns = [(r if r is not None else " ", t if t is not None else " ") for _, _, r, t in mine]
        faults = faults_of(turns)
        cost, audit, text = cheapest(turns)
        numbers = {r[1] for r in mine if r[1] is not None}
        out[c] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def summary(df):
    got = T.repair_summary(T.repair_conversations(df), df).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_the_cheapest_of_all_edits(spark):
    dice = random.Random(3)
    rows = []
    for c in range(90):
        for turn in range(dice.randint(0, 3)):
            rows.append((c, dice.choice([turn, turn, 2 * turn, None]), dice.choice(["user", "assistant", "system", "tool", "", None, "ua"]),
                         dice.choice(["Fine.", "Good? \n", "cut off", "", " \t\x0b", None, "Fine."])))
    rows += [(None, 0, "user", "Nobody's."), (None, 0, "user", "Nobody's."), (None, None, "assistant", "é!")]
    assert summary(frame(spark, rows).repartition(5)) == expected(rows)


def test_runs_are_chained(spark, monkeypatch):
    """Blocks of four turns: conversations go on over many runs, and the result is that of one run."""
    dice = random.Random(5)
    rows = [
        (c, t, dice.choice(["user", "assistant", "assistant", "user", "system", "x"]), dice.choice([f"Turn {t}.", f"Turn {t}.", "again.", f"cut {t}", ""]))
        for c in range(6) for t in range(dice.randint(30, 60))
    ]
    whole = summary(frame(spark, rows).coalesce(1))
    monkeypatch.setattr(T, "_RUN_BITS", 2)
    assert summary(frame(spark, rows).repartition(3)) == whole
    assert max(len(v[6]) for v in whole.values()) > 30


def test_digest_is_of_the_rows(spark):
    rows = [(1, 0, "tool", "Question?"), (1, 1, "assistant", "Answer."), (1, 2, "assistant", "y" * 300_000 + "."), (1, 3, "user", " ")]
    done = T.repair_conversations(frame(spark, rows))
    turns = done.turns.where("edit != 'D'").orderBy("pos", "step").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in turns)
    assert summary(frame(spark, rows))[1][7] == hashlib.sha256(text.encode()).hexdigest()
    assert {r.old_role for r in turns if r.edit == "R"} <= {"tool", "assistant"}


def test_other_grammars():
    """Turns between s and t brackets; the stacks of a repetition written the wrong way round have no bound."""
    g = T.Grammar((("C", ()), ("C", ("C", "P")), ("P", ("u", "a", "t"))), "C")
    r = T.Repairer(g)
    ways = {0: (0, "", "")}
    for initial in "uat":
        ways = r.walk(ways, initial, False, False)
    assert min((c + r.ends[n][0], a + r.ends[n][1]) for n, (c, a, _) in ways.items() if n in r.ends) == (0, "KKK")
    with pytest.raises(ValueError):
        T.Repairer(T.Grammar((("C", ("u",)), ("C", ("u", "C"))), "C"))


def test_empty_table(spark):
    empty = frame(spark, [(1, 1, "u", "t")]).limit(0)
    done = T.repair_conversations(empty)
    assert done.turns.collect() == [] and T.repair_summary(done, empty).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "system", "One. Two! Three?") for c in (None, *range(40)) for t in (None, 0, 1)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 else text)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in T.damaged(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_query_equals_sql(spark):
    from scoreloom.llm.queries import QUERIES

    assert rows_of(QUERIES["op11_conversation_repair"](spark, SF)) == by_sql(T.ORACLE)
