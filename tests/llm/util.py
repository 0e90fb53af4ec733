"""Small fixtures and plain re-derivations that the operators are held against."""

import re

import duckdb

from tools.verify import norm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

# Texts with all the oddities a table may hold.
ODD = [None, "", "   \n\t ", "!!! --- ...", "one", "one two three", "é ß Ω 漢字 слово", "a\x00b", "x" * 50_000, "tail\\", "the same line\n" * 3]


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def grams(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def classes(docs, threshold=0.8):
    """doc_id -> (smallest doc_id of its class, links), from all pairs of rows with distinct ids."""
    sets = {i: grams(t) for i, t in docs}
    near = {i: [j for j in sets if j != i and sets[i] and jaccard(sets[i], sets[j]) >= threshold] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(near[i]))
    return out


def by_sql(sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = sorted(range(len(cur.description)), key=lambda k: cur.description[k][0])
    return sorted((tuple(norm(r[k]) for k in names) for r in cur.fetchall()), key=repr), sorted(d[0] for d in cur.description)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr), names
