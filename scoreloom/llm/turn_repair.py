"""Repair of conversations by generalised LR parsing over a grammar of roles.

A conversation's turns are the input; the grammar says which sequences of role initials are conversations. All cheapest ways to make
the input fit (keep a turn, give it another role, delete it, insert an empty one) are followed at once: stacks of LR states
share their tails in one graph, each turn moves every stack top, and equal tops merge to the one of least (cost, audit),
the audit being the edits' initials so far. A prefix's audit never is the beginning of another one of equal cost that ends in the
same turn, so merging loses no cheapest repair.

The grammar must be left-recursive where it repeats; then there are only a few different stacks, and what a run of turns does is a
small table: for every stack before it, the cheapest way to every stack behind it. Conversations are therefore cut into runs of
bounded length that are parsed apart from each other, their tables are chained, and the chosen ways are read
off. A conversation of any length is spread over many tasks; only its tables, and at last its
digest, are walked in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.tables import written

# Turns of a run, as a power of two.
_RUN_BITS = 12

# Edits. Small letters and capitals of a role are told apart only here; in an audit both are I or R.
_AUDIT = str.maketrans({"U": "R", "A": "R", "u": "I", "a": "I"})


@dataclass(frozen=True)
class Grammar:
    """Productions over role initials; ``start`` derives whole conversations. By default ``(s?(ua)+)?``."""

    productions: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("Conversation", ()),
        ("Conversation", ("Turns",)),
        ("Conversation", ("s", "Turns")),
        ("Turns", ("Exchange",)),
        ("Turns", ("Turns", "Exchange")),
        ("Exchange", ("u", "a")),
    )
    start: str = "Conversation"
    roles: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Tables:
    """LR automaton of a grammar: items closed over productions, with the terminals that may follow each nonterminal."""

    def __init__(self, grammar: Grammar):
        rules = [("", (grammar.start,)), *grammar.productions]
        self.rules = rules
        names = {left for left, _ in rules}
        self.terminals = {x for _, right in rules for x in right if x not in names}
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in names} | {t: {t} for t in self.terminals}
        follow: dict[str, set[str]] = {n: set() for n in names}
        follow[""] = {"$"}
        while True:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for left, right in rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first[x]
                    if x not in empty:
                        break
                behind = set(follow[left])
                for x in reversed(right):
                    if x in names:
                        follow[x] |= behind
                    behind = first[x] | (behind if x in empty else set())
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                break

        def closed(items: set) -> frozenset:
            todo, out = list(items), set(items)
            while todo:
                rule, dot = todo.pop()
                right = rules[rule][1]
                if dot < len(right):
                    for k, (left, _) in enumerate(rules):
                        if left == right[dot] and (k, 0) not in out:
                            out.add((k, 0))
                            todo.append((k, 0))
            return frozenset(out)

        states = [closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], list[int]] = {}
        for number, items in enumerate(states):  # grows while it is walked
            for symbol in sorted({rules[r][1][d] for r, d in items if d < len(rules[r][1])}):
                target = closed({(r, d + 1) for r, d in items if d < len(rules[r][1]) and rules[r][1][d] == symbol})
                if target not in states:
                    states.append(target)
                self.goto[number, symbol] = states.index(target)
            for r, d in items:
                if r and d == len(rules[r][1]):
                    for symbol in follow[rules[r][0]]:
                        self.reduce.setdefault((number, symbol), []).append(r)
        self.accepting = {number for number, items in enumerate(states) if (0, 1) in items}


Way = tuple[int, str, str]  # cost, audit, edits


class Repairer:
    """The graph of stacks of one grammar. A node is (LR state, node beneath) and is kept once, so stacks share their tails."""

    def __init__(self, grammar: Grammar = Grammar(), costs: Costs = Costs()):
        self.grammar, self.costs, self.tables = grammar, costs, Tables(grammar)
        self.nodes: list[tuple[int, int]] = []
        self.numbers: dict[tuple[int, int], int] = {}
        self.shifted: dict[tuple[int, str], list[int]] = {}
        self.moved: dict[tuple, list[tuple[int, int, str, str]]] = {}
        root = self._node(0, -1)
        reached, todo = {root}, [root]
        while todo:  # all stacks that any turns can lead to
            top = todo.pop()
            new = {node for symbol in sorted(self.tables.terminals) for node in self._shift(top, symbol)} - reached
            reached |= new
            todo += sorted(new)
            if len(reached) > 4096:
                raise ValueError("the grammar's stacks grow without bound; write its repetitions left-recursively")
        self.stacks = sorted(reached)
        self.ends = {n: way for n in self.stacks if (way := self._end(n)) is not None}

    def _node(self, state: int, beneath: int) -> int:
        key = (state, beneath)
        if key not in self.numbers:
            self.numbers[key] = len(self.nodes)
            self.nodes.append(key)
        return self.numbers[key]

    def _reduced(self, top: int, symbol: str) -> list[int]:
        """Stack tops after any reductions that ``symbol`` allows, ``top`` among them."""
        out, todo = [top], [top]
        while todo:
            node = todo.pop()
            for rule in self.tables.reduce.get((self.nodes[node][0], symbol), ()):
                left, right = self.tables.rules[rule]
                beneath = node
                for _ in right:
                    beneath = self.nodes[beneath][1]
                state = self.tables.goto.get((self.nodes[beneath][0], left))
                if state is not None and (new := self._node(state, beneath)) not in out:
                    out.append(new)
                    todo.append(new)
        return out

    def _shift(self, top: int, symbol: str) -> list[int]:
        key = (top, symbol)
        if key not in self.shifted:
            found = [(self.tables.goto.get((self.nodes[n][0], symbol)), n) for n in self._reduced(top, symbol)]
            self.shifted[key] = [self._node(state, n) for state, n in found if state is not None]
        return self.shifted[key]

    def _inserted(self, ways: dict[int, Way]) -> dict[int, Way]:
        """``ways`` and all that insertions reach from them."""
        out, todo = dict(ways), list(ways)
        while todo:
            top = todo.pop()
            cost, audit, edits = out[top]
            for initial in self.grammar.roles:
                new = (cost + self.costs.insert, audit + "I", edits + initial)
                for node in self._shift(top, initial):
                    if node not in out or new < out[node]:
                        out[node] = new
                        todo.append(node)
        return out

    def _end(self, top: int) -> Way | None:
        """The cheapest insertions that make the stack a whole conversation."""
        found = [way for node, way in self._inserted({top: (0, "", "")}).items() if any(self.nodes[n][0] in self.tables.accepting for n in self._reduced(node, "$"))]
        return min(found) if found else None

    def _moves(self, top: int, initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, str, str]]:
        """Where one turn leads from a stack top: insertions, then one edit of the turn."""
        key = (top, initial, must_go, truncated)
        if key not in self.moved:
            best: dict[int, Way] = {}
            extra = self.costs.truncated if truncated else 0
            for node, (cost, audit, edits) in self._inserted({top: (0, "", "")}).items():
                options = [(node, self.costs.delete, "D")]
                if not must_go:
                    if initial in self.tables.terminals:
                        options += [(n, self.costs.keep + extra, "K") for n in self._shift(node, initial)]
                    for role in self.grammar.roles:
                        options += [(n, self.costs.rerole + extra, role.upper()) for n in self._shift(node, role)]
                for n, price, edit in options:
                    way = (cost + price, audit + edit.translate(_AUDIT), edits + edit)
                    if n not in best or way < best[n]:
                        best[n] = way
            self.moved[key] = [(n, *way) for n, way in best.items()]
        return self.moved[key]

    def walk(self, ways: dict[int, Way], initial: str, must_go: bool, truncated: bool) -> dict[int, Way]:
        """All stack tops after one more turn; equal ones are merged to the least (cost, audit)."""
        out: dict[int, Way] = {}
        for top, (cost, audit, edits) in ways.items():
            for node, price, more_audit, more in self._moves(top, initial, must_go, truncated):
                new = cost + price
                if node not in out or new < out[node][0] or (new == out[node][0] and audit + more_audit < out[node][1]):
                    out[node] = (new, audit + more_audit, edits + more)
        return out


_BLANKS = r"' \t\n' || char(11) || char(12) || '\r'"
_RUN_SCHEMA = (
    "conv_id long, run long, low long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "ways array<struct<entry:int,exit:int,cost:long,audit:string,edits:string>>"
)
_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.string())]))
_LEGAL = {"su", "ua", "au"}


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, said) of ``conversations`` (conv_id, turn, role, text), written.

    ``pos`` grows by conversation, turn (null first), role and text over the whole table; equal rows are next to each other. Null roles and texts are
    one space. ``said`` is a digest of role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    # Equal rows may be many, so a last key lets a range boundary fall between them.
    order = ["conv_id", "turn", "role", "text", "copy"]
    return written(
        rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
        .withColumn("pos", F.monotonically_increasing_id())
        .withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    )


def faults(placed: DataFrame) -> DataFrame:
    """(conv_id, pos, initial, fault) of the turns of ``turns_in_order``.

    ``fault`` is the first of ``blank`` (nothing but blanks), ``duplicate`` (role and text of an earlier turn of the conversation),
    ``truncated`` (the last character but blanks is none of ``.!?``), or null.
    """
    firsts = (
        placed.groupBy("conv_id", "said").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times")).where("times > 1")
        .select(F.col("conv_id").alias("their_id"), F.col("said").alias("their_said"), "first_pos")
    )
    repeated = (
        placed.select("conv_id", "said", "pos")
        .join(firsts, F.col("conv_id").eqNullSafe(F.col("their_id")) & (F.col("said") == F.col("their_said")))
        .where("pos > first_pos").select("pos", F.lit(True).alias("again"))
    )
    body = F.expr(f"rtrim({_BLANKS}, text)")
    last = placed.select("conv_id", "pos", F.col("role").substr(1, 1).alias("initial"), F.right(body, F.lit(1)).alias("last"))
    return last.join(repeated, "pos", "left").select(
        "conv_id", "pos", "initial",
        F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").alias("fault"))


def _run_tables(repairer: Repairer):
    """For each run of a conversation's turns: its counts, and the cheapest ways from every stack before it to every one behind it.

    A conversation that begins inside a block of positions begins with the empty stack; only the first of a
    block may go on from the block before.
    """

    def table(conv_id, run, low, inside, turns) -> dict:
        ways = []
        for entry in [0] if inside else repairer.stacks:
            reached = {entry: (0, "", "")}
            for initial, fault in turns:
                reached = repairer.walk(reached, initial, fault in ("blank", "duplicate"), fault == "truncated")
            ways += [{"entry": entry, "exit": n, "cost": c, "audit": a, "edits": e} for n, (c, a, e) in sorted(reached.items())]
        initials, faults = [t[0] for t in turns], [t[1] for t in turns]
        return {
            "conv_id": conv_id, "run": run, "low": low, "n": len(turns), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1], "ways": ways,
        }

    schema = pa.schema([
        ("conv_id", pa.int64()), ("run", pa.int64()), *((k, pa.int64()) for k in ("low", "n", "blank", "duplicate", "truncated", "illegal")),
        ("first", pa.string()), ("last", pa.string()), ("ways", _WAYS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, turns, inside, done, size = (), 0, [], False, [], 0
        for batch in batches:
            for at, c, pos, initial, fault in zip(*(batch.column(k).to_pylist() for k in ("run", "conv_id", "pos", "initial", "fault"))):
                if turns and key != (at, c):
                    done.append(table(key[1], key[0], low, inside, turns))
                    size += len(turns)
                    inside, turns = at == key[0], []
                    if size > 1 << _RUN_BITS:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, size = [], 0
                if not turns:
                    key, low = (at, c), pos
                turns.append((initial, fault))
        if turns:
            done.append(table(key[1], key[0], low, inside, turns))
        yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _chosen(repairer: Repairer):
    """Chains the tables of a conversation's runs, in order, and tells each run the stack it begins and ends with.

    Held of a conversation: for each run a few numbers, the stack that each stack behind it is best reached from.
    """

    def finish(runs: list, backs: list, reached: dict) -> list[dict]:
        total, _, node, tail = min((c + repairer.ends[n][0], rank, n, repairer.ends[n]) for n, (c, rank) in reached.items() if n in repairer.ends)
        out = []
        for k in range(len(runs) - 1, -1, -1):
            before = backs[k][node]
            last = k == len(runs) - 1
            out.append(runs[k] | {"entry": before, "exit": node, "end_cost": tail[0] if last else 0, "end_audit": tail[1] if last else "", "end_edits": tail[2] if last else ""})
            node = before
        return out[::-1]

    schema = pa.schema([
        ("conv_id", pa.int64()), ("run", pa.int64()), ("border", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()),
        ("end_cost", pa.int64()), ("end_audit", pa.string()), ("end_edits", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started, runs, backs, reached, previous = None, False, [], [], {}, ""
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if started and row["conv_id"] != conv:
                    done += finish(runs, backs, reached)
                if not started or row["conv_id"] != conv:
                    conv, started, runs, backs, reached, previous = row["conv_id"], True, [], [], {0: (0, 0)}, None
                found: dict[int, tuple[int, int, str, int]] = {}
                for way in row["ways"]:
                    if way["entry"] in reached:
                        cost, rank = reached[way["entry"]]
                        new = (cost + way["cost"], rank, way["audit"], way["entry"])
                        if way["exit"] not in found or new < found[way["exit"]]:
                            found[way["exit"]] = new
                # Audits so far differ between stacks and none begins another, so their order is all that is needed later.
                places = {key: k for k, key in enumerate(sorted({(rank, audit) for _, rank, audit, _ in found.values()}))}
                reached = {n: (cost, places[rank, audit]) for n, (cost, rank, audit, _) in found.items()}
                backs.append({n: entry for n, (_, _, _, entry) in found.items()})
                runs.append({"conv_id": conv, "run": row["run"], "border": int(previous is not None and previous + row["first"] not in _LEGAL)})
                previous = row["last"]
            yield pa.RecordBatch.from_pylist(done, schema)
        if started:
            yield pa.RecordBatch.from_pylist(finish(runs, backs, reached), schema)

    return run


def _per_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit of a run, with the position of its turn; an insertion has that of the turn it stands before."""
    names = ["conv_id", "pos", "step", "edit"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, low, edits in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "low", "edits"))):
            pos = low
            for step, edit in enumerate(edits):
                rows.append((conv_id, pos, step, edit))
                pos += edit not in "ua"
            if len(rows) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _applied(grammar: Grammar):
    """Edits next to the turns they are made to, in order: a turn comes before all edits of its position."""
    names = ["conv_id", "pos", "step", "edit", "turn", "role", "text", "old_role"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = role = text = None
        for batch in batches:
            rows = []
            for conv_id, pos, step, edit, *said in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "pos", "step", "edit", "turn", "role", "text"))):
                if edit is None:
                    turn, role, text = said
                elif edit in grammar.roles:
                    rows.append((conv_id, pos, step, "I", None, grammar.roles[edit], "", None))
                elif edit in "KD":
                    rows.append((conv_id, pos, step, edit, turn, role, text, role))
                else:
                    rows.append((conv_id, pos, step, "R", turn, grammar.roles[edit.lower()], text, role))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


@dataclass(frozen=True)
class Repaired:
    """``turns``: one row per edit (conv_id, pos, step, edit, turn, role, text, old_role), a conversation's rows in order in one task; ``runs``: one row per
    run of turns with the sums of its faults, its cost and its audit (conv_id, run, n, blank, duplicate, truncated, illegal, cost, audit);
    ``placed``: the turns that were read, in order."""

    turns: DataFrame
    runs: DataFrame
    placed: DataFrame


def repair_conversations(conversations: DataFrame, grammar: Grammar = Grammar(), costs: Costs = Costs()) -> Repaired:
    """The cheapest repair of each conversation of ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Turns are taken by turn (null first), then role, then text; repeated rows are turns of their own. Null roles and texts are one space;
    rows with a null conv_id are one conversation. Blank and duplicate turns are always deleted, truncated ones cost more unless they
    are. Of equally cheap repairs the one with the least audit is taken. Rows of ``turns`` in order of (pos, step) are the repaired
    conversation without those of edit ``D``; inserted turns (``I``) have empty texts and no turn, and new roles (``R``) keep the
    old one beside them. An empty table gives no rows.
    """
    repairer = Repairer(grammar, costs)
    placed = turns_in_order(conversations)
    runs = written(
        faults(placed).withColumn("run", F.shiftright("pos", _RUN_BITS))
        .repartition("run").sortWithinPartitions("run", "pos").select("run", "conv_id", "pos", "initial", "fault")
        .mapInArrow(_run_tables(repairer), _RUN_SCHEMA)
    )
    chosen = (
        runs.select("conv_id", "run", "first", "last", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "run")
        .mapInArrow(_chosen(repairer), "conv_id long, run long, border long, entry int, exit int, end_cost long, end_audit string, end_edits string")
        .withColumnsRenamed({"conv_id": "their_id", "run": "their_run"})
    )
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
    done = written(
        runs.join(chosen, F.col("conv_id").eqNullSafe(F.col("their_id")) & (F.col("run") == F.col("their_run"))).withColumn("way", way)
        .select(
            "conv_id", "run", "low", "n", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"),
            (F.col("way.cost") + F.col("end_cost")).alias("cost"), F.concat("way.audit", "end_audit").alias("audit"), F.concat("way.edits", "end_edits").alias("edits"))
    )
    edits = done.select("conv_id", "low", "edits").mapInArrow(_per_turn, "conv_id long, pos long, step int, edit string")
    said = placed.select("conv_id", "pos", F.lit(-1).alias("step"), F.lit(None).cast("string").alias("edit"), "turn", "role", "text")
    turns = (
        said.unionByName(edits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step")
        .mapInArrow(_applied(grammar), "conv_id long, pos long, step int, edit string, turn long, role string, text string, old_role string")
    )
    return Repaired(turns, done.drop("low", "edits"), placed)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation, in order and one turn at a time: the digest of what stays."""
    conv, started, digest, any_ = None, False, hashlib.sha256(), False
    for batch in batches:
        done = []
        for c, edit, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "edit", "role", "text"))):
            if started and c != conv:
                done.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
            if not started or c != conv:
                conv, started, digest, any_ = c, True, hashlib.sha256(), False
            if edit != "D":
                digest.update((("\n" if any_ else "") + f"{role}:{text}").encode())
                any_ = True
        yield pa.RecordBatch.from_pylist(done, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
    if started:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def repair_summary(repaired: Repaired, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each distinct conv_id of ``ids``.

    ``gaps`` counts turn numbers missing between the first and last one; null turns don't count. A conversation without turns has
    zeros, an empty audit and the digest of nothing. The audit is as long as its conversation.
    """
    spans = repaired.placed.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("seen"))
    gaps = spans.select(F.col("conv_id").alias("g_id"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("seen"), F.lit(0)).alias("gaps"))
    sums = repaired.runs.groupBy("conv_id").agg(
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "audit"))), lambda r: r["audit"]), "").alias("audit"))
    sums = sums.withColumnRenamed("conv_id", "s_id")
    digests = (
        repaired.turns.select("conv_id", "edit", "role", "text")
        .mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d_id")
    )
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return (
        every.join(gaps, F.col("conv_id").eqNullSafe(F.col("g_id")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("s_id")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("d_id")), "left")
        .select(
            "conv_id", *(F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    )


def _place_digest() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    return F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with every fifth turn harmed, by the digest of its conversation and turn (nulls are one space).

    0 drops the turn, 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes its role ``user``.
    """
    kind = _place_digest()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return (
        conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("copies", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .drop("kind", "copies")
    )


# The grammar as four states (nothing, after s, after u, after a), a turn at a time. Before a turn at most one insertion can
# be part of a cheapest repair, since two lead back; at the end there may be two.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i] || [0::BIGINT for _ in range(8)],
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc_table),
harmed AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM marked WHERE kind != 0),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
turns AS (
    SELECT c, turn, role, text, row_number() OVER o AS k, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) AS again,
           regexp_replace(text, '[ 	-
]+$', '') AS body
    FROM harmed JOIN ids ON harmed.conv_id IS NOT DISTINCT FROM ids.conv_id WINDOW o AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
faulty AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) AS before,
           CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM turns),
arcs(x, y, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
inserts AS (
    SELECT x, x AS y, 0 AS cost, '' AS audit, '' AS edits FROM (VALUES (0), (1), (2), (3)) v(x)
    UNION ALL SELECT x, y, 5, 'I', initial FROM arcs WHERE initial != 's'),
options AS (
    SELECT f.c, f.k, i.x, e.y, i.cost + e.cost AS cost, i.audit || e.audit AS audit, i.edits || e.edits AS edits
    FROM faulty f, inserts i, LATERAL (
        SELECT i.y AS y, 2 AS cost, 'D' AS audit, 'D' AS edits
        UNION ALL SELECT a.y, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', 'K' FROM arcs a WHERE a.x = i.y AND a.initial = f.initial AND f.fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT a.y, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', upper(a.initial) FROM arcs a
                  WHERE a.x = i.y AND a.initial != 's' AND f.fault NOT IN ('blank', 'duplicate')) e),
walk(c, k, y, cost, audit, edits) AS (
    SELECT c, 0::BIGINT, 0, 0, '', '' FROM ids
    UNION ALL
    SELECT c, k, y, best.cost, best.audit, best.edits FROM (
        SELECT w.c, o.k, o.y, min({'cost': w.cost + o.cost, 'audit': w.audit || o.audit, 'edits': w.edits || o.edits}) AS best
        FROM walk w JOIN options o ON o.c = w.c AND o.k = w.k + 1 AND o.x = w.y GROUP BY w.c, o.k, o.y)),
ends(y, cost, audit, edits) AS (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 5, 'I', 'a'), (1, 10, 'II', 'ua')),
ended AS (
    SELECT w.c, min({'cost': w.cost + e.cost, 'audit': w.audit || e.audit, 'edits': w.edits || e.edits}) AS best
    FROM walk w JOIN ends e USING (y) WHERE w.k = (SELECT count(*) FROM faulty f WHERE f.c = w.c) GROUP BY w.c),
steps AS (
    SELECT c, edit, step, k, count(*) FILTER (edit IN ('K', 'D', 'U', 'A')) OVER (PARTITION BY c ORDER BY step) AS place
    FROM (SELECT c, unnest(string_split(best.edits, '')) AS edit, generate_subscripts(string_split(best.edits, ''), 1) AS step, 0 AS k FROM ended WHERE best.edits != '')),
kept AS (
    SELECT steps.c, sha256(string_agg(CASE edit WHEN 'K' THEN role || ':' || text WHEN 'U' THEN 'user:' || text WHEN 'A' THEN 'assistant:' || text
                                      WHEN 'u' THEN 'user:' ELSE 'assistant:' END, chr(10) ORDER BY step)) AS digest
    FROM steps LEFT JOIN faulty f ON f.c = steps.c AND f.k = steps.place WHERE edit != 'D' GROUP BY steps.c),
sums AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids JOIN ended USING (c) LEFT JOIN sums USING (c) LEFT JOIN kept USING (c)
"""
