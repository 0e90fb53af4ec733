import hashlib
import math
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.canonical import canonical_text
from scoreloom.operators import tracking as T
from scoreloom.operators import worlds as B
from scoreloom.streaming import incremental as Z


def chain(n):
    previous, out = None, []
    for k in range(n):
        event = {"n": k, "previous_event_sha256": previous}
        previous = hashlib.sha256(canonical_text(event).encode()).hexdigest()
        out.append(canonical_text({**event, "event_sha256": previous}))
    return out


class Source:
    """A folder that a stream reads one file a trigger from."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        os.makedirs(folder / "in")

    def add(self, rows):
        part = self.folder / f"part{self.n}"
        rows = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        rows.coalesce(1).write.parquet(str(part))
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(part / name, self.folder / "in" / f"{self.n}.parquet")
        os.utime(self.folder / "in" / f"{self.n}.parquet", (1_000_000 + self.n, 1_000_000 + self.n))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))

    def run(self, result, until=None):
        """All that is there so far, going on from the last run's checkpoint; what was put out up to now.

        A query with timers always has another batch to run, so ``until`` tells by the output when it may be stopped.
        """
        out = str(self.folder / "out")
        writer = result.writeStream.outputMode("append").option("checkpointLocation", str(self.folder / "state")).format("parquet").option("path", out)
        query = (writer.trigger(availableNow=True) if until is None else writer.trigger(processingTime="200 milliseconds")).start()
        if until is None:
            query.awaitTermination()
            return self.spark.read.parquet(out)
        schema = result.schema
        limit = time.time() + 60
        while query.isActive and time.time() < limit and not (os.path.isdir(out) and until(self.spark.read.schema(schema).parquet(out))):
            time.sleep(0.5)
        query.stop()
        return self.spark.read.schema(schema).parquet(out)


def ledger(spark, tmp_path, triggers, **options):
    """Violations by ordinal of events that come in the given triggers as (ordinal, event, second)."""
    source = Source(spark, tmp_path, "ledger_id string, ordinal long, event string, ts timestamp")
    for rows in triggers:
        source.add(spark.createDataFrame([("l" if e is not None else "other", o, e or "x", s) for o, e, s in rows], "ledger_id string, ordinal long, event string, s long")
                   .select("ledger_id", "ordinal", "event", F.timestamp_seconds("s").alias("ts")))
    stream = Z.verify_ledger_stream(source.stream(), **options)
    expected = sum(e is not None for rows in triggers for _, e, _ in rows)
    out = source.run(stream, (lambda d: d.filter("ledger_id = 'l'").count() >= expected) if options else None)
    return {r.ordinal: r.violation for r in out.filter("ledger_id = 'l'").collect()}


@pytest.mark.parametrize("cuts", [[[0, 1, 2, 3]], [[0, 2], [3], [1]], [[3, 2, 1], [0]]])
def test_waiting_makes_triggers_irrelevant(spark, tmp_path, cuts):
    events = chain(4)
    assert ledger(spark, tmp_path, [[(k, events[k], 10 * n + 5) for k in cut] for n, cut in enumerate(cuts)], wait="1 hour") == {k: None for k in range(4)}


@pytest.mark.parametrize("cuts,bad", [([[3, 1, 0, 2]], set()), ([[0], [1, 2], [3]], set()), ([[0, 2], [3], [1]], {1, 2, 3}), ([[1], [0], [2, 3]], {0, 1, 2, 3})])
def test_an_early_event_is_a_violation(spark, tmp_path, cuts, bad):
    events = chain(4)
    want = {k: "out_of_order" if k in bad else None for k in range(4)}
    assert ledger(spark, tmp_path, [[(k, events[k], 5) for k in cut] for cut in cuts]) == want


def test_everything_after_a_violation_is_out_of_order(spark, tmp_path):
    events = chain(4)
    cuts = [[(0, events[0], 1), (3, events[3], 1)], [(1, events[1].replace('"n":1', '"n":7'), 2)], [(2, events[2], 3)]]
    assert ledger(spark, tmp_path, cuts, wait="1 hour") == {0: None, 1: "digest_mismatch", 2: "out_of_order", 3: "out_of_order"}


def test_a_gap_is_reported_at_its_deadline(spark, tmp_path):
    events = chain(4)
    cuts = [[(0, events[0], 10), (2, events[2], 20)], [(0, None, 5000)], [(9, None, 5001)], [(1, events[1], 6000)]]
    got = ledger(spark, tmp_path, cuts, wait="60 seconds")
    assert got == {0: None, 2: "gap_deadline", 1: "out_of_order"}


LIVE = (
    "game string, viewer int, sequence bigint, before_revision bigint, after_revision bigint, reset boolean, sources array<bigint>, targets array<bigint>, factors array<double>, "
    "evidence_worlds array<bigint>, evidence array<double>"
)


def move(sequence, before, after, links, reset=False, evidence=None):
    s, t, f = zip(*links) if links else ((), (), ())
    return ("g", 0, sequence, before, after, reset, list(s), list(t), [float(x) for x in f], None if evidence is None else list(evidence), None if evidence is None else [float(x) for x in evidence.values()])


def test_restart_and_late_lookup(spark, tmp_path):
    source = Source(spark, tmp_path, LIVE)
    source.add([move(1, 1, 2, [(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)]), move(0, 0, 1, [(0, 0, 1.0), (1, 1, 3.0)], reset=True)])
    source.run(Z.live_beliefs(source.stream()))
    source.add([move(2, 2, 3, [(0, 0, 1.0), (1, 1, 1.0)], evidence={0: 1.0, 1: 0.0})])
    source.add([move(3, 9, 10, [(0, 0, 1.0)]), move(4, 10, 11, [(0, 0, 1.0)])])
    out = source.run(Z.live_beliefs(source.stream()))
    rows = {r.sequence: r for r in out.collect()}
    assert [(rows[k].status, rows[k].revision) for k in range(5)] == [("reset", 1), ("updated", 2), ("updated", 3), ("invalid", 3), ("invalid", 3)]
    wanted = spark.createDataFrame([("g", 0, r) for r in (1, 2, 3, 10)], "game string, viewer int, revision bigint")
    found = {}
    for r in Z.posterior_at(out, wanted).collect():
        if r.available:
            found.setdefault(r.revision, {})[r.world] = r.weight
    assert found == {1: {0: 0.25, 1: 0.75}, 2: {0: pytest.approx(0.125), 1: pytest.approx(0.875)}, 3: {0: 1.0, 1: 0.0}}
    assert [r.revision for r in Z.posterior_at(out, wanted).filter("not available").collect()] == [10]


def test_a_key_of_few_rows_costs_two_state_calls_and_one_frame():
    """The rest is lists: frames, empty ones too, and calls to the store are what most keys' time went to."""
    calls, held = [], []

    class Store:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def exists(self):
            calls.append("exists")
            return bool(held)

        def update(self, value):
            calls.append("update")
            held.append(value)

    live = Z.LiveBelief()
    live.belief = Store()
    names = [f.split()[0] for f in LIVE.split(", ")]
    rows = [move(0, 0, 1, [(0, 1, 1.0), (1, 0, 2.0), (1, 0, 1.0)], reset=True), move(1, 1, 2, [(0, 0, 1.0), (1, 1, 1.0)], evidence={1: 1.0, 0: 1.0}),
            move(2, 2, 3, [(0, 0, 1.0)]), move(4, 4, 5, [(0, 0, 1.0)])]
    # A missing weight of evidence leaves no mass, as it did on arrays.
    rows[1] = (*rows[1][:-1], [1.0, None])
    frames = list(live.handleInputRows(("g", 0), iter([pd.DataFrame(list(reversed(rows)), columns=names)]), None))
    assert [len(f) for f in frames] == [4]
    assert frames[0]["status"].tolist() == ["reset", "no_mass", "invalid", "invalid"]
    assert (frames[0]["worlds"][0], frames[0]["weights"][0]) == ([0, 1], [0.75, 0.25])
    assert calls == ["get", "update"]
    assert held[-1] == (4, 1, False, [], [])


def test_a_belief_expires(spark, tmp_path):
    source = Source(spark, tmp_path, LIVE)
    source.add([move(0, 0, 1, [(0, 0, 1.0)], reset=True)])
    source.run(Z.live_beliefs(source.stream(), ttl_ms=500), lambda d: d.count() == 1)
    time.sleep(1.5)
    source.add([move(1, 1, 2, [(0, 0, 1.0)])])
    got = {r.sequence: r.status for r in source.run(Z.live_beliefs(source.stream(), ttl_ms=500), lambda d: d.count() == 2).collect()}
    assert got == {0: "reset", 1: "invalid"}


def test_live_goes_on_from_the_batch_fold(spark, tmp_path):
    """Two moves folded in batch, two more live from there: the same belief as four moves in batch."""
    pool = {"a": 2, "b": 3, "c": 2}
    spaces = spark.createDataFrame([("s3", pool, 3), ("s4", pool, 4)], "space_id string, pool map<string,int>, hand_size int")
    worlds = B.enumerate_worlds(spaces)
    cols = "game string, viewer int, sequence bigint, before_revision bigint, after_revision bigint, before_space string, after_space string, acting int, commitment_kind string, exits array<string>, returns array<string>, hidden_draws int"
    rows = [("g", 0, 0, 1, 2, "s3", "s3", 1, "cast", [], [], 0), ("g", 0, 1, 2, 3, "s3", "s4", 1, None, [], [], 1),
            ("g", 0, 2, 3, 4, "s4", "s4", 1, "cast", [], [], 0), ("g", 0, 3, 4, 5, "s4", "s4", 0, "cast", [], [], 0)]
    moves = spark.createDataFrame(rows, cols)
    starts = spark.createDataFrame([("g", 0, 1, "s3")], "game string, viewer int, revision bigint, space_id string")
    lik = worlds.select(F.lit("g").alias("game"), F.lit(0).alias("viewer"), F.explode(F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("sequence"), "space_id", "world_index",
                        ((F.col("world_index") % 5 + 1) / 10.0).alias("likelihood"), F.lit(4).alias("legal"), (F.col("world_index") % 3).cast("int").alias("matching"))
    lik = lik.filter("(sequence = 0) = (space_id = 's3')").drop("space_id")
    whole = T.track(moves, starts, spaces, worlds, lik, 0.1)[1]
    half = T.track(moves.filter("sequence < 2"), starts, spaces, worlds, lik.filter("sequence < 2"), 0.1)[1]
    heads = spark.createDataFrame([("g", 0, 1, 3)], "game string, viewer int, sequence bigint, revision bigint")
    links = T.packed_links(T.transition_links(T.moves(moves), spaces, worlds))
    source = Source(spark, tmp_path, moves.schema)
    for k in (2, 3):
        source.add(moves.filter(f"sequence = {k}"))
    live = Z.live_transitions(source.stream(), links, T.packed_likelihoods(lik), 0.1)
    out = source.run(Z.live_beliefs(live, Z.batch_state(half, heads)))
    last = out.filter("revision = 5").first()
    assert last.status == "updated"
    want = {r.world_index: math.exp(r.log_p) for r in whole.collect()}
    assert dict(zip(last.worlds, last.weights)) == pytest.approx(want)


def test_keyed_table(spark, tmp_path):
    table = Z.KeyedTable(str(tmp_path / "t"), ("run",), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "run long, n long")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}
    table.merge(frame([(k, k) for k in range(40)]), 0)
    before = files()
    table.merge(frame([(7, 70)]), 1)
    assert len(before & files()) == 3  # the other buckets were left alone
    once = sorted(map(tuple, table.read(spark).collect()))
    table.merge(frame([(7, 70)]), 1)  # replayed
    table.merge(frame([(7, 7)]), 0)  # an older batch
    assert sorted(map(tuple, table.read(spark).collect())) == once == sorted([(k, k) for k in range(40) if k != 7] + [(7, 70)])
    table.merge(frame([]), 2)
    assert table.read(spark).count() == 40


def test_running_health_in_update_mode(spark, tmp_path):
    source = Source(spark, tmp_path, "run long, bad boolean, ts timestamp")
    row = lambda run, bad: spark.createDataFrame([(run, bad)], "run long, bad boolean").withColumn("ts", F.current_timestamp())
    table = Z.KeyedTable(str(tmp_path / "t"), ("run",), buckets=4)
    for rows in ([(1, True), (2, False)], [(1, True)], [(3, True)]):
        for r in rows:
            source.add(row(*r))
        table.start(Z.running_health(source.stream(), ["bad"], ["run"]), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert {(r.run, r.bad) for r in table.read(spark).collect()} == {(1, 2), (2, 0), (3, 1)}
