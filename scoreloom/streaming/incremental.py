"""Z-ops: incremental folds with Structured Streaming.

State lives in the state store (RocksDB provider, see ``STATE_CONF``), keyed by game and
viewer or by ledger, so a query restarts from its checkpoint after losing executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreloom.functions import exprs as E
from scoreloom.functions.canonical import canonical_text
from scoreloom.session import cut_lineage

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

LIVE_OUTPUT = (
    "game string, viewer int, sequence bigint, revision bigint, status string, support_size bigint, effective_size double, top_mass double, "
    "worlds array<bigint>, weights array<double>"
)
BELIEF_STATE = "sequence long, revision long, valid boolean, worlds array<bigint>, weights array<double>"


class LiveBelief(StatefulProcessor):
    """Z-01: posterior weights of one (game, viewer), packed into one state value: read once and written once a trigger.

    A row carries its sequence number, its revision pair and what its move does: ``sources``, ``targets`` and ``factors`` side by side (as
    ``tracking.packed_links`` gives them), and with a commitment ``evidence_worlds`` and ``evidence``, the factor of each
    world. Rows are taken in order of their sequence numbers: one that is due is folded at once, others of the trigger wait until they are due or
    the trigger ends. A revision gap invalidates the key until a ``reset`` row, whose ``targets`` and ``factors`` are worlds and weights.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.belief = handle.getValueState("belief", BELIEF_STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = next(initialState.itertuples())
        self.belief.update((int(row.sequence), int(row.revision), True, [int(w) for w in row.worlds], [float(w) for w in row.weights]))

    @staticmethod
    def _output(key, row, revision, status, worlds=(), weights=()):
        return (
            *key, int(row.sequence), revision, status, len(weights), 1.0 / sum(x * x for x in weights) if weights else None,
            max(weights) if weights else None, list(worlds), list(weights),
        )

    @staticmethod
    def _normalised(mass):
        """Worlds in order and weights that add up to 1, or None without mass."""
        total = sum(mass.values())
        if not total > 0:
            return None
        worlds = sorted(mass)
        return worlds, [mass[w] / total for w in worlds]

    @staticmethod
    def _list(values):
        # Plain lists: most moves have few links, and for those array calls cost more than the fold itself.
        return values if isinstance(values, list) else [] if values is None else np.asarray(values).tolist()

    @classmethod
    def _weights(cls, values):
        found = cls._list(values)
        return [float("nan") if x is None else x for x in found] if None in found else found

    @classmethod
    def _moved(cls, row, worlds, weights):
        """Worlds and normalised weights after a row, or None without mass."""
        if row.evidence_worlds is not None:
            told = dict(zip(cls._list(row.evidence_worlds), cls._weights(row.evidence), strict=True))
            weights = [x * told.get(w, 0.0) for w, x in zip(worlds, weights)]
        before, mass = dict(zip(worlds, weights)), {}
        for source, target, factor in zip(cls._list(row.sources), cls._list(row.targets), cls._weights(row.factors), strict=True):
            mass[target] = mass.get(target, 0.0) + before.get(source, 0.0) * factor
        return cls._normalised(mass)

    def _fold(self, key, row, state):
        _, revision, valid, worlds, weights = state or (None, None, False, [], [])
        sequence = int(row.sequence)
        if row.reset:
            mass: dict[int, float] = {}
            for world, weight in zip(self._list(row.targets), self._weights(row.factors), strict=True):
                mass[world] = mass.get(world, 0.0) + weight
            after, status = self._normalised(mass), "reset"
        elif not valid or int(row.before_revision) != revision:
            return self._output(key, row, revision, "invalid"), state and (sequence, revision, False, [], [])
        else:
            after, status = self._moved(row, worlds, weights), "updated"
        if after is None:
            return self._output(key, row, revision, "no_mass"), (sequence, revision, False, [], [])
        revision = int(row.after_revision)
        return self._output(key, row, revision, status, *after), (sequence, revision, True, *after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.belief.get()
        state = None if state is None else tuple(state)
        names = [f.split()[0] for f in LIVE_OUTPUT.split(", ")]
        early: dict[int, object] = {}
        out: list[tuple] = []
        for frame in rows:
            # Rows go out frame by frame, so that a hot key's output is never held whole; most keys give one frame.
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
            for row in sorted(frame.itertuples(index=False), key=lambda r: r.sequence):
                early[int(row.sequence)] = row
                while state is not None and state[0] + 1 in early or state is None and 0 in early:
                    done, state = self._fold(key, early.pop(0 if state is None else state[0] + 1), state)
                    out.append(done)
                    if state is None:
                        break
        for sequence in sorted(early):
            done, state = self._fold(key, early.pop(sequence), state)
            out.append(done)
        if out:
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            self.belief.update(state)

    def close(self) -> None:
        pass


def live_beliefs(transitions: DataFrame, start: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Z-01: one output row per transition of a stream, with the posterior after it: packed worlds and weights, by revision.

    ``start``: game, viewer, sequence, revision, worlds, weights to begin with (``batch_state`` makes it of a batch fold). With ``ttl_ms`` a
    belief that was not written for that long is forgotten; its next transition is invalid until a reset.
    """
    initial = None if start is None else start.select("game", "viewer", "sequence", "revision", "worlds", "weights").groupBy("game", "viewer")
    return transitions.groupBy("game", "viewer").transformWithStateInPandas(
        statefulProcessor=LiveBelief(ttl_ms), outputStructType=LIVE_OUTPUT, outputMode="append", timeMode="none" if ttl_ms is None else "processingTime",
        initialState=initial,
    )


def live_transitions(transitions: DataFrame, links: DataFrame, likelihoods: DataFrame | None = None, epsilon: float = 0.0) -> DataFrame:
    """Z-01 input from transitions (a stream or a table, as B-15 reads them), packed links of their moves, and packed likelihoods.

    The links are a static table, so the join keeps no state.
    """
    from scoreloom.operators import tracking as T

    d = T.with_move_id(transitions).join(links.select("move_id", "sources", "targets", "factors"), "move_id", "left")
    committed = F.col("commitment_kind").isNotNull() & (F.col("acting") != F.col("viewer"))
    if likelihoods is not None:
        share = lambda l, legal, match: F.when((legal > 0) & (match > 0), (1.0 - epsilon) * l + epsilon * match / legal).otherwise(0.0)
        mixed = F.transform(F.arrays_zip("l_likelihood", "l_legal", "l_matching"), lambda x: share(x["l_likelihood"], x["l_legal"], x["l_matching"]))
        told = likelihoods.select("game", "viewer", "sequence", F.col("l_world_index").alias("evidence_worlds"), mixed.alias("evidence"))
        d = d.join(told, ["game", "viewer", "sequence"], "left")
    else:
        d = d.withColumns({"evidence_worlds": F.lit(None).cast("array<bigint>"), "evidence": F.lit(None).cast("array<double>")})
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return d.select(
        F.col("game").cast("string").alias("game"), F.col("viewer").cast("int").alias("viewer"), F.col("sequence").cast("long").alias("sequence"),
        F.col("before_revision").cast("long").alias("before_revision"), F.col("after_revision").cast("long").alias("after_revision"), F.lit(False).alias("reset"),
        F.coalesce("sources", none("bigint")).alias("sources"), F.coalesce("targets", none("bigint")).alias("targets"), F.coalesce("factors", none("double")).alias("factors"),
        # A commitment without likelihoods leaves no mass; a row without one is not conditioned.
        F.when(committed, F.coalesce("evidence_worlds", none("bigint"))).alias("evidence_worlds"), F.when(committed, F.coalesce("evidence", none("double"))).alias("evidence"),
    )


def batch_state(state: DataFrame, heads: DataFrame) -> DataFrame:
    """The final beliefs of B-15 as a start for ``live_beliefs``; ``heads``: game, viewer, last sequence and revision."""
    packed = state.groupBy("space_id").agg(F.array_sort(F.collect_list(F.struct("world_index", F.exp("log_p").alias("p")))).alias("w"))
    sid = F.concat_ws("|", F.col("game").cast("string"), F.col("viewer").cast("string"))
    return heads.withColumn("space_id", sid).join(packed, "space_id").select(
        F.col("game").cast("string").alias("game"), F.col("viewer").cast("int").alias("viewer"), F.col("sequence").cast("long").alias("sequence"), F.col("revision").cast("long").alias("revision"),
        F.transform("w", lambda x: x["world_index"]).alias("worlds"), F.transform("w", lambda x: x["p"]).alias("weights"))


def posterior_at(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Posterior rows of the asked revisions: game, viewer, revision, available, world, weight.

    ``snapshots`` is the table that ``live_beliefs`` was written to, so earlier revisions can be asked for too; ``wanted``: game, viewer, revision.
    A revision that was never reached gives one row that is not available.
    """
    held = snapshots.filter(F.col("status").isin("updated", "reset")).select("game", "viewer", "revision", F.arrays_zip("worlds", "weights").alias("__w"))
    j = wanted.join(held, ["game", "viewer", "revision"], "left").withColumn("available", F.col("__w").isNotNull())
    return j.select("game", "viewer", "revision", "available", F.explode_outer("__w").alias("w")).select(
        "game", "viewer", "revision", "available", F.col("w.worlds").alias("world"), F.col("w.weights").alias("weight"))


LEDGER_OUTPUT = "ledger_id string, ordinal bigint, head string, violation string"


class _Held:
    """Events that wait inside one trigger; the calls are those of a map state."""

    def __init__(self):
        self.rows: dict[tuple, tuple] = {}
        self.containsKey, self.getValue, self.removeKey = self.rows.__contains__, self.rows.__getitem__, self.rows.pop
        self.updateValue, self.keys, self.clear = self.rows.__setitem__, self.rows.keys, self.rows.clear


class LedgerHead(StatefulProcessor):
    """Z-02: running head hash of one ledger.

    An event is out of order if the events of its trigger and of those before leave a gap in front of it, if it is at or before the head, and if it
    comes after a violation; it is not reordered then (inside a trigger rows have no order of their own). With ``wait_ms``, an event
    that comes early waits for the gap before it to close, until the watermark has passed its event time by that much: then
    the gap is a violation of the waiting events, their state is freed, and the ledger is broken. Rows are taken one at a time.
    """

    def __init__(self, wait_ms: int | None = None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "ordinal long, hash string, broken boolean")
        if self.wait_ms is not None:
            self.waiting = handle.getMapState("waiting", "ordinal long", "event string")

    def _problem(self, text: str | None, previous: str | None) -> tuple[str | None, str | None]:
        """(own hash, violation) of the event that follows ``previous``."""
        import hashlib

        try:
            event = json.loads(text)
            own = event.pop("event_sha256", None)
            if event.get("previous_event_sha256") != previous:
                return own, "chain_mismatch"
            if hashlib.sha256(canonical_text(event).encode()).hexdigest() != own:
                return own, "digest_mismatch"
        except (TypeError, ValueError, AttributeError):
            return None, "invalid_json"
        return own, None

    def _freed(self, key, previous, violation):
        """Outputs of all waiting events, which are forgotten."""
        late = [(key[0], ordinal, previous, violation) for ordinal in sorted(k[0] for k in self.waiting.keys())]
        self.waiting.clear()
        return late

    def _take(self, key, ordinal, text, due, state, out):
        """The state after one event; ``due``: when its waiting ends."""
        last, previous, broken = state
        early = ordinal > last + 1
        if not broken and early and not self.waiting.containsKey((ordinal,)):
            self.waiting.updateValue((ordinal,), (text,))
            if self.wait_ms is not None:
                self.handle.registerTimer(due)
            return state
        if broken or early or ordinal <= last:
            out.append((key[0], ordinal, previous, "out_of_order"))
            return state
        while True:
            own, problem = self._problem(text, previous)
            broken = problem is not None
            last, previous = (last, previous) if broken else (ordinal, own)
            out.append((key[0], ordinal, previous, problem))
            ordinal += 1
            if broken or not self.waiting.containsKey((ordinal,)):
                break
            text = self.waiting.getValue((ordinal,))[0]
            self.waiting.removeKey((ordinal,))
        if broken:
            out += self._freed(key, previous, "out_of_order")
        return last, previous, broken

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.head.get() if self.head.exists() else (-1, None, False)
        if self.wait_ms is None:
            self.waiting = _Held()
        for frame in rows:
            out: list[tuple] = []
            times = [0] * len(frame) if self.wait_ms is None else [int(x.timestamp() * 1000) + self.wait_ms for x in frame["ts"]]
            for ordinal, text, due in zip(frame["ordinal"].tolist(), frame["event"].tolist(), times):
                state = self._take(key, ordinal, text, due, state, out)
            yield pd.DataFrame(out, columns=["ledger_id", "ordinal", "head", "violation"])
        last, previous, broken = state
        if self.wait_ms is None:
            out = self._freed(key, previous, "out_of_order")
            broken = broken or bool(out)
            yield pd.DataFrame(out, columns=["ledger_id", "ordinal", "head", "violation"])
        self.head.update((last, previous, broken))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, previous, broken = self.head.get() if self.head.exists() else (-1, None, False)
        out = self._freed(key, previous, "gap_deadline")
        if out:
            self.head.update((last, previous, True))
        yield pd.DataFrame(out, columns=["ledger_id", "ordinal", "head", "violation"])

    def close(self) -> None:
        pass


def verify_ledger_stream(events: DataFrame, wait: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Z-02: every event with the head after it and its violation (NULL if it extends the chain).

    ``events``: ledger_id, ordinal, event. By default an event that comes before its turn is a violation. ``wait`` (such as
    ``10 minutes``) lets it wait so long for the events before it, in event time of the column ``ts``, which may be late by ``delay``.
    """
    if wait is None:
        return events.select("ledger_id", "ordinal", "event").groupBy("ledger_id").transformWithStateInPandas(
            statefulProcessor=LedgerHead(), outputStructType=LEDGER_OUTPUT, outputMode="append", timeMode="none"
        )
    timed = events.select("ledger_id", "ordinal", "event", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("ledger_id").transformWithStateInPandas(
        statefulProcessor=LedgerHead(int(pd.Timedelta(wait).total_seconds() * 1000)), outputStructType=LEDGER_OUTPUT, outputMode="append", timeMode="eventTime"
    )


def running_health(events: DataFrame, keys: Sequence[str], by: Sequence[str] = ("run", "update"), ts: str = "ts", delay: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Z-03: counters of truthy events per run and update, in update mode.

    Without ``window`` the state keeps one row per run and update for ever. With a ``window`` (such as ``1 hour``) counters are
    kept per event-time window too, in the column ``window``, and the watermark ``delay`` on ``ts`` drops closed ones.
    """
    if window is None:
        return events.groupBy(*by).agg(*[E.count_true(F.col(k)).alias(k) for k in keys])
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(*by, F.window(ts, window).alias("window")).agg(*[E.count_true(F.col(k)).alias(k) for k in keys])


def running_metrics(actions: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """Z-03: the evaluation metrics of a decision-log stream, kept current per evaluation."""
    from scoreloom.operators.aggregates import evaluation_metrics

    return evaluation_metrics(actions, by)


@dataclass(frozen=True)
class KeyedTable:
    """Z-03: a Parquet table with one row per key, kept by a stream in update mode.

    Rows lie in ``buckets`` directories by a hash of the key. A batch rewrites only the buckets that its keys fall into, by dynamic
    partition overwrite. Every row carries the number of the batch that wrote it, and an older batch never replaces a newer one's row, so
    that replaying a batch changes nothing.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(batch.withColumns({"batch": F.lit(number).cast("long"), "bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")}))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        every = fresh
        if self._exists(spark):
            every = spark.read.schema(fresh.schema).parquet(self.path).filter(F.col("bucket").isin(touched)).unionByName(fresh)
        rest = [c for c in fresh.columns if c not in (*self.keys, "batch", "bucket")]
        merged = every.groupBy(*self.keys, "bucket").agg(F.max(F.struct("batch", *rest)).alias("__new")).select(*self.keys, "__new.*", "bucket")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch", "bucket")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Runs ``stream`` in update mode into the table; its checkpoint numbers the batches."""
        return stream.writeStream.outputMode("update").trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(self.merge).start()

    def _exists(self, spark: SparkSession) -> bool:
        from pyspark.errors import AnalysisException

        try:
            spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True
