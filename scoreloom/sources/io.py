"""S-ops: reading and writing match rows, traces, shards, the run store, spans and receipts."""

from __future__ import annotations

import hashlib
import io
import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import exprs as E
from scoreloom.functions.canonical import canonical_json
from scoreloom.operators.sequences import run_phases, violation
from scoreloom.session import cut_lineage

LATENCY = "map<string,struct<count:bigint,seconds:double,p50:double,p95:double>>"
MATCH_SCHEMA = (
    "cell_id string, deal_seed bigint, deal_block bigint, leg int, player_a string, player_b string, player_a_seat int, "
    "winner int, score_a double, truncated boolean, termination_reason string, terminal boolean, decisions int, "
    "game_seconds double, replay_passed boolean, match_id string, game_trace_sha256 string, trace_path string, "
    f"replay_trace_sha256 string, integrity map<string,bigint>, latency {LATENCY}"
)
DECISION = (
    "struct<revision:bigint,actor:int,prompt_id:bigint,offer_id:bigint,frame_sha256:string,command_sha256:string,"
    "pre_state_sha256:string,post_state_sha256:string,latency_seconds:double>"
)
TRACE_SCHEMA = (
    f"match_id string, deal_seed bigint, leg int, game_trace_sha256 string, winner int, decisions array<{DECISION}>"
)
TRACE_DOCUMENT_SCHEMA = (
    "timestamp string, winner int, end_reason string, events array<struct<actor:string,action:int,auto:boolean>>, _corrupt_record string"
)

# Metrics compared between baseline and final evaluation, with display labels.
REPORT_METRICS = {
    "win_rate": "Win rate",
    "win_ci_lower": "Win CI lower",
    "landed_when_able": "Landed when able",
    "cast_when_able": "Cast when able",
    "passed_when_able": "Passed when able",
    "pass_land_pass_rate": "Pass+land: pass rate",
    "pass_land_land_rate": "Pass+land: land rate",
    "mean_pass_prob_when_pass_land": "Mean pass prob in pass+land",
    "mean_land_prob_when_pass_land": "Mean land prob in pass+land",
}
RUN_CONFIG_FIELDS = ("experiment", "train", "reward", "agent", "match", "observation")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir`` (local only without one)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="scoreloom-scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ matches and traces


def read_matches(spark: SparkSession, path: str | Sequence[str], schema: str = MATCH_SCHEMA) -> DataFrame:
    """S-01: JSON lines of match rows; blank lines are skipped, anything but an object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_traces(spark: SparkSession, path: str | Sequence[str], schema: str = TRACE_SCHEMA) -> DataFrame:
    """S-02: gzip JSON lines (one game each) to one row per decision with its ordinal.

    A gzip file is one task, so game logs should be written as many files (``write_traces`` does).
    """
    games = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    head = [c for c in games.columns if c != "decisions"]
    return games.select(*head, F.posexplode("decisions").alias("ordinal", "d")).select(*head, "ordinal", "d.*")


def write_traces(games: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S-03: one canonical JSON line per game, gzip text."""
    text = F.to_json(F.struct(*games.columns), {"ignoreNullFields": "false"})
    games.select(canonical_json(text).alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def trace_summaries(spark: SparkSession, path: str) -> DataFrame:
    """S-07: summaries of play-trace documents, newest first; unreadable files are skipped."""
    docs = (
        spark.read.schema(TRACE_DOCUMENT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(path)
    )
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return (
        docs.select("*", name.alias("id")).filter(F.col("_corrupt_record").isNull())
        .select("id", "timestamp", "winner", "end_reason", F.coalesce(F.size("events"), F.lit(0)).alias("num_events"))
        .orderBy(F.coalesce("timestamp", F.lit("")).desc())
    )


def filename_timestamp(ts: Column | str) -> Column:
    """ISO timestamp in the form used in trace file names."""
    c = F.regexp_replace(E.col(ts), r"\+00:00", "Z")
    return F.regexp_replace(F.regexp_replace(c, "[-:]", ""), r"\.", "_")


# ------------------------------------------------------------------ shards

OPTIONAL_COLUMNS = ("scores", "visit_counts", "root_value")


def _shard_name(path: str) -> Column:
    """The shard of a file: its own name, or its folder's if it is a part file, without the ending ``.parquet``.

    Cut at slashes from the end, as it is computed for every row and a pattern would try every start in the path.
    """
    last = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(last.startswith("part-") & (folder != ""), folder).otherwise(last)
    ending = len(".parquet")
    return F.when(name.endswith(".parquet") & (F.length(name) > ending), F.left(name, F.length(name) - ending)).otherwise(name)


def load_shards(spark: SparkSession, paths: Sequence[str], rounds: Sequence[int] | None = None,
                provenance: DataFrame | None = None) -> DataFrame:
    """S-04: union of Parquet shards; an optional column stays only if every shard has it.

    ``round`` comes from ``rounds`` (one per path), else from ``provenance`` (shard, round), else -1.
    Only file footers are inspected on the driver, several at a time; shards of equal schema are read together. A winner
    of -1 becomes NULL.
    """
    with ThreadPoolExecutor(16) as pool:
        columns = dict(zip(paths, pool.map(lambda p: spark.read.parquet(p).columns, paths)))
    common = set.intersection(*[set(c) for c in columns.values()])
    lost = {c for cols in columns.values() for c in cols} - common - set(OPTIONAL_COLUMNS)
    if lost:
        raise ValueError(f"required columns missing in some shards: {sorted(lost)}")
    keep = [c for c in columns[paths[0]] if c in common]
    groups: dict[tuple[str, ...], list[str]] = {}
    for p, cols in columns.items():
        groups.setdefault(tuple(cols), []).append(p)
    out = None
    for members in groups.values():
        part = spark.read.parquet(*members).select(*keep, F.col("_metadata.file_path").alias("__file"))
        out = part if out is None else out.unionByName(part)
    if "winner" in keep:
        out = out.withColumn("winner", F.when(F.col("winner") >= 0, F.col("winner")))
    out = out.withColumn("shard", _shard_name("__file")).drop("__file")
    if rounds is not None:
        names = [p.rstrip("/").split("/")[-1].removesuffix(".parquet") for p in paths]
        provenance = spark.createDataFrame(list(zip(names, map(int, rounds))), "shard string, round int")
    if provenance is None:
        return out.withColumn("round", F.lit(-1))
    # A row per shard, whose paths the driver lists anyway: the shards' own rows stay where they are read.
    r = F.broadcast(provenance.select("shard", F.col("round").alias("__round")))
    return out.join(r, "shard", "left").withColumn("round", F.coalesce("__round", F.lit(-1))).drop("__round")


NPZ_SCHEMA = (
    "shard string, ordinal int, game_index bigint, seat int, action int, num_valid int, winner int, "
    "actions_valid array<float>, scores array<float>, visit_counts array<float>, root_value float, provenance string, "
    "tensors map<string,array<float>>"
)


def read_npz_shards(spark: SparkSession, path: str) -> DataFrame:
    """S-04 for NumPy archives: one row per decision, one file per task; -1 winners become NULL.

    Every other array with one entry per decision (observation tensors, condition columns) comes in ``tensors``, by its name,
    flattened per decision.
    """

    def decode(batches):
        scalars = ("game_index", "seat", "action", "num_valid", "winner")
        named = {*scalars, "actions_valid", "scores", "visit_counts", "root_value", "provenance"}
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                n = len(z["action"])
                out = pd.DataFrame({"shard": [name] * n, "ordinal": np.arange(n, dtype=np.int32)})
                for c in scalars:
                    out[c] = z[c].astype(np.int64)
                out["winner"] = out["winner"].where(out["winner"] >= 0, None).astype("Int64")
                for c in ("actions_valid", "scores", "visit_counts"):
                    out[c] = list(z[c].astype(np.float32)) if c in z else [None] * n
                out["root_value"] = z["root_value"].astype(np.float32) if "root_value" in z else np.full(n, np.nan, np.float32)
                out["provenance"] = str(z["provenance"]) if "provenance" in z else None
                rest = {k: z[k] for k in z.files if k not in named}
                rest = {k: v.reshape(n, -1).astype(np.float32) for k, v in rest.items() if v.ndim and len(v) == n and v.dtype.kind in "biuf"}
                out["tensors"] = [{k: v[i] for k, v in rest.items()} for i in range(n)]
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(decode, NPZ_SCHEMA)


def conditional_violations(provenance: DataFrame, schema_digest: str) -> DataFrame:
    """S-06: shards whose schema digest or target kinds are not the pinned ones."""
    rules = [
        F.when(~F.col("condition_schema_digest").eqNullSafe(F.lit(schema_digest)), F.lit("schema_digest")),
        F.when(~F.col("policy_target_kind").eqNullSafe(F.lit("score_softmax")), F.lit("policy_target_kind")),
        F.when(~F.col("value_target_kind").eqNullSafe(F.lit("terminal_outcome")), F.lit("value_target_kind")),
    ]
    return provenance.select(
        F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("shard").cast("string").alias("key"), F.lit("").alias("detail")
    )


def load_conditional(spark: SparkSession, paths: Sequence[str], provenance: DataFrame, schema_digest: str) -> tuple[DataFrame, DataFrame]:
    """S-06: (rows of conditional shards, provenance violations)."""
    return load_shards(spark, paths, provenance=provenance), conditional_violations(provenance, schema_digest)


def _digests(chunk: int):
    """SHA-256 of the files of a listing, read ``chunk`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                scheme, _, rest = path.partition(":")
                store, name = (fs.LocalFileSystem(), rest) if scheme == "file" else fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name, buffer_size=0) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], ["path", "length", "sha256"])

    return run


def file_receipts(spark: SparkSession, root: str, pattern: str = "*", chunk: int = 1 << 22) -> DataFrame:
    """S-12: relative path, bytes and SHA-256 of every file under ``root``.

    Spark lists the files (their contents are not part of its rows); tasks read them ``chunk`` bytes at a time, so a file
    may have any size; Spark's listing leaves out empty ones. Files are read by Arrow's file systems (local, HDFS, object stores).
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    )
    base = "/" + root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    spread = files.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(_digests(chunk), "path string, length long, sha256 string").select(
        F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"), "sha256"
    )


# ------------------------------------------------------------------ run store


def null_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, as the store keeps them."""
    return df.withColumns(
        {c: F.when(E.finite(c), F.col(c)) for c, d in df.dtypes if d in ("double", "float")}
    )


# Partitions of each table of the store.
STORE_BUCKETS = 256
# Fixed: what identifies a row of each table of the store.
STORE_KEYS = {
    "runs": ("run_id",), "run_configs": ("run_id",), "evaluations": ("run_id", "id"), "evaluation_choice_sets": ("run_id", "evaluation_id", "scope", "choice_set"),
    "evaluation_actions": ("run_id", "id"), "reports": ("run_id", "id"), "run_status": ("run_id", "seq"),
}


def append_table(df: DataFrame, root: str, table: str) -> DataFrame:
    """Add rows to one table of the store, by their keys; returns the key clashes (rule, key, detail).

    Rows lie in ``STORE_BUCKETS`` partitions by a hash of their run, in order of runs, so that files do not become as many as runs. Only the
    partitions that are added to are read and, by dynamic partition overwrite, written. A row that is there already changes nothing, so
    a repeated append leaves one copy. A row whose key is there with other values clashes: the stored one stays.
    """
    spark, keys = df.sparkSession, list(STORE_KEYS[table])
    path = f"{root}/{table}"
    bucket = F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(STORE_BUCKETS)).cast("int")
    fresh = cut_lineage(null_non_finite(df).withColumns({"__new": F.lit(True), "store_bucket": bucket}))
    rows = fresh
    if _has_files(spark, path):
        held = spark.read.parquet(path).withColumn("__new", F.lit(False))
        rows = held.join(F.broadcast(fresh.select("store_bucket").distinct()), "store_bucket", "left_semi").unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "__new", "store_bucket")]
    text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    merged = cut_lineage(
        rows.withColumn("__text", text).groupBy(*keys, "store_bucket").agg(F.min(F.struct("__new", "__text", *rest)).alias("__r"), F.min("__text").alias("__lo"), F.max("__text").alias("__hi"))
    )
    stored = merged.select(*keys, "store_bucket", *(F.col(f"__r.{c}").alias(c) for c in rest))
    # A rebalanced hot run is split, and one bucket is written by few tasks.
    stored.hint("rebalance", "store_bucket").sortWithinPartitions("store_bucket", "run_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("store_bucket").parquet(path)
    return merged.filter("__lo <> __hi").select(
        F.lit("key_clash").alias("rule"), F.concat_ws("/", F.lit(table), *[F.col(k).cast("string") for k in keys]).alias("key"), F.lit("").alias("detail"))


def _has_files(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def append_run(runs: DataFrame, configs: DataFrame, root: str) -> DataFrame:
    """S-08: new runs (ids chosen by the caller) with their six configuration documents; the key clashes."""
    return append_table(runs, root, "runs").unionByName(append_table(configs, root, "run_configs"))


def append_evaluation(evaluations: DataFrame, choice_sets: DataFrame, actions: DataFrame | None, root: str) -> DataFrame:
    """S-08: evaluations, their choice-set counts and, if kept, their actions; the key clashes. All carry run_id."""
    clashes = append_table(evaluations, root, "evaluations").unionByName(append_table(choice_sets, root, "evaluation_choice_sets"))
    return clashes if actions is None else clashes.unionByName(append_table(actions, root, "evaluation_actions"))


def append_report(reports: DataFrame, root: str) -> DataFrame:
    return append_table(reports, root, "reports")


def append_status(events: DataFrame, root: str) -> DataFrame:
    return append_table(events, root, "run_status")


def read_store(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}").drop("store_bucket")


def latest_run_status(events: DataFrame) -> DataFrame:
    """S-09: newest status per run and the newest note that is not NULL."""
    return events.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("seq"))).alias("notes"),
    )


def get_evaluations(evaluations: DataFrame, run_id) -> DataFrame:
    """S-10: evaluations of a run by (step, id)."""
    return evaluations.filter(F.col("run_id") == run_id).orderBy("step", "id")


def get_actions(actions: DataFrame, evaluation_id) -> DataFrame:
    """S-10: actions of an evaluation by (game, step, id)."""
    return actions.filter(F.col("evaluation_id") == evaluation_id).orderBy("game_index", "step", "id")


def get_choice_sets(choice_sets: DataFrame) -> DataFrame:
    """S-10: one map choice set -> count per evaluation and scope (as many entries as choice sets exist)."""
    return choice_sets.groupBy("evaluation_id", "scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("choice_set", F.col("count").cast("double"))))).alias("counts")
    )


def get_run_configs(configs: DataFrame, run_id, schemas: dict[str, str] | None = None) -> DataFrame:
    """S-10: parsed configuration documents; fields without a schema become VARIANT."""
    schemas = schemas or {}
    row = configs.filter(F.col("run_id") == run_id)
    return row.select(
        "run_id",
        *[
            (F.from_json(f"{f}_json", schemas[f]) if f in schemas else F.parse_json(f"{f}_json")).alias(f)
            for f in RUN_CONFIG_FIELDS
        ],
    )


def get_reports(reports: DataFrame, run_id) -> DataFrame:
    return reports.filter(F.col("run_id") == run_id).orderBy("id")


# ------------------------------------------------------------------ spans, configs, reports


def parse_spans(df: DataFrame, stat: str = "stat") -> DataFrame:
    """S-11: ``total=..s, count=..`` texts to numbers; unparsable lines are dropped."""
    total = F.regexp_extract(stat, r"total=([0-9.e+-]+)s", 1).try_cast("double")
    count = F.regexp_extract(stat, r"count=(\d+)", 1).try_cast("bigint")
    return df.withColumns({"total_time": total, "count": count}).filter(
        F.col("total_time").isNotNull() & F.col("count").isNotNull()
    )


def parse_span_baseline(lines: DataFrame, text: str = "value") -> DataFrame:
    """S-11: tab-separated baseline lines (path, total, count); the last line of a path wins
    only if ``ordinal`` is present, otherwise lines are kept as they are."""
    parts = F.split(text, "\t")
    out = lines.select(
        *[c for c in lines.columns if c != text],
        F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).try_cast("double").alias("total_time"),
        F.get(parts, F.lit(2)).try_cast("bigint").alias("count"),
        (F.trim(F.col(text)) == "").alias("__blank"),
    )
    ok = out.filter(~F.col("__blank") & F.col("total_time").isNotNull() & (F.col("count") >= 0)).drop("__blank")
    if "ordinal" not in ok.columns:
        return ok
    return ok.groupBy("path").agg(F.max_by("total_time", "ordinal").alias("total_time"), F.max_by("count", "ordinal").alias("count"))


def _flatten(value, prefix: str, out: list[tuple[str, str]], sep: str) -> None:
    for key, child in value.items():
        path = f"{prefix}{sep}{key}" if prefix else str(key)
        if isinstance(child, dict):
            _flatten(child, path, out, sep)
        else:
            out.append((path, child if isinstance(child, str) else json.dumps(child)))


def flatten_config(df: DataFrame, key: str = "run_id", document: str = "document", sep: str = "/") -> DataFrame:
    """S-14: nested configuration documents to rows (key, path, value); lists stay values.

    A document that is no JSON object gives one row with the path ``invalid_document`` and no value.
    """

    def run(batches):
        for pdf in batches:
            keys, paths, values = [], [], []
            for k, text in zip(pdf[key], pdf[document]):
                rows: list[tuple[str, str]] = []
                try:
                    _flatten(json.loads(text), "", rows, sep)
                except (ValueError, TypeError, AttributeError):
                    rows = [("invalid_document", None)]
                keys += [k] * len(rows)
                paths += [p for p, _ in rows]
                values += [v for _, v in rows]
            yield pd.DataFrame({key: keys, "path": paths, "value": values})

    return df.select(key, document).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, path string, value string")


def percent(value: Column, signed: bool = False) -> Column:
    """One-decimal percent text, 'n/a' for NULL."""
    fmt = "%+.1f%%" if signed else "%.1f%%"
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string(fmt, value * 100))


def report_rows(evals: DataFrame, metrics: dict[str, str] | None = None) -> DataFrame:
    """S-13: per run and metric the baseline, final and delta values with their display texts."""
    metrics = metrics or REPORT_METRICS
    phases = run_phases(evals)
    names = list(metrics)
    values = F.create_map(*[x for m in names for x in (F.lit(m), E.dbl(m))])
    e = evals.select(F.col("id").alias("__id"), F.col("run_id").alias("__run"), values.alias("m"))

    def side(col: str, name: str) -> DataFrame:
        # Keep the run in the join key: evaluation ids need only be unique within a run.
        return phases.select("run_id", F.col(col).alias("__id")).join(
            e.withColumnRenamed("__run", "run_id"), ["run_id", "__id"]
        ).select("run_id", F.col("m").alias(name))

    j = phases.select("run_id").join(side("baseline_id", "b"), "run_id", "left").join(side("final_id", "f"), "run_id", "left")
    labels = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(metrics[m]))])
    rows = j.select("run_id", "b", "f", F.explode(F.array(*[F.lit(m) for m in names])).alias("metric"))
    b, f = F.try_element_at("b", F.col("metric")), F.try_element_at("f", F.col("metric"))
    return rows.select(
        "run_id", "metric", F.element_at(labels, F.col("metric")).alias("label"), b.alias("baseline"), f.alias("final"),
        (f - b).alias("delta"), percent(b).alias("baseline_text"), percent(f).alias("final_text"), percent(f - b, True).alias("delta_text"),
    )


def digest_violations(df: DataFrame, column: str, key: str) -> DataFrame:
    """Digests must be 64 lowercase hexadecimal digits."""
    return df.filter(~F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False))).select(*violation("invalid_digest", F.col(key), F.col(column)))


