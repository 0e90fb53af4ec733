"""Reading the given tables, and writing intermediate results where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="scoreloom-llm-")
    return _LOCAL[context.applicationId]


def row_key(key: str = "__key", no_id: str = "__no_id") -> list[Column]:
    """Two columns without nulls that tell rows (doc_id, text) apart for joins: the id, or where there is none a digest of the text."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.xxhash64(F.col("text").cast("string"))).alias(key), doc_id.isNull().alias(no_id)]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage, so that lost executors never repeat what lies before, lets several readers
    prune columns, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scoreloom-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
