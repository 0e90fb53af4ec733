"""Session helpers: configuration that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "scoreloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python path, once per application.

    Not needed where the package is installed on all machines or was passed with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_scoreloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="scoreloom-src-"), "scoreloom-src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)
    context._scoreloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative result.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only when no
    folder is known (tests, local mode) a fresh local one is created.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="scoreloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
