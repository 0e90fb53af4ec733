"""U-01: batch scoring hook. A user function turns observation arrays into logits and values."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, scorer: Callable[[pa.RecordBatch], dict[str, pa.Array]], outputs: str) -> DataFrame:
    """Append the scorer's output columns (schema text ``outputs``) to every row.

    The scorer sees Arrow batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows and
    returns one array per output column. Heavy state (a model) should be created lazily
    inside it, once per worker.
    """
    names = [part.split()[0] for part in outputs.split(", ")]

    def run(batches):
        for batch in batches:
            got = scorer(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[got[n] for n in names]], names=[*batch.schema.names, *names])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{base}, {outputs}")
