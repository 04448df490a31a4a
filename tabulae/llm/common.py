"""Shared helpers: the shared scratch folder, lineage cuts and Arrow batch limits."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bound on rows in one Arrow batch sent to a Python worker; whole texts can be long.
BATCH_ROWS = 400


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    A folder of this machine is chosen only where the setting is missing and all executors are
    in this process, as in tests; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: in the cluster's folder, or one of our own without it."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a lost executor
    then costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with one call for each batch of at most ``rows`` rows."""
    limit_batches(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def limit_batches(spark: SparkSession, rows: int) -> None:
    """Lower the session's Arrow batch size to ``rows`` at most, so that whole long texts fit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``docs`` and no others, so that extra columns can't clash."""
    return docs.select(*[docs[n] for n in names])
