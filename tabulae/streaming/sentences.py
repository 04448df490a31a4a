"""Streams: sentences of arriving documents, and windowed word counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE_END = "(?<=[.;·!?])\\s+"


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence, text), the same for a batch and a stream; no state is kept, so a retry
    repeats rows: a sink keyed by (doc_id, sentence) makes them exactly-once."""
    parts = F.filter(F.split("text", SENTENCE_END), lambda x: F.trim(x) != "")
    return documents.select("doc_id", F.posexplode(parts).alias("sentence", "text")).withColumn("sentence", F.col("sentence").cast("long"))


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_counts(events: DataFrame, time: str, item: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each item in tumbling windows; state is dropped once the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), item, "n")


def upsert_batches(path: str, keys: list[str]):
    """A ``foreachBatch`` sink that writes each batch once under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
