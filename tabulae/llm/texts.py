"""Documents addressed by their place in Parquet files.

A document's ``loc`` is the number of its file and of its row there, so rows are told apart
exactly, whatever their ids and texts, and a task that needs some texts opens the files and
reads the row groups that hold them: texts are never shuffled. A table that is read from
Parquet as it stands is used where it lies; anything else is written to the shared folder.
Only the list of files, which the driver has anyway, is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.llm.common import BATCH_ROWS, limit_batches, scratch

ROW_BITS = 36
LAST = (1 << 63) - 1


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a path as Spark writes it, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_parquet(path: str) -> pq.ParquetFile:
    fs, inner = filesystem(path)
    return pq.ParquetFile(fs.open_input_file(inner), pre_buffer=False)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is Parquet files, filtered at most, with its columns as they stand."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Filter":
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.simpleString(5).startswith("Relation") and plan.simpleString(200).rstrip().endswith("parquet")


def _files(docs: DataFrame) -> list[str]:
    return sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())


class Texts:
    """``rows``: (doc_id, doc, loc, text), a null doc_id as the largest, a null text as empty.
    ``paths``: the files by number."""

    def __init__(self, docs: DataFrame, first: int = 0) -> None:
        spark = docs.sparkSession
        names = _files(docs) if _plain_scan(docs) else []
        if len(names) < spark.sparkContext.defaultParallelism:
            path = scratch(spark, "texts")
            docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            docs.repartition(spark.sparkContext.defaultParallelism * 2).write.option("parquet.block.size", 8 << 20).parquet(path)
            docs = spark.read.schema("doc_id long, text string").parquet(path)
            names = _files(docs)
        self.paths = dict(enumerate(names, first))
        # from an Arrow table, whose size Spark knows: it broadcasts a list below its threshold
        files = spark.createDataFrame(pa.table({"path": pa.array(names, pa.string()), "file": pa.array(list(self.paths), pa.int64())}))
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
        loc = F.shiftleft("file", ROW_BITS).bitwiseOR(F.col("row"))
        self.rows = rows.join(files, "path").select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), loc.alias("loc"), F.coalesce("text", F.lit("")).alias("text"))

    def headers(self) -> DataFrame:
        """(loc, place) with -1 for every document: what ``visit`` shows without marks."""
        return self.rows.select("loc", F.lit(-1).cast("long").alias("place"))


Visitor = Callable[[list, list[str], np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def visit(spark: SparkSession, paths: dict[int, str], wanted: DataFrame, fn: Visitor, schema: str) -> DataFrame:
    """``fn`` over the documents that ``wanted`` (loc, place, then longs) names, in the order of
    their files: (doc_ids, texts, locs, index into these for each row, rows as a matrix)."""
    limit_batches(spark, BATCH_ROWS * 10)
    names = wanted.columns
    parts = max(1, min(len(paths), 20_000))
    file = F.shiftright("loc", ROW_BITS)
    wanted = wanted.repartitionById(parts, F.pmod(file, F.lit(parts)).cast("int")).sortWithinPartitions("loc", "place")

    def one(file: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        pf = open_parquet(paths[file])
        at = rows[:, 0] & ((1 << ROW_BITS) - 1)
        base = 0
        for g in range(pf.num_row_groups):
            n = pf.metadata.row_group(g).num_rows
            if np.searchsorted(at, base) < np.searchsorted(at, base + n):
                here = base
                for batch in pf.iter_batches(BATCH_ROWS, row_groups=[g], columns=["doc_id", "text"]):
                    lo, hi = np.searchsorted(at, (here, here + batch.num_rows))
                    if lo < hi:
                        places, index = np.unique(at[lo:hi] - here, return_inverse=True)
                        picked = batch.take(pa.array(places))
                        texts = [t or "" for t in picked.column("text").to_pylist()]
                        yield from fn(picked.column("doc_id").to_pylist(), texts, (file << ROW_BITS) | (places + here), index, rows[lo:hi])
                    here += batch.num_rows
            base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(names))], axis=1)
            files = rows[:, 0] >> ROW_BITS
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(rows)]
            for s, e in zip(cuts, cuts[1:]):
                if files[s] != current and held:
                    yield from one(current, np.concatenate(held))
                    held = []
                current = int(files[s])
                held.append(rows[s:e])
        if held:
            yield from one(current, np.concatenate(held))

    return wanted.mapInArrow(run, schema)
