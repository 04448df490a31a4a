"""Operator 8: token counts from flat token files by a separator scan.

``write_tokens`` writes texts as flat files of 16-bit ids with an end-of-document id after
each document, and a manifest of the order. ``scan_tokens`` needs the flat files only: it
cuts them into blocks at any byte offset, each task finds the separators of its block with
one vectorised comparison, and a prefix scan over the blocks of a file carries the tokens
behind a block's last separator, and the number of documents so far, into the next block.

Files are written under another name and moved into place, so a repeated task leaves the
same file. Null texts count as empty: no tokens. Tokens behind a file's last separator are a
document of their own. Repeated rows are counted each, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.llm.common import cut, limit_batches, only, scratch
from tabulae.llm.texts import filesystem

BLOCK_BYTES = 4 << 20


@lru_cache(2)
def _encoding(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, tokenizer: str, separator: int, path: str) -> DataFrame:
    """Write the flat files below ``path``; returns the manifest (file, ordinal, doc_id). A
    tokenizer with ids that 16 bits can't hold, or that gives the separator itself, is refused."""
    spark = docs.sparkSession
    limit_batches(spark, 400)
    most = _encoding(tokenizer).max_token_value
    if most >= separator or separator >= 1 << 16:
        raise ValueError(f"ids up to {most} with the separator {separator} don't fit flat files of 16-bit ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{path}/tokens/part-{part:06d}.bin"
        fs, inner = filesystem(name)
        attempt = f"{inner}.{TaskContext.get().taskAttemptId()}"
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        end = np.array([separator], np.uint16)
        ordinal = 0
        with fs.open_output_stream(attempt) as f:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    ids = _encoding(tokenizer).encode_to_numpy(text) if text else np.zeros(0, np.uint32)
                    f.write(ids.astype(np.uint16).tobytes() + end.tobytes())
                n = batch.num_rows
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "doc_id"])
                ordinal += n
        fs.move(attempt, inner)

    only(docs, "doc_id", "text").mapInArrow(write, "file string, ordinal long, doc_id long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def scan_tokens(spark: SparkSession, files: list[str], separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in flat files of 16-bit ids."""
    block_bytes -= block_bytes % 2
    # one row for each block: the listing knows files and sizes, no contents
    sizes = []
    for f in sorted(files):
        fs, inner = filesystem(f)
        sizes.append((f, fs.get_file_info(inner).size))
    listing = spark.createDataFrame(sizes, "file string, size long")
    blocks = listing.select("file", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / block_bytes).cast("int")))).alias("block"))
    blocks = blocks.filter("size > 0").repartition("file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                fs, inner = filesystem(file)
                with fs.open_input_file(inner) as f:
                    f.seek(block * block_bytes)
                    ids = np.frombuffer(f.read(block_bytes), np.uint16)
                at = np.flatnonzero(ids == separator)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.record_batch([pa.array([file]), pa.array([block], pa.int32()), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([tail], pa.int64())], ["file", "block", "lengths", "tail"])

    whole_blocks = cut(blocks.mapInArrow(search, "file string, block int, lengths array<long>, tail long"), "blocks")
    found = whole_blocks.select("file", "block", "tail", F.size("lengths").cast("long").alias("n"))
    # prefix scan over the blocks' summaries: documents ended so far, and the tails since the last
    # block with a separator; the lengths themselves are joined back to it
    upto = W.partitionBy("file").orderBy("block")
    past = upto.rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("ended", F.coalesce(F.sum("n").over(past), F.lit(0)))
    found = found.withColumn("span", F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(past), F.lit(0)))
    within = W.partitionBy("file", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("last_tail", F.last(F.when(F.col("n") > 0, F.col("tail")), ignorenulls=True).over(past))
    found = found.withColumn("carry", F.coalesce("last_tail", F.lit(0)) + F.coalesce(F.sum("tail").over(within), F.lit(0)))
    ends = W.partitionBy("file").orderBy(F.col("block").desc())
    found = found.withColumn("final", F.row_number().over(ends) == 1)
    rest = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry"))
    found = found.select("file", "block", "ended", "carry", (F.col("final") & (rest > 0)).alias("open"))
    found = found.join(whole_blocks, ["file", "block"])
    whole = F.when(F.col("open"), F.concat("lengths", F.array("tail"))).otherwise(F.col("lengths"))
    rows = found.select("file", "ended", "carry", F.posexplode(whole).alias("k", "length"))
    return rows.select("file", (F.col("ended") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, separator: int = 50256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens of every document, by writing flat files and scanning them."""
    spark = docs.sparkSession
    path = scratch(spark, "flat")
    manifest = write_tokens(docs, tokenizer, separator, path)
    files = [r.file for r in manifest.select("file").distinct().collect()]
    counts = scan_tokens(spark, files, separator, block_bytes)
    return manifest.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
