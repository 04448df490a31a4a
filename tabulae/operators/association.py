"""Associations: shared documents, co-occurrence, graphs, similarity of profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.measures import chi_squared_2x2, log_likelihood_2x2, pmi, wilson


def _beside(sets: DataFrame, anchor: str) -> tuple[DataFrame, DataFrame]:
    """(text, n, joint): the sets that hold each word, and those with ``anchor`` besides; one row (sets, known,
    anchor_n). Sets are not shuffled: words are counted where they are read, and the counts kept for both."""
    held = F.array_contains("words", anchor)
    known = F.col("doc_id").isNotNull()  # a set without an id counts for its words, not for pairs
    # a null stands for the set itself; none for an empty one
    words = F.when(F.size("words") > 0, F.concat(F.array(F.lit(None).cast("string")), F.col("words")))
    rows = sets.select(known.alias("known"), held.alias("held"), F.explode(words).alias("text"))
    rows = rows.groupBy("text").agg(F.count("*").alias("n"), F.count_if(F.col("held") & F.col("known")).alias("joint"), F.count_if("held").alias("anchor_n"), F.count_if("known").alias("known"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # a row a word
    return rows.filter((F.col("text") != anchor) & (F.col("joint") > 0)).select("text", "n", "joint"), rows.filter("text IS NULL").select(F.col("n").alias("sets"), "known", "anchor_n")


def assoc(documents: DataFrame, word: str) -> DataFrame:
    """Document-level two-by-two association of ``word`` with every other word. ``documents`` has a row a
    document with its ``words`` as a set (``adapter.document_sets``)."""
    words, total = _beside(documents, word)
    rows = words.withColumnRenamed("n", "right_n").crossJoin(F.broadcast(total.select(F.col("known").alias("total"), F.col("anchor_n").alias("left_n"))))  # one row
    args = [F.col(c) for c in ("joint", "left_n", "right_n", "total")]
    return rows.select("text", "joint", "right_n", F.round(chi_squared_2x2(*args), 4).alias("chi2"), F.round(log_likelihood_2x2(*args), 4).alias("g2"), F.round(pmi(*args), 6).alias("pmi"))


def cooccur(tokens: DataFrame, word: str, top: int = 50) -> DataFrame:
    """The words that share most documents with ``word``."""
    docs = tokens.filter(F.col("text") == word).select("doc_id").distinct()
    rows = tokens.filter(F.col("text") != word).join(docs, "doc_id", "left_semi").select("doc_id", "text").distinct()
    return rows.groupBy("text").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "text").limit(top)


def cooccurrence_edges(units: DataFrame, unit: str, item: str, min_count: int = 1) -> DataFrame:
    """(source, target, weight): units that hold both items. Items below ``min_count`` units
    can't reach it in a pair and go before pairs are built within a unit."""
    seen = units.select(unit, item).distinct()
    common = seen.groupBy(item).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select(item)
    seen = seen.join(common, item, "left_semi")
    # a written table would be read twice for less, but the join's sides share one exchange by unit
    seen = seen.repartition(unit)
    a, b = seen.select(unit, F.col(item).alias("source")), seen.select(unit, F.col(item).alias("target"))
    pairs = a.join(b, unit).filter("source < target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_count)


def line_pmi(lines: DataFrame, anchor: str, min_joint: int = 2) -> DataFrame:
    """PMI of each word with ``anchor`` over lines, a word counting once a line. ``lines`` has a row a line
    with its ``words`` as a set (``adapter.line_sets``)."""
    words, total = _beside(lines, anchor)
    rows = words.filter(F.col("joint") >= min_joint).crossJoin(F.broadcast(total.select(F.col("sets").alias("total"), "anchor_n")))  # one row
    return rows.select("text", "joint", "n", F.round(pmi(F.col("joint"), F.col("n"), F.col("anchor_n"), F.col("total")), 6).alias("pmi"))


def exclusivity(rows: DataFrame, item: str, group: str, min_count: int = 1) -> DataFrame:
    """Each item's share in the group where it occurs most, with that share's Wilson interval."""
    pairs = rows.groupBy(item, group).agg(F.count("*").alias("n"))
    best = pairs.groupBy(item).agg(F.sum("n").alias("total"), F.max(F.struct("n", group)).alias("top")).filter(F.col("total") >= min_count)
    band = wilson(F.col("top.n"), F.col("total"))
    return best.select(F.col(item).alias("item"), "total", F.col(f"top.{group}").alias("top_group"), F.round(F.col("top.n") / F.col("total"), 6).alias("share"), F.round(band["low"], 6).alias("low"), F.round(band["high"], 6).alias("high"))


def divergence(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Log2 ratio of the rates of values that two count tables share, a half added to each."""
    totals = left.agg(F.sum(n).alias("lt")).crossJoin(right.agg(F.sum(n).alias("rt")))
    rows = left.select(key, F.col(n).alias("l")).join(right.select(key, F.col(n).alias("r")), key).crossJoin(F.broadcast(totals))
    return rows.select(key, "l", "r", F.round(F.log2(((F.col("l") + 0.5) / (F.col("lt") + 0.5)) / ((F.col("r") + 0.5) / (F.col("rt") + 0.5))), 6).alias("log_ratio"))


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, top: int = 5, block: int = 2000) -> DataFrame:
    """(q, v, cosine, rank): the ``top`` nearest vectors of each query, ties by id. Queries are a stated
    set: they are read in blocks of ``block``, each multiplied with all rows in Arrow batches, ``CELLS`` pairs at
    once; a task keeps its ``top`` rows of each query, so what is shuffled grows with tasks, not with pairs."""
    out = None
    ids = queries.select("vec_id").distinct()
    parts = max(1, -(-ids.count() // block))
    for k in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).dropDuplicates(["vec_id"]).select("vec_id", "embedding").collect()
        if rows:
            part = _nearest(vectors, np.array([r.vec_id for r in rows], np.int64), np.array([r.embedding for r in rows], float), top)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "q long, v long, cosine double, rank long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "v"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)


#: Pairs of a query and a row that a task holds at once: a few arrays of 8 bytes each.
CELLS = 1 << 19


def _nearest(vectors: DataFrame, names: np.ndarray, asked: np.ndarray, top: int) -> DataFrame:
    norms = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = np.divide(asked, norms, out=np.zeros_like(asked), where=norms > 0)
    step = max(1, CELLS // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_q, best_v, best_c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        last = np.full(len(names), -np.inf)  # of the nearest so far, once there are enough
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                ids, m = b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                size = np.linalg.norm(m, axis=1)
                cosine = np.round(np.divide(asked @ m.T, size, out=np.zeros((len(names), len(m))), where=size > 0), 6)
                cosine[names[:, None] == ids[None, :]] = -np.inf
                least = last if len(m) <= top or np.isfinite(last).all() else np.maximum(last, np.partition(cosine, len(m) - top, axis=1)[:, len(m) - top])
                q, j = np.nonzero((cosine >= least[:, None]) & np.isfinite(cosine))
                q, v, c = np.concatenate([best_q, q]), np.concatenate([best_v, ids[j]]), np.concatenate([best_c, cosine[q, j]])
                order = np.lexsort((v, -c, q))
                q, v, c = q[order], v[order], c[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < top
                best_q, best_v, best_c = q[keep], v[keep], c[keep]
                full = np.flatnonzero(np.bincount(best_q, minlength=len(names)) == top)
                last[full] = best_c[np.searchsorted(best_q, full, "right") - 1]
        yield pa.record_batch([pa.array(names[best_q]), pa.array(best_v), pa.array(best_c)], ["q", "v", "cosine"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "q long, v long, cosine double")
