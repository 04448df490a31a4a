"""Operator 1: repeated byte strings by the common-prefix interval tree of an enhanced suffix
array.

A suffix array of a whole large corpus can't be sorted in bounded memory, so it is built in
buckets that lose nothing: strings of ``length`` bytes that are equal share their anchor
(``anchors``), and only segments whose anchor is shared by different segments need sorting
(``repeat_core``). In a bucket the suffixes are sorted by prefix doubling, neighbours' common
prefixes are measured, and one pass with a stack over them enumerates the prefix intervals. An interval
whose members are preceded by different bytes (or by a segment's start) can't be extended to
the left; it is a maximal repeat, given with all of its occurrences, not just neighbours.

Texts are UTF-8 bytes. Null and empty texts, and texts shorter than ``length``, keep all of
their bytes. Equal rows are copies of each other and lose the repeated bytes. A byte of a
character may be removed without its others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.llm.anchors import BYTES, segments
from tabulae.llm.common import arrow_map, cut, limit_batches
from tabulae.llm.components import components
from tabulae.llm.repeat_core import ASK, ASK_DECIDED, HOT, MARK, Windows, anchor_rows, asked_segments, chunks_of, covered, join_runs, packed, places_of, repeated_digests, scan_rows
from tabulae.llm.texts import LAST, Texts, visit

CHUNK_BYTES = 1_500_000


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    return BYTES[np.frombuffer(b"".join(parts), np.uint8)], np.array([len(p) for p in parts], np.int64)


class EnhancedSuffixArray:
    """Sorted suffixes of several byte strings, and the common prefixes of neighbours.

    ``starts`` restricts which suffixes are listed. No common prefix crosses a string's end."""

    def __init__(self, bodies: list[bytes], starts: np.ndarray | None = None) -> None:
        sizes = np.array([len(b) for b in bodies], np.int64)
        text = np.frombuffer(b"".join(bodies), np.uint8)
        n = len(text)
        self.text, self.string = text, np.repeat(np.arange(len(sizes)), sizes)
        self.begin = (np.cumsum(sizes) - sizes)[self.string] if n else np.zeros(0, np.int64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        self.left = left
        depth, ranks = 7, []
        key = np.zeros(n, np.int64)
        for k in range(depth):
            part = np.zeros(n, np.int64)
            part[: max(0, n - k)] = text[k:].astype(np.int64) + 1
            part[left <= k] = 0
            key = key << 9 | part
        longest = int(sizes.max()) if len(sizes) else 0
        while True:
            _, rank = np.unique(key, return_inverse=True)
            ranks.append((depth, rank.astype(np.int32)))
            if depth >= longest:
                break
            beyond = np.zeros(n, np.int64)
            beyond[: max(0, n - depth)] = rank[depth:] + 1
            beyond[left <= depth] = 0
            key = rank * (n + 1) + beyond
            depth *= 2
        places = np.arange(n) if starts is None else starts
        self.suffixes = places[np.argsort(ranks[-1][1][places], kind="stable")]
        a, b = self.suffixes[:-1], self.suffixes[1:]
        self.common = np.zeros(len(a), np.int64)
        most = np.minimum(left[a], left[b])
        for depth, rank in reversed(ranks):
            at = np.flatnonzero(self.common + depth <= most)
            x, y = a[at] + self.common[at], b[at] + self.common[at]
            inside = (x < n) & (y < n)
            at, x, y = at[inside], x[inside], y[inside]
            self.common[at[rank[x] == rank[y]]] += depth
        for _ in range(6):  # what is left is shorter than the first depth
            at = np.flatnonzero(self.common < most)
            x, y = a[at] + self.common[at], b[at] + self.common[at]
            self.common[at[text[x] == text[y]]] += 1

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, occurrences) of each prefix interval of at least ``least`` whose members
        are preceded by different bytes. Intervals come from one pass with a stack."""
        suffixes, text, begin = self.suffixes, self.text, self.begin
        # the byte before each suffix; every string's start counts as one of its own
        previous = np.where(suffixes > begin[suffixes], text[np.maximum(suffixes - 1, 0)].astype(np.int64), -1 - suffixes)
        changes = np.concatenate([[0], np.cumsum(previous[1:] != previous[:-1])]) if len(suffixes) else np.zeros(0)
        common = self.common
        runs = np.flatnonzero(common >= least)
        if not len(runs):
            return
        cuts = np.flatnonzero(np.diff(runs) > 1) + 1
        for run in np.split(runs, cuts):
            lo, values = int(run[0]), common[run].tolist()
            stack: list[tuple[int, int]] = []
            for k, value in enumerate([*values, 0]):
                at = lo + k
                start = at
                while stack and stack[-1][0] > value:
                    size, start = stack.pop()
                    if changes[at] != changes[start]:  # left extensions differ
                        yield size, suffixes[start : at + 1]
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, start))


def _bucket_groups(batches: list[pa.RecordBatch]) -> tuple[EnhancedSuffixArray, pa.Table, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    bodies = table.column("body").to_pylist()
    sizes = np.array([len(b) for b in bodies], np.int64)
    windows = table.column("windows").to_numpy()
    offset = np.cumsum(sizes) - sizes
    starts = np.repeat(offset, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return EnhancedSuffixArray(bodies, starts), table, offset, sizes


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """Marks (loc, place) of undecided windows that stand in a maximal repeat."""
    limit_batches(rows.sparkSession, 2000)
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "loc", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, CHUNK_BYTES):
            array, table, offset, _ = _bucket_groups(chunk)
            # an occurrence at s of a repeat of n bytes has n - length + 1 windows of its own
            change = np.zeros(len(array.text) + 1, np.int64)
            for size, places in array.maximal_repeats(length):
                change[places] += 1
                change[places + size - length + 1] -= 1
            hit = np.cumsum(change[:-1]) > 0
            undecided = table.column("undecided").to_numpy()
            at = np.flatnonzero(hit & undecided[array.string])
            if not len(at):
                continue
            string = array.string[at]
            first = table.column("first").to_numpy()[string] + at - offset[string]
            loc = table.column("loc").to_numpy()[string]
            row, f, c = join_runs(loc, first, np.ones(len(at), np.int64))
            idx, place = packed(f, c)
            yield pa.record_batch([pa.array(loc[row][idx]), pa.array(place)], ["loc", "place"])

    return rows.mapInArrow(run, "loc long, place long")


def _marks(texts: Texts, length: int, gram: int) -> DataFrame:
    """(loc, place) of all windows that stand elsewhere too. An anchor of more than ``HOT``
    different segments would fill a task: its windows are compared one by one by their digests."""

    def bodies(text: str, places: list[tuple[int, int]]) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return [data[f : f + c + length - 1] for f, c in places]

    def split(body: bytes) -> list[bytes]:
        return [body[k : k + length] for k in range(len(body) - length + 1)]

    spark = texts.rows.sparkSession
    found = cut(scan_rows(anchor_rows(texts, Windows(length, gram, _symbols, earlier=False)), earlier=False), "repeats")
    asked = found.filter(F.col("kind").isin(ASK, ASK_DECIDED))
    hot = asked.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor")
    cold_rows = asked_segments(spark, texts.paths, asked.join(hot, "anchor", "left_anti"), bodies)
    hot_rows = asked_segments(spark, texts.paths, asked.join(hot, "anchor", "left_semi"), bodies)
    sure = found.filter(F.col("kind") == MARK).select("loc", "place")
    return sure.unionByName(_compare(cold_rows, length)).unionByName(repeated_digests(hot_rows, split, earlier=False))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, stop) of each row:
    every byte that is covered by a string of ``length`` bytes that starts elsewhere too."""
    texts = Texts(docs)
    wanted = texts.headers().unionByName(_marks(texts, length, gram))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [*[pa.int64()] * 4, pa.string(), span]

    def finish(doc_ids, texts_, _, index, rows) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        for doc, text, places in zip(doc_ids, texts_, places_of(rows, index, len(texts_))):
            data = text.encode("utf-8", "surrogatepass")
            spans = covered(places, length)
            digest, at = hashlib.sha256(), 0
            for start, stop in spans:
                digest.update(data[at:start])
                at = stop
            digest.update(data[at:])
            for col, v in zip(out, (doc, len(data), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "stop": e} for s, e in spans])):
                col.append(v)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return visit(docs.sparkSession, texts.paths, wanted, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def repeat_groups(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """(group, size, doc_id, start): maximal repeats of ``length`` bytes or more of the whole
    corpus, each with all of its occurrences.

    A repeat lies inside spans that ``remove_repeats`` finds, so only these are sorted: spans that
    share anchors, directly or by others, in one suffix array. Of equal spans two go there, which
    gives the same repeats, and the second one's occurrences are joined back to all the others.
    The different spans that are connected by anchors must fit in one task."""
    texts = Texts(docs)

    def spans(doc_ids, texts_, _, index, rows) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, bytes]] = []
        for doc, text, places in zip(doc_ids, texts_, places_of(rows, index, len(texts_))):
            data = text.encode("utf-8", "surrogatepass")
            for start, stop in covered(places, length):
                out.append((LAST if doc is None else doc, start, xxhash.xxh64_intdigest(data[start:stop]), data[start:stop]))
        doc, start, name, body = zip(*out) if out else ((),) * 4
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(body, pa.binary())], ["doc", "start", "name", "body"])

    found = visit(docs.sparkSession, texts.paths, _marks(texts, length, gram), spans, "doc long, start long, name long, body binary")
    nth = F.row_number().over(W.partitionBy("name").orderBy("doc", "start"))
    found = cut(found.withColumn("nth", nth).withColumn("copy", F.least("nth", F.lit(2))).select("name", "copy", "doc", "start", "nth", "body"), "spans")

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(1).to_pylist()
        s = segments(BYTES[np.frombuffer(b"".join(bodies), np.uint8)], np.array([len(b) for b in bodies], np.int64), length, gram)
        return pa.record_batch([pa.array(batch.column(0).to_numpy()[s.row]), pa.array(s.anchor)], ["name", "anchor"])

    edges = arrow_map(found.filter("nth = 1").select("name", "body"), anchors, "name long, anchor long")
    known = components(edges, "name", "anchor").withColumnRenamed("node", "name")
    rows = found.filter("nth <= 2").join(known, "name", "left").withColumn("component", F.coalesce("component", "name"))
    rows = rows.select("component", "name", "copy", "doc", "start", "nth", "body").repartition("component").sortWithinPartitions("component", "name", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, CHUNK_BYTES):
            table = pa.Table.from_batches(chunk)
            array = EnhancedSuffixArray(table.column("body").to_pylist())
            name, copy = table.column("name").to_numpy(), table.column("copy").to_numpy()
            for size, places in array.maximal_repeats(length):
                string = array.string[places]
                group = hashlib.sha256(array.text[places[0] : places[0] + size].tobytes()).hexdigest()
                yield pa.record_batch([pa.array([group] * len(places)), pa.array(np.full(len(places), size)), pa.array(name[string]), pa.array(copy[string]), pa.array(places - array.begin[places])], ["group", "size", "name", "copy", "offset"])

    groups = rows.mapInArrow(run, "group string, size long, name long, copy int, offset long")
    return groups.join(found.select("name", "copy", "doc", "start"), ["name", "copy"]).select("group", "size", F.col("doc").alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"))
