"""Operator 7: incremental substring dedup with a log-structured fingerprint index.

The index is a folder: immutable runs and a manifest, written anew under the next number when
anything changes, so an index is reopened by its path. A run is one Parquet file for each
range of anchors (``2**bits`` of them, by their low bits), sorted by (anchor, segment), with the smallest doc_id
of each segment of windows, its place and its sides. A batch's fingerprints are partitioned by the same
ranges and sorted; each task streams them past its range's files of all runs, which are merged
in as they come and never sorted or shuffled again. Equal segments are repeats; where a batch's
segment meets an unequal one of the same anchor that agrees with it before or after the anchor,
the words of both are read where they lie and compared window by window. The task writes what is new as the batch's run. ``compact`` merges
runs range by range, again without a shuffle.

Fingerprints are of segments of windows with a common anchor (``anchors``), not of each
window, which keeps a run smaller than the texts. The index keeps no texts: it refers to the
files of the documents, which must stay.

A window is ``length`` words of one document. A word goes when a window over it also starts
in a document with a smaller doc_id, in this batch or an earlier one; windows are judged on
the input. Null texts have no words; texts with fewer words than a window keep them all.
Rows that share a doc_id never count against each other; a null doc_id counts as the largest.
A batch with a smaller doc_id than one that is indexed is refused. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.llm.anchors import mix
from tabulae.llm.common import BATCH_ROWS, cut, limit_batches, scratch
from tabulae.llm.repeat_core import ASK, ASK_DECIDED, ENTRY, KIND, KIND_BITS, LIMIT, MARK, SHIFT, Windows, anchor_rows, covered, join_runs, packed, places_of, scan_rows
from tabulae.llm.texts import LAST, Texts, filesystem, visit

_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
ENTRY_NAMES = ["anchor", "whole", "doc", "loc", "place", "sides"]
ENTRY_TYPE = np.dtype([(n, np.int64) for n in ENTRY_NAMES])
ENTRY_SCHEMA = pa.schema([(n, pa.int64()) for n in ENTRY_NAMES])
#: Entries of one run that a task holds while it merges.
READ_ROWS = 20_000
#: Documents a range stands for in ``remove_earlier_windows``; a task has a batch's share of them.
RANGE_DOCS = 8_000
#: Windows that a task merges before it sends them to their digests.
MERGE_WINDOWS = 300_000
#: States of windows on their way to their digests, and a mark among them.
UNDECIDED, DECIDED, MARKED = range(3)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = [words_of(t) for t in texts]
    digest = xxhash.xxh64_intdigest
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.fromiter(map(digest, chain.from_iterable(rows)), np.uint64, int(sizes.sum())), sizes


def _digests(words: list[bytes], count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests of the windows of segments, as two halves: ``words`` has those of one
    segment behind another, ``count`` their numbers of windows."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    size = count + length - 1
    start = np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count) + np.arange(count.sum())
    out = []
    for half, multiplier in zip(halves.T, _MULTIPLIERS):
        total = np.zeros(len(start), np.uint64)
        for k in range(length):
            total = total * multiplier + half[start + k]
        out.append(mix(total).view(np.int64))
    return out[0], out[1]


def _range_of(anchor: int, bits: int) -> int:
    # anchors are the least of their neighbours by their high half; only the low one is even
    return anchor & ((1 << bits) - 1)


class _Run:
    """The entries of one range of a run, in order, a block at a time."""

    def __init__(self, path: str, name: str) -> None:
        fs, inner = filesystem(f"{path}/{name}")
        self.blocks: Iterator = iter(())
        if fs.get_file_info(inner).type != pafs.FileType.NotFound:
            self.blocks = pq.ParquetFile(fs.open_input_file(inner), pre_buffer=False).iter_batches(READ_ROWS)
        self.block = self._next()

    def _next(self) -> np.ndarray:
        out = np.empty(0, ENTRY_TYPE)
        for batch in self.blocks:
            out = np.empty(batch.num_rows, ENTRY_TYPE)
            for n in ENTRY_NAMES:
                out[n] = batch.column(n).to_numpy()
            break
        return out

    def upto(self, anchor: int, whole: int | None) -> list[np.ndarray]:
        """Entries at or before (anchor, whole), or all of the anchor, which are then forgotten."""
        out = []
        while len(self.block):
            b = self.block
            if b["anchor"][-1] < anchor:
                n = len(b)
            else:
                lo, n = np.searchsorted(b["anchor"], anchor), np.searchsorted(b["anchor"], anchor, "right")
                if whole is not None:
                    n = lo + np.searchsorted(b["whole"][lo:n], whole, "right")
            out.append(b[:n])
            if n < len(b):
                self.block = b[n:]
                break
            self.block = self._next()
        return out


def _file(k: int) -> str:
    return f"range-{k:06d}.parquet"


def _reader(paths: list[str], k: int) -> Callable[[int, int | None], np.ndarray]:
    runs = [_Run(p, _file(k)) for p in paths]

    def pull(anchor: int, whole: int | None) -> np.ndarray:
        parts = [x for r in runs for x in r.upto(anchor, whole)]
        return np.concatenate(parts) if parts else np.empty(0, ENTRY_TYPE)

    return pull


class _RunWriter:
    """One range's file of a new run; it appears under its name only when it is whole, so a task
    that is repeated leaves the same file."""

    def __init__(self, path: str, k: int) -> None:
        self.fs, self.inner = filesystem(f"{path}/{_file(k)}")
        self.attempt = f"{self.inner}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.inner.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.attempt)
        self.writer = pq.ParquetWriter(self.stream, ENTRY_SCHEMA, compression="zstd", use_dictionary=False, column_encoding={n: "DELTA_BINARY_PACKED" if n in ("anchor", "doc", "loc", "sides") else "PLAIN" for n in ENTRY_NAMES})

    def add(self, columns: list) -> None:
        self.writer.write_table(pa.Table.from_arrays([pa.array(c) for c in columns], schema=ENTRY_SCHEMA), row_group_size=READ_ROWS * 5)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()
        self.fs.move(self.attempt, self.inner)


def _read_manifest(path: str) -> dict | None:
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return None
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    if not names:
        return None
    with fs.open_input_stream(names[-1]) as f:
        return json.loads(f.read())


class FingerprintIndex:
    """Runs of fingerprints in a shared folder. ``length``, ``gram`` and ``bits`` hold for a new
    index; one that is reopened by its path has those it was made with."""

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = 13, gram: int = 5, bits: int = 6) -> None:
        self.spark = spark
        self.path = path or scratch(spark, "fingerprints")
        self.state = _read_manifest(self.path) or {"version": 0, "length": length, "gram": gram, "bits": bits, "runs": [], "written": 0, "files": {}, "largest": None, "sides": True}
        if not self.state.get("sides"):
            raise ValueError(f"{self.path} was made before entries had sides: build it anew")

    @property
    def runs(self) -> list[str]:
        return [f"{self.path}/{r}" for r in self.state["runs"]]

    def _commit(self, **changes) -> None:
        """The next manifest; a reader sees the one before until it is whole."""
        self.state |= changes | {"version": self.state["version"] + 1}
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        name = f"{inner}/manifest-{self.state['version']:08d}.json"
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(self.state).encode())
        fs.move(f"{name}.part", name)

    def _new_run(self) -> str:
        self.state["written"] += 1
        return f"run-{self.state['written']:06d}"

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 of a batch whose doc_ids are not smaller than
        those indexed. With ``keep`` the batch is indexed too."""
        state = self.state
        length, bits = state["length"], state["bits"]
        least, most = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc")).agg(F.min("doc"), F.max("doc")).first()
        if least is not None and state["largest"] is not None and least < state["largest"]:
            raise ValueError(f"doc_id {least} is smaller than {state['largest']}, which is indexed")
        texts = Texts(docs, first=len(state["files"]))
        files = {int(k): v for k, v in state["files"].items()} | texts.paths
        rows = anchor_rows(texts, Windows(length, state["gram"], _symbols, earlier=True))
        bucket = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
        rows = rows.repartitionById(1 << bits, bucket.cast("int")).sortWithinPartitions("anchor", "whole", "doc", "loc", "place")
        older, run = self.runs, self._new_run()
        scanned = scan_rows(rows, earlier=True, history=lambda anchor: _reader(older, _range_of(anchor, bits)))
        found = cut(self._written(scanned, f"{self.path}/{run}", bits, keep), "found")
        marks = found.filter(F.col("kind") == MARK).select("loc", "place").unionByName(self._verified(files, found.filter(F.col("kind").isin(ASK, ASK_DECIDED)), length))
        if keep:
            largest = most if state["largest"] is None or most is not None and most > state["largest"] else state["largest"]
            self._commit(runs=[*state["runs"], run], files={str(k): v for k, v in files.items()}, largest=largest)
        return self._finish(texts, marks, length)

    def _written(self, rows: DataFrame, path: str, bits: int, keep: bool) -> DataFrame:
        """``rows`` without the new entries, which each task writes as its range's file."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            writer = None
            for batch in batches:
                kind = np.asarray(batch.column(0))
                entry = (kind & KIND) == ENTRY
                if keep and entry.any():
                    new = batch.filter(pa.array(entry))
                    if writer is None:
                        writer = _RunWriter(path, _range_of(new.column(1)[0].as_py(), bits))
                    writer.add([*new.columns[1:], (kind[entry] >> KIND_BITS).astype(np.int64)])
                yield batch.filter(pa.array(~entry))
            if writer is not None:
                writer.close()

        return rows.mapInArrow(run, rows.schema)

    def compact(self) -> None:
        """Merge all runs into one, range by range; of equal segments the smallest doc_id stays."""
        if len(self.state["runs"]) < 2:
            return
        older, run, bits = self.runs, self._new_run(), self.state["bits"]
        target = f"{self.path}/{run}"

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    runs = [_Run(p, _file(k)) for p in older]
                    writer, last = None, None
                    while any(len(r.block) for r in runs):
                        # up to the nearest end of a block all entries are at hand
                        end = min((int(r.block["anchor"][-1]), int(r.block["whole"][-1])) for r in runs if len(r.block))
                        rows = np.concatenate([x for r in runs for x in r.upto(*end)])
                        rows = rows[np.lexsort((rows["place"], rows["loc"], rows["doc"], rows["whole"], rows["anchor"]))]
                        pair = np.stack([rows["anchor"], rows["whole"]], axis=1)
                        new = np.concatenate([[last is None or tuple(pair[0]) != last], (pair[1:] != pair[:-1]).any(1)])
                        last = tuple(pair[-1])
                        rows = rows[new]
                        if len(rows):
                            writer = writer or _RunWriter(target, k)
                            writer.add([np.ascontiguousarray(rows[c]) for c in ENTRY_NAMES])
                            n += len(rows)
                    if writer is not None:
                        writer.close()
            yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

        self.spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(merge, "n long").agg(F.sum("n")).collect()
        self._commit(runs=[run])
        for path in older:
            fs, inner = filesystem(path)
            if fs.get_file_info(inner).type != pafs.FileType.NotFound:
                fs.delete_dir(inner)

    def _verified(self, files: dict[int, str], asked: DataFrame, length: int) -> DataFrame:
        """Marks of windows whose words stand in a smaller doc_id."""

        limit_batches(self.spark, BATCH_ROWS * 10)
        schema = "high long, low long, doc long, loc long, first long, state int"
        names = ["high", "low", "doc", "loc", "first", "state"]

        def batch_of(*columns) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, (*[pa.int64()] * 5, pa.int32()))], names)

        def marks(loc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, f, c = join_runs(loc, first, np.ones(len(loc), np.int64))
            idx, place = packed(f, c)
            return loc[at][idx], place

        def show(_, texts, locs, index, rows) -> Iterator[pa.RecordBatch]:
            first, count = rows[:, 1] >> SHIFT, rows[:, 1] & LIMIT
            flat: list[bytes] = []
            for k, text in enumerate(texts):
                mine = slice(*np.searchsorted(index, (k, k + 1)))
                words = words_of(text)
                for f, c in zip(first[mine].tolist(), count[mine].tolist()):
                    flat += words[f : f + c + length - 1]
            own = np.repeat(np.arange(len(rows)), count)
            f = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            yield batch_of(*_digests(flat, count, length), rows[own, 2], rows[own, 0], f, np.where(rows[own, 3] == ASK, UNDECIDED, DECIDED).astype(np.int32))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Equal windows of a task merged, so one that stands in a third of all segments sends few rows."""

            def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                x = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(len(names))]
                order = np.lexsort((x[5], x[2], x[1], x[0]))
                high, low, doc, loc, first, state = (c[order] for c in x)
                new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                sure = (state == UNDECIDED) & (doc > least)
                send = new | (state == UNDECIDED) & ~sure
                yield batch_of(*(c[send] for c in (high, low, doc, loc, first, state)))
                if sure.any():
                    at, place = marks(loc[sure], first[sure])
                    # the digest of a mark only spreads it
                    yield batch_of(mix((at * 0x9E3779B1 ^ place).view(np.uint64)).view(np.int64), at, at, at, place, np.full(len(at), MARKED, np.int32))

            held: list[pa.RecordBatch] = []
            size = 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size > MERGE_WINDOWS:
                    yield from flush(held)
                    held, size = [], 0
            if size:
                yield from flush(held)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before: tuple | None = None  # the last window's digest and the smallest doc of its group
            for b in batches:
                x = [c.to_numpy() for c in b.columns]
                done = x[5] == MARKED
                at, place = x[3][done], x[4][done]
                high, low, doc, loc, first, state = (c[~done] for c in x)
                if len(high):
                    new = np.append(before is None or (high[0], low[0]) != before[:2], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
                    group = np.cumsum(new)
                    least = np.append(0 if before is None else before[2], doc[new])[group]
                    before = (high[-1], low[-1], least[-1])
                    sure = (state == UNDECIDED) & (doc > least)
                    more, place_of = marks(loc[sure], first[sure])
                    at, place = np.append(at, more), np.append(place, place_of)
                if len(at):
                    yield pa.record_batch([pa.array(at), pa.array(place)], ["loc", "place"])

        wanted = asked.select("loc", "place", "doc", F.col("kind").cast("long").alias("kind"))
        rows = visit(self.spark, files, wanted, show, schema).mapInArrow(spread, schema)
        rows = rows.repartition("high").sortWithinPartitions("high", "low", "doc")
        return rows.mapInArrow(merge, "loc long, place long")

    def _finish(self, texts: Texts, marks: DataFrame, length: int) -> DataFrame:
        kinds = [*[pa.int64()] * 3, pa.string()]

        def finish(doc_ids, texts_, _, index, rows) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in kinds]
            for doc, text, places in zip(doc_ids, texts_, places_of(rows, index, len(texts_))):
                words = words_of(text)
                n = len(words)
                for start, stop in reversed(covered(places, length)):
                    del words[start:stop]
                for col, v in zip(out, (doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                    col.append(v)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return visit(self.spark, texts.paths, texts.headers().unionByName(marks), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_earlier_windows(docs: DataFrame, length: int = 13, gram: int = 5, batches: int = 3) -> DataFrame:
    """All of ``docs`` through an index, in ``batches`` by doc_id: each is merged with the runs of
    those before, which are compacted, and the index reopened, before the last one."""
    spark = docs.sparkSession
    doc_id = docs["doc_id"].cast("long")
    doc = F.coalesce(doc_id, F.lit(LAST))
    shares = [k / batches for k in range(1, batches)] or [0.5]
    known = docs.agg(F.percentile_approx(doc, shares).alias("x"), F.count("*").alias("n")).first()
    cuts = sorted(set(known.x or [])) if batches > 1 else []
    # ranges hold about as much at any size: a task's share of a batch doesn't grow with the table
    bits = min(16, max(2, (known.n // RANGE_DOCS).bit_length()))
    index = FingerprintIndex(spark, length=length, gram=gram, bits=bits)
    out = None
    for k in range(len(cuts) + 1):
        # bounds are half open, so rows that share a doc_id stand in one batch; they are on the
        # column itself, so that Parquet's row groups of other batches aren't read
        part = docs
        if k:
            part = part.filter((doc_id > cuts[k - 1]) | doc_id.isNull() & F.lit(cuts[k - 1] < LAST))
        if k < len(cuts):
            part = part.filter((doc_id <= cuts[k]) | doc_id.isNull() & F.lit(cuts[k] == LAST))
        if k and k == len(cuts):
            index.compact()
            index = FingerprintIndex(spark, index.path)
        result = index.add(part)
        out = result if out is None else out.unionByName(result)
    return out
