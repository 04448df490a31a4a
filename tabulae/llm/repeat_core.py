"""Exact detection of repeated windows over a whole corpus: the stages that operators 1 and 7
share.

1. ``anchor_rows``: each document's segments (see ``anchors``). Within one flush of a task,
   segments that are certain to repeat are marked at once and only representatives go on,
   so a segment that stands in a third of all documents sends few rows to its key.
2. ``scan_rows``: rows sorted by (anchor, segment) stream past. Segments that are equal as a
   whole are marked. Where one anchor has several different segments, one of each kind goes
   on, since some of their windows may still be equal; with an index only those that agree in
   one of their sides (``anchors``), unless the anchor goes beyond what a task holds at once.
   State is one row, whatever the group.
   Sorted runs of earlier batches (operator 7) are read along with the rows and merged in.
3. ``asked_windows``: the texts of those segments, which are few: the borders of repeated runs.
   Texts are read where they lie (``texts``), never shuffled.

Segments are equal when both their anchor's and their own 64-bit hash agree, 128 bits in all:
among 1e13 segments two unequal ones agree with probability about 1e-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.llm.anchors import SIDE, mix, segments
from tabulae.llm.common import BATCH_ROWS, limit_batches
from tabulae.llm.texts import Texts, visit

HOT = 20_000
FLUSH = 400_000
#: kinds of rows: a segment, one that is known to repeat; then marks, segments to compare, those
#: of them that are decided already, and entries of a run
SEGMENT, REPEATED, MARK, ASK, ASK_DECIDED, ENTRY = range(6)
#: In segments and entries the sides stand above the kind.
KIND_BITS = 3
KIND = (1 << KIND_BITS) - 1
ROWS = "kind int, anchor long, whole long, doc long, loc long, place long"
FIELDS = ["kind", "anchor", "whole", "doc", "loc", "place"]
TYPES = (np.int32, *[np.int64] * 5)
#: ``place`` packs the first window and the number of windows.
SHIFT = 12
LIMIT = (1 << SHIFT) - 1


class Windows(NamedTuple):
    """What a window is: its length in symbols, the length of the anchors' grams, and how
    texts become symbols (64-bit numbers of all texts, and the number of each text's)."""

    length: int
    gram: int
    symbols: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    #: Only copies in a smaller doc_id count; else copies anywhere.
    earlier: bool


def keyed(docs: DataFrame) -> DataFrame:
    """doc, key, text: a null doc_id is taken as the largest, a null text as empty."""
    text = F.coalesce(docs["text"], F.lit("")).alias("text")
    doc = F.coalesce(docs["doc_id"], F.lit((1 << 63) - 1)).cast("long").alias("doc")
    return docs.select(docs["doc_id"].alias("doc_id"), doc, text).select("doc_id", "doc", F.xxhash64("doc", "text").alias("key"), "text")


def _batch(kind, anchor, whole, doc, loc, place) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch([pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(v, t), n))) for v, t in zip((kind, anchor, whole, doc, loc, place), TYPES)], FIELDS)


def join_runs(loc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow each other in one row, as (index of the row's entry, first, count)."""
    if not len(loc):
        return loc, first, count
    order = np.lexsort((first, loc))
    k, f, e = loc[order], first[order], first[order] + count[order]
    # segments of one row are equal or apart, so the end before is the largest so far
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] > e[:-1])])
    at = np.flatnonzero(new)
    return order[at], f[at], np.maximum.reduceat(e, at) - f[at]


def packed(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, place) of runs of windows: one with more windows than a place holds takes several."""
    parts = -(-count // LIMIT)
    idx = np.repeat(np.arange(len(first)), parts)
    n = np.arange(len(idx)) - np.repeat(np.cumsum(parts) - parts, parts)
    f = first[idx] + n * LIMIT
    return idx, f << SHIFT | np.minimum(LIMIT, first[idx] + count[idx] - f)


def anchor_rows(texts: Texts, windows: Windows) -> DataFrame:
    """Rows of ``ROWS``: segments to compare and marks."""
    rows = texts.rows.select("doc", "loc", "text")
    limit_batches(rows.sparkSession, BATCH_ROWS)
    length, gram, symbols, earlier = windows
    if length - gram + 2 > LIMIT:
        raise ValueError(f"segments of more than {LIMIT} windows: raise gram or lower length")

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, loc, first, count, anchor, whole, *sides = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((first, loc, doc, whole, anchor))
        doc, loc, first, count, anchor, whole = (x[order] for x in (doc, loc, first, count, anchor, whole))
        above = sides[0][order] << KIND_BITS if sides else np.zeros(len(order), np.int32)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(doc))) > 1
        # earlier: all but those in the smallest doc are repeats. Else all of several are, and one goes on
        sure = doc > doc[at][group] if earlier else many[group]
        send = ~sure if earlier else new
        row, f, c = join_runs(loc[sure], first[sure], count[sure])
        picked = np.flatnonzero(sure)[row]
        idx, place = packed(f, c)
        # the ``anchor`` of a mark only spreads it
        yield _batch(MARK, mix((loc[picked][idx] * 0x9E3779B1 ^ place).view(np.uint64)).view(np.int64), 0, doc[picked][idx], loc[picked][idx], place)
        yield _batch(np.where(many[group][send], REPEATED, SEGMENT) | above[send], anchor[send], whole[send], doc[send], loc[send], first[send] << SHIFT | count[send])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH_ROWS):
                batch = whole_batch.slice(at, BATCH_ROWS)
                s = segments(*symbols(batch.column(2).to_pylist()), length, gram, sides=earlier)
                doc, loc = batch.column(0).to_numpy()[s.row], batch.column(1).to_numpy()[s.row]
                if not len(doc):
                    continue
                held.append((doc, loc, s.start, s.windows, s.anchor, s.whole, *([s.sides] if earlier else [])))
                size += len(doc)
                if size > FLUSH:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, ROWS)


def _agree(number: np.ndarray, side: np.ndarray, whole: np.ndarray, undecided: np.ndarray) -> np.ndarray:
    """Which segments have one of another kind, and one that is undecided, among those of their
    anchor (``number``) and side; 0 is no side."""
    key = number.astype(np.int64) << SIDE | side
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = np.logical_or.reduceat(whole[order] != whole[order][at][group], at)
    open_ = np.logical_or.reduceat(undecided[order], at)
    out = np.empty(len(key), bool)
    out[order] = (several & open_)[group]
    return out & (side > 0)


def scan_rows(rows: DataFrame, earlier: bool, history: Callable | None = None) -> DataFrame:
    """Rows of ``ROWS``: marks, segments whose windows must be compared, and, for an index, the
    entries that are new. ``history`` opens the sorted entries of earlier runs: called with a
    partition's first anchor it gives a function that returns, and forgets, all that come before
    or at (anchor, whole). ``rows`` is partitioned and sorted already if ``history`` is given."""
    limit_batches(rows.sparkSession, BATCH_ROWS * 10)
    if history is None:
        rows = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", "doc", "loc", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pull = None
        last: dict[str, np.ndarray] | None = None  # the row before, not judged yet
        before: tuple | None = None  # anchor, whole, smallest doc of the row before ``last``
        waiting: dict[str, np.ndarray] | None = None  # asks of the last anchor that wait for a reason
        held: list[dict[str, np.ndarray]] = []
        size = 0
        old_kind = ENTRY
        fields = [*FIELDS, "sides"]

        def merged(r: dict[str, np.ndarray], final: bool) -> dict[str, np.ndarray]:
            """The rows with those of earlier runs that stand in the same anchors."""
            nonlocal pull
            if history is None or not len(r["anchor"]) and pull is None:
                return r
            if pull is None:
                pull = history(int(r["anchor"][0]))
            known = np.unique(r["anchor"]) if before is None and last is None else np.unique(np.append(r["anchor"], last["anchor"][-1] if last is not None else before[0]))
            end = int(known[-1])
            old = pull(end, None if final else int(r["whole"][-1]) if len(r["whole"]) and r["anchor"][-1] == end else None)
            if not len(old):
                return r
            at = np.minimum(np.searchsorted(known, old["anchor"]), len(known) - 1)
            old = old[known[at] == old["anchor"]]
            both = {k: np.concatenate([np.full(len(old), old_kind, np.int32) if k == "kind" else old[k], r[k]]) for k in fields}
            order = np.lexsort((both["place"], both["loc"], both["doc"], both["whole"], both["anchor"]))
            return {k: v[order] for k, v in both.items()}

        def judge(r: dict[str, np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal last, before, waiting
            r = merged(r, final)
            if last is not None:
                r = {k: np.concatenate([last[k], r[k]]) for k in fields}
            n = len(r["doc"]) - (not final)
            if n <= 0:
                last = r if len(r["doc"]) else last
                return
            last = None if final else {k: v[n:] for k, v in r.items()}
            a, w, d = r["anchor"], r["whole"], r["doc"]
            old = r["kind"] == old_kind
            new_a, new_w = np.empty(len(a), bool), np.empty(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_w[1:] = new_a[1:] | (w[1:] != w[:-1])
            new_a[0] = before is None or before[0] != a[0]
            new_w[0] = new_a[0] or before[1] != w[0]
            at = np.flatnonzero(new_w)
            group = np.cumsum(new_w) - 1
            lowest = np.where(group >= 0, d[at[np.maximum(group, 0)]] if len(at) else 0, 0)
            if before is not None:
                lowest[group < 0] = before[2]
            before = (a[n - 1], w[n - 1], lowest[n - 1])
            if earlier:
                sure = (d > lowest) & ~old
                undecided = ~sure & ~old
                ask = undecided | (old & new_w)
            else:
                sure = (r["kind"] == REPEATED) | ~new_w | np.append(~new_w[1:], False)
                undecided = ~sure
                ask = new_w.copy()
            entry = (new_w & ~old)[:n]
            a, sure, ask, undecided, new_a, new_w = (x[:n] for x in (a, sure, ask, undecided, new_a, new_w))
            cols = {k: v[:n] for k, v in r.items()}
            # an anchor is asked about if it has a second kind of segment, and one that is undecided
            number = np.cumsum(new_a)
            kinds = np.bincount(number, new_w & ~new_a, minlength=number[-1] + 1)
            open_ = np.bincount(number, undecided, minlength=number[-1] + 1)
            asks = {k: v[ask] for k, v in cols.items()} | {"undecided": undecided[ask], "number": number[ask]}
            if waiting is not None:
                kinds[0] += waiting.pop("kinds")
                open_[0] += waiting.pop("open")
                asks = {k: np.concatenate([waiting[k] if k != "number" else np.zeros(len(waiting["doc"]), np.int64), asks[k]]) for k in asks}
                waiting = None
            good = (kinds > 0) & (open_ > 0)
            ready = good[asks["number"]]
            if history is not None:
                # an anchor that stands in this chunk as a whole: all its kinds are at hand
                inner = np.flatnonzero(ready & (asks["number"] > 0) & (final | (asks["number"] < number[-1])))
                if len(inner):
                    x = {k: v[inner] for k, v in asks.items()}
                    left, right = x["sides"] >> SIDE, x["sides"] & ((1 << SIDE) - 1)
                    ready[inner] = _agree(x["number"], left, x["whole"], x["undecided"]) | _agree(x["number"], right, x["whole"], x["undecided"])
            tail = (asks["number"] == number[-1]) & ~ready
            if not final:
                waiting = {k: v[tail] for k, v in asks.items()} | {"kinds": kinds[number[-1]], "open": open_[number[-1]]}
            if ready.any():
                yield _batch(np.where(asks["undecided"][ready], ASK, ASK_DECIDED), *(asks[k][ready] for k in FIELDS[1:]))
            if sure.any():
                yield _batch(MARK, 0, 0, cols["doc"][sure], cols["loc"][sure], cols["place"][sure])
            if history is not None and entry.any():
                yield _batch(cols["sides"][entry].astype(np.int32) << KIND_BITS | ENTRY, *(cols[k][entry] for k in FIELDS[1:]))

        for batch in batches:
            if not batch.num_rows:
                continue
            r = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in FIELDS}
            done = r["kind"] == MARK
            if done.any():
                yield batch.filter(pa.array(done)).select(FIELDS)
                r = {k: v[~done] for k, v in r.items()}
            held.append(r | {"kind": r["kind"] & KIND, "sides": r["kind"] >> KIND_BITS})
            size += len(r["doc"])
            if size >= 50_000:
                yield from judge({k: np.concatenate([h[k] for h in held]) for k in fields}, False)
                held, size = [], 0
        if held or last is not None:
            empty = {k: np.zeros(0, t) for k, t in zip(fields, (*TYPES, np.int32))}
            yield from judge({k: np.concatenate([empty[k], *(h[k] for h in held)]) for k in fields}, True)

    return rows.mapInArrow(run, ROWS)


def asked_segments(spark, paths: dict[int, str], asked: DataFrame, cut_text: Callable[[str, list[tuple[int, int]]], list[bytes]]) -> DataFrame:
    """(anchor, doc, loc, first, windows, undecided, body) of the rows (kind, anchor, doc, loc,
    place) asked for. ``cut_text`` gives the bodies of (first window, number of windows) of a text."""
    wanted = asked.select("loc", "place", "anchor", "doc", F.col("kind").cast("long").alias("kind"))
    names = ["anchor", "doc", "loc", "first", "windows", "undecided", "body"]

    def show(_, texts, locs, index, rows) -> Iterator[pa.RecordBatch]:
        first, count = rows[:, 1] >> SHIFT, rows[:, 1] & LIMIT
        bodies: list[bytes] = []
        for k, text in enumerate(texts):
            mine = slice(*np.searchsorted(index, (k, k + 1)))
            bodies += cut_text(text, list(zip(first[mine].tolist(), count[mine].tolist())))
        anchor, doc, loc = (np.ascontiguousarray(rows[:, k]) for k in (2, 3, 0))
        yield pa.record_batch([*map(pa.array, (anchor, doc, loc, first, count, rows[:, 4] == ASK)), pa.array(bodies, pa.binary())], names)

    return visit(spark, paths, wanted, show, "anchor long, doc long, loc long, first long, windows long, undecided boolean, body binary")


def repeated_digests(segments_: DataFrame, split: Callable[[bytes], list[bytes]], earlier: bool) -> DataFrame:
    """Marks (loc, place) of the undecided windows of ``asked_segments`` that stand elsewhere, or
    in a smaller doc, by their 128-bit digests. A task merges its equal windows first, so a window
    of a third of all segments sends few rows to its digest; then rows stream past in order."""
    limit_batches(segments_.sparkSession, BATCH_ROWS * 10)
    schema = "digest binary, doc long, loc long, first long, state int"
    names = ["digest", "doc", "loc", "first", "state"]

    def marks(loc: list[int], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at, f, c = join_runs(np.array(loc, np.int64), np.array(first, np.int64), np.ones(len(loc), np.int64))
        idx, place = packed(f, c)
        return np.array(loc, np.int64)[at][idx], place

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States: 0 undecided, 1 decided, 2 undecided and known to repeat, 3 a mark (``first`` is its place)."""
        held: dict[bytes, list[tuple[int, int, int, bool]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            loc, first = [], []
            for g, rows in held.items():
                rows.sort()
                low = rows[0][0]
                for k, (doc, at, f, undecided) in enumerate(rows):
                    if (doc > low if earlier else len(rows) > 1) and undecided:
                        loc.append(at)
                        first.append(f)
                    if not k or earlier and doc == low and undecided:
                        # what is marked here goes on as decided; others must learn that it repeats
                        state = 1 if not undecided or not earlier and len(rows) > 1 else 0
                        out.append((g, doc, at, f, state))
            held.clear()
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), *[pa.int64()] * 3, pa.int32()))], names)
            if loc:
                at, place = marks(loc, first)
                yield pa.record_batch([pa.array([int(x).to_bytes(8, "little", signed=True) for x in at], pa.binary()), pa.array(at), pa.array(at), pa.array(place), pa.array(np.full(len(at), 3, np.int32))], names)

        for b in batches:
            for doc, at, f, undecided, body in zip(*(b.column(i).to_pylist() for i in range(5))):
                for n, w in enumerate(split(body)):
                    held.setdefault(hashlib.blake2b(w, digest_size=16).digest(), []).append((doc, at, f + n, undecided))
                    size += 1
            if size > 200_000:
                yield from flush()
                size = 0
        yield from flush()

    rows = segments_.select("doc", "loc", "first", "undecided", "body").mapInArrow(spread, schema)
    rows = rows.repartition("digest").sortWithinPartitions("digest", "doc", "loc", "first")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lowest, wait = None, 0, None
        for b in batches:
            loc, first, ready = [], [], []
            for g, d, at, f, state in zip(*(b.column(i).to_pylist() for i in range(5))):
                if state == 3:
                    ready.append((at, f))
                elif g != last:
                    last, lowest, wait = g, d, (at, f) if state == 0 else None
                else:
                    if not earlier and wait is not None:
                        loc.append(wait[0])
                        first.append(wait[1])
                        wait = None
                    if state == 0 and (not earlier or d > lowest):
                        loc.append(at)
                        first.append(f)
            at, place = marks(loc, first)
            if ready:
                at, place = np.append(at, [x for x, _ in ready]), np.append(place, [x for _, x in ready])
            if len(at):
                yield pa.record_batch([pa.array(at), pa.array(place)], ["loc", "place"])

    return rows.mapInArrow(merge, "loc long, place long")


def chunks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Whole buckets (first column), together about ``limit`` bytes of bodies (last column), of
    batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= limit:
            bucket = batch.column(0).to_numpy()
            border = np.flatnonzero(np.concatenate([[held[-1].column(0)[-1].as_py() != bucket[0]], bucket[1:] != bucket[:-1]]))
            if len(border):
                if border[0]:
                    held.append(batch.slice(0, border[0]))
                yield held
                held, size, batch = [], 0, batch.slice(border[0])
        held.append(batch)
        size += int(batch.column(batch.num_columns - 1).nbytes)
    if held:
        yield held


def places_of(rows: np.ndarray, index: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each of ``n`` documents that ``visit`` shows, without the headers' -1."""
    return [x[x >= 0] for x in np.split(rows[:, 1], np.searchsorted(index, np.arange(1, n)))]


def covered(place: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs (start, stop) of symbols that the marked windows cover."""
    if not len(place):
        return []
    place = np.unique(place)
    first = place >> SHIFT
    stop = first + (place & LIMIT) + length - 1
    top = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > top[:-1]]))
    return list(zip(first[new].tolist(), np.maximum.reduceat(stop, new).tolist()))
