"""Operator 10: line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: first by their number of tokens, then by their
leading tokens, with variable fields (tokens with digits, addresses) generalised to ``<*>``.
In a leaf, lines join the template that agrees with them in at least ``similarity`` of their
tokens, most frequent lines first, and positions that differ become ``<*>``. Of the lines of
a template that occurs in ``min_docs`` documents or more, the first (smallest doc_id, then
line number) stays and all others are dropped.

A task sends each generalised line once per flush with its count of documents, so a line
that stands in a third of all documents sends few rows to its leaf. A leaf with more than
``HOT`` different lines isn't held in memory: its lines stream past an index of its templates
(``HotLeaf``), which gives the same templates; two numbers a line are held, and the templates.

Null texts count as empty: no lines, nothing dropped. Lines without a token are never
dropped. Equal rows count as two documents. A null doc_id counts as the largest. Extra
columns are kept by ``drop_template_lines``.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.llm.common import BATCH_ROWS, arrow_map, cut, limit_batches
from tabulae.llm.repeat_core import keyed

VARIABLE = re.compile(r"\d|@|://")
HOT = 2000
FLUSH_BYTES = 8_000_000
DEPTH = 3


def generalise(line: str) -> str:
    """The line's tokens, variable ones as ``<*>``, joined by one space; empty without tokens."""
    if VARIABLE.search(line):
        return " ".join(["<*>" if VARIABLE.search(t) else t for t in line.split()])
    return " ".join(line.split())


def leaf_of(general: str, depth: int) -> int:
    head = general.split(" ", depth)[:depth]
    return _signed(f"{general.count(' ') + 1} {' '.join(head)}")


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def cluster(lines: list[tuple[str, int]], similarity: float) -> list[tuple[str, list[str], int]]:
    """(template, its lines, documents at most) of the lines of one leaf, with their counts."""
    lines = sorted(lines, key=lambda x: (-x[1], x[0]))
    names: dict[str, int] = {"<*>": -1}
    rows = np.array([[names.setdefault(t, len(names)) for t in line.split(" ")] for line, _ in lines], np.int64)
    if len(lines) == 1:
        return [(lines[0][0], [lines[0][0]], lines[0][1])]
    templates = np.empty_like(rows)
    members: list[list[int]] = []
    need = similarity * rows.shape[1]
    for i, row in enumerate(rows):
        if members:
            same = (templates[: len(members)] == row).sum(1)
            best = int(same.argmax())
            if same[best] >= need:
                templates[best][templates[best] != row] = -1
                members[best].append(i)
                continue
        templates[len(members)] = row
        members.append([i])
    words = {v: k for k, v in names.items()}
    return [(" ".join(words[t] for t in templates[k].tolist()), [lines[i][0] for i in own], sum(lines[i][1] for i in own)) for k, own in enumerate(members)]


class HotLeaf:
    """``cluster`` for lines that come in its order, without holding them.

    A line that joins a template differs from it in at most ``apart`` positions, so of
    ``apart + 1`` ranges of positions one agrees as a whole: only templates that share a range
    are compared. The leading ``depth`` tokens of a leaf are equal and in no range."""

    def __init__(self, width: int, similarity: float, depth: int = 0) -> None:
        self.need = similarity * width
        apart = max(0, width - math.ceil(self.need))
        # with too few positions that can differ, all templates share the empty range
        n = min(apart + 1, max(1, width - depth))
        self.edges = [0] if apart >= width - min(depth, width) else [depth + round((width - depth) * k / n) for k in range(n + 1)]
        self.names: dict[str, int] = {"<*>": -1}
        self.index: dict[tuple[int, bytes], list[int]] = {}
        self.templates = np.empty((64, width), np.int32)
        self.docs: list[int] = []
        self.lines, self.owner = array("q"), array("q")

    def _ranges(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(k, row[a:b].tobytes()) for k, (a, b) in enumerate(zip(self.edges, self.edges[1:]))] or [(0, b"")]

    def add(self, line: str, n: int) -> None:
        names = self.names
        row = np.array([names.setdefault(t, len(names)) for t in line.split(" ")], np.int32)
        ranges = self._ranges(row)
        near = [x for r in ranges if (x := self.index.get(r))]
        if near:
            at = np.array(near[0] if len(near) == 1 else sorted(set().union(*near)), np.int64)
            same = (self.templates[at] == row).sum(1)
            most = same.max()
            # of the best the oldest
            best = int(at[same == most].min())
            if most >= self.need:
                template = self.templates[best]
                if most < len(row):
                    before = self._ranges(template)
                    template[template != row] = -1
                    for old, new in zip(before, self._ranges(template)):
                        if old != new:
                            self.index[old].remove(best)
                            if not self.index[old]:
                                del self.index[old]
                            self.index.setdefault(new, []).append(best)
                return self._own(best, line, n)
        own = len(self.docs)
        if own == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
        self.templates[own] = row
        self.docs.append(0)
        for r in ranges:
            self.index.setdefault(r, []).append(own)
        self._own(own, line, n)

    def _own(self, template: int, line: str, n: int) -> None:
        self.docs[template] += n
        self.lines.append(_signed(line))
        self.owner.append(template)

    def groups(self, min_docs: int) -> Iterator[tuple[str, np.ndarray]]:
        """(template, hashes of its lines) of the templates that can reach ``min_docs`` documents."""
        words = {v: k for k, v in self.names.items()}
        lines, owner = np.array(self.lines, np.int64), np.array(self.owner, np.int64)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(self.docs)))
        for k, n in enumerate(self.docs):
            if n >= min_docs:
                yield " ".join(words[t] for t in self.templates[k].tolist()), lines[order[ends[k - 1] if k else 0 : ends[k]]]


def templates(docs: DataFrame, min_docs: int, similarity: float, depth: int = DEPTH) -> DataFrame:
    """(line, template): hashes of generalised lines of templates that can reach ``min_docs``.
    ``docs`` is ``keyed``."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            lines = list(held)
            out = pa.record_batch([pa.array([leaf_of(x, depth) for x in lines], pa.int64()), pa.array(lines, pa.string()), pa.array(list(held.values()), pa.int64())], ["leaf", "line", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in set(map(generalise, text.split("\n"))):
                    if line:
                        if line not in held:
                            size += len(line) + 100
                        held[line] = held.get(line, 0) + 1
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    limit_batches(docs.sparkSession, BATCH_ROWS)
    rows = docs.select("text").mapInArrow(leaves, "leaf long, line string, n long")
    # the sum needs no exchange of its own: equal lines share their leaf
    rows = rows.repartition("leaf").groupBy("leaf", "line").agg(F.sum("n").alias("n"))
    rows = rows.sortWithinPartitions("leaf", F.desc("n"), "line")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf: int | None = None
        held: list[tuple[str, int]] = []
        hot: HotLeaf | None = None  # too many lines in this leaf
        out: list[tuple[int, int]] = []

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal hot
            if hot is not None:
                for template, own in hot.groups(min_docs):
                    name = _signed(f"{leaf} {template}")
                    out.extend((x, name) for x in own.tolist())
                    if len(out) > 10_000:
                        yield rows_out()
            elif sum(n for _, n in held) >= min_docs:
                for template, own, n in cluster(held, similarity):
                    if n >= min_docs:
                        name = _signed(f"{leaf} {template}")
                        out.extend((_signed(x), name) for x in own)
            held.clear()
            hot = None

        def rows_out() -> pa.RecordBatch:
            a = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.record_batch([pa.array(a[:, 0]), pa.array(a[:, 1])], ["line", "template"])

        for batch in batches:
            for k, line, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != leaf:
                    yield from end()
                    leaf = k
                if hot is not None:
                    hot.add(line, n)
                    continue
                held.append((line, n))
                if len(held) > HOT:
                    hot = HotLeaf(line.count(" ") + 1, similarity, min(depth, line.count(" ") + 1))
                    for x in held:
                        hot.add(*x)
                    held.clear()
            if len(out) > 10_000:
                yield rows_out()
        yield from end()
        yield rows_out()

    return rows.mapInArrow(parse, "line long, template long")


def dropped_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.8, depth: int = DEPTH) -> DataFrame:
    """(doc, key, lines): the numbers of each document's lines to drop. ``docs`` is ``keyed``."""
    found = cut(templates(docs, min_docs, similarity, depth), "templates")

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, number = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            for k, line in enumerate(text.split("\n")):
                if general := generalise(line):
                    hashes.append(_signed(general))
                    row.append(i)
                    number.append(k)
        at = np.array(row, np.int64)
        return pa.record_batch([pa.array(hashes, pa.int64()), pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]), pa.array(number, pa.int32())], ["line", "doc", "key", "number"])

    every = arrow_map(docs.select("doc", "key", "text"), lines, "line long, doc long, key long, number int")
    uses = cut(every.join(found, "line").select("template", "doc", "key", "number"), "uses")
    # a document counts once; the smallest place stays
    first = uses.groupBy("template", "doc", "key").agg(F.min("number").alias("number")).groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "key", "number")).alias("first"))
    uses = uses.join(first.filter(F.col("docs") >= min_docs), "template")
    same = (F.col("doc") == F.col("first.doc")) & (F.col("key") == F.col("first.key")) & (F.col("number") == F.col("first.number"))
    return uses.filter(~same).groupBy("doc", "key").agg(F.collect_set("number").alias("lines"))


def _kept(text: str, drop: list[int] | None) -> list[str]:
    lines = text.split("\n")
    if not drop:
        return lines
    gone = set(drop)
    return [line for k, line in enumerate(lines) if k not in gone]


def line_dedup(docs: DataFrame, min_docs: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_lines (with a token), n_dropped, kept_sha256 of each document."""
    docs = keyed(docs)
    rows = docs.join(dropped_lines(docs, min_docs, similarity), ["doc", "key"], "left")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone, digests = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts.append(sum(1 for x in text.split("\n") if x.strip()))
            gone.append(len(drop or ()))
            digests.append(hashlib.sha256("\n".join(_kept(text, drop)).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return arrow_map(rows.select("doc_id", "text", "lines"), finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_template_lines(docs: DataFrame, min_docs: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the lines dropped from ``text`` and ``n_chars`` counted again, without
    the documents that had words and lost them all."""
    key = keyed(docs).select("doc", "key", "text")
    drop = dropped_lines(key, min_docs, similarity)
    named = docs.withColumn("__llm_doc", F.coalesce(docs["doc_id"], F.lit((1 << 63) - 1)).cast("long"))
    named = named.withColumn("__llm_key", F.xxhash64("__llm_doc", F.coalesce(docs["text"], F.lit(""))))
    rows = named.join(drop.select(F.col("doc").alias("__llm_doc"), F.col("key").alias("__llm_key"), F.col("lines").alias("__llm_lines")), ["__llm_doc", "__llm_key"], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("__llm_lines", k)), "\n")
    rows = rows.withColumn("text", F.when(F.col("__llm_lines").isNull(), F.col("text")).otherwise(left))
    rows = rows.filter(F.col("__llm_lines").isNull() | F.col("text").rlike("\\S"))
    cols = [F.when(F.col("__llm_lines").isNull(), F.col(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*cols)
