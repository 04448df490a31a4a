"""Operator 5: SimHash near-duplicate groups by tiled exact comparison.

Equal fingerprints are one node. Two that differ in at most ``radius`` bits agree on at
least ``blocks - radius`` of ``blocks`` bit ranges, so nodes are compared only within
buckets of equal ranges, which loses no pair. Within a bucket, fingerprints are sorted by
population count and cut into tiles; two tiles are compared with numpy exclusive-or and
bit counts, unless their population counts differ by more than the radius everywhere.
A bucket gives the edges of a spanning forest only, never all pairs of a group. Buckets with
more than ``HOT`` nodes are split into pairs of chunks, each a task row of its own.

The number of blocks follows from that of the nodes (``blocks_for``): n different texts give about
n / 2^key nodes a bucket, where key is the number of bits in ``blocks - radius`` ranges.

``keep_one_of_each`` links by the fingerprints alone. ``keep_one_of_near_copies``, the pipeline's
stage, takes them and bands of minimal shingle hashes as candidates only, and links what shares
``similarity`` of its distinct shingles, counted exactly.

Null and empty texts, and texts without words, have fingerprint zero and link like others.
Repeated rows (the same doc_id) share their component. Ties take the smallest doc_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.llm.common import arrow_map, cut, limit_batches, only
from tabulae.llm.components import components
from tabulae.llm.repeat_core import keyed

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
TILE = 1024
HOT = 4096
#: Two sets of Jaccard similarity j share none of the bands with probability (1 - j**BAND)**BANDS,
#: 5e-8 at 0.8.
BANDS, BAND = 32, 4
_FACTORS = np.random.default_rng(64).integers(0, 1 << 32, (BANDS * BAND, 1), np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of all shingles, repeats included; a text of fewer words is one shingle."""
    words = [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(ones * 2 > len(hashes)).tolist())


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bits set in more than half of the hashes of all shingles, repeats included."""
    return _majority(shingle_hashes(text, shingle))


def bands(distinct: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of hashes: each of ``BAND`` smallest products."""
    least = np.full(BANDS * BAND, (1 << 32) - 1, np.uint32)
    low = (distinct >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (_FACTORS * low[at : at + 4096]).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(only(docs, "doc_id", "text"), one, "doc_id long, fp long")


def near_pairs(fps: np.ndarray, radius: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links among different fingerprints.

    With ``split`` the first ``split`` of them are compared with the others only."""
    n = len(fps)
    pop = np.bitwise_count(fps).astype(np.int16)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                a_out.append(a)
                b_out.append(b)

    a_out: list[int] = []
    b_out: list[int] = []
    if split is None:
        left = right = np.argsort(pop, kind="stable")
    else:
        left, right = np.argsort(pop[:split], kind="stable"), split + np.argsort(pop[split:], kind="stable")
    for i in range(0, len(left), TILE):
        rows = left[i : i + TILE]
        for j in range(i if split is None else 0, len(right), TILE):
            cols = right[j : j + TILE]
            if pop[cols[0]] - pop[rows[-1]] > radius:
                break
            if pop[rows[0]] - pop[cols[-1]] > radius:
                continue
            near = np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius
            if split is None and i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            # first one link a column; then only pairs that are still apart are looked at
            hit = np.flatnonzero(near.any(0))
            union(rows[near[:, hit].argmax(0)], cols[hit])
            near &= np.array([root(r) for r in rows.tolist()])[:, None] != np.array([root(c) for c in cols.tolist()])[None, :]
            x, y = np.nonzero(near)
            union(rows[x], cols[y])
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def blocks_for(n: int, radius: int) -> int:
    """The fewest bit ranges with which ``n`` fingerprints give about a thousand a bucket at most."""
    blocks = radius + 2
    while blocks < 2 * radius and 64 * (blocks - radius) // blocks < n.bit_length() - 10:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that connect all that are within
    ``radius`` bits of each other. The number of bit ranges follows from that of the nodes; it
    changes what is compared, never what is found."""
    blocks = blocks or blocks_for(nodes.count(), radius)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("k")))
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", F.col("key.n").alias("n"), F.col("key.k").alias("k"))
    sizes = rows.groupBy("n", "k").agg(F.count("*").alias("m"))
    # few buckets are hot; their nodes are cut into chunks by hash, and each pair of chunks is a bucket
    hot = sizes.filter(F.col("m") > HOT).select("n", "k", F.ceil(F.col("m") * 2 / HOT).cast("int").alias("chunks"))
    rows = rows.join(sizes.filter("m > 1"), ["n", "k"]).join(hot.drop("m"), ["n", "k"], "left")
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = rows.select("fp", "n", "k", F.coalesce("chunks", F.lit(1)).alias("chunks"), chunk.alias("c"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("c", o).alias("c1"), F.greatest("c", o).alias("c2")))
    rows = rows.select("fp", "n", "k", "c", F.explode(pair).alias("p")).select("n", "k", "p.c1", "p.c2", "c", "fp")
    limit_batches(nodes.sparkSession, 20_000)
    rows = rows.repartition("n", "k", "c1", "c2").sortWithinPartitions("n", "k", "c1", "c2", "c", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch | None:
            group = np.concatenate(held)
            held.clear()
            fps = group["fp"].view(np.uint64)
            split = None
            if group["c1"][0] != group["c2"][0]:
                split = int(np.searchsorted(group["c"], group["c2"][0]))
                if split in (0, len(fps)):
                    return None
            a, b = near_pairs(fps, radius, split)
            if not len(a):
                return None
            return pa.record_batch([pa.array(group["fp"][a]), pa.array(group["fp"][b])], ["a", "b"])

        names = ["n", "k", "c1", "c2", "c", "fp"]
        kind = np.dtype([(x, np.int64) for x in names])
        for batch in batches:
            if not batch.num_rows:
                continue
            rec = np.empty(batch.num_rows, kind)
            for x in names:
                rec[x] = batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False)
            key = rec[["n", "k", "c1", "c2"]]
            starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(rec)]
            for s, e in zip(starts, starts[1:]):
                if held and held[-1][["n", "k", "c1", "c2"]][-1] != key[s] and (out := flush()) is not None:
                    yield out
                held.append(rec[s:e])
        if held and (out := flush()) is not None:
            yield out

    return rows.mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    fps = cut(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # components carry fingerprints; a component's id is the smallest doc_id of its nodes
    found = components(links(nodes.select("fp"), radius, blocks), "a", "b")
    named = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, fp, node (a hash of the distinct shingles), size (their number), bands.
    ``docs`` is ``keyed``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, sizes, keys = [], [], [], []
        for text in batch.column(2).to_pylist():
            hashes = shingle_hashes(text, shingle)
            distinct = np.unique(hashes)
            fps.append(_majority(hashes))
            nodes.append(xxhash.xxh64_intdigest(distinct.tobytes()))
            sizes.append(len(distinct))
            keys.append(bands(distinct).view(np.int64) if len(distinct) else np.zeros(0, np.int64))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.record_batch([batch.column(0), batch.column(1), signed(fps), signed(nodes), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "node", "size", "bands"])

    return arrow_map(docs.select("doc_id", "key", "text"), one, "doc_id long, key long, fp long, node long, size long, bands array<long>")


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have Jaccard ``similarity`` or more."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer() or b"", np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), judge, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = 0.8, radius: int = 4, shingle: int = 5, blocks: int | None = None) -> DataFrame:
    """doc_id, component_id of every document: components of the pairs that share ``similarity``
    of their distinct shingles.

    First each node meets the smallest one of its buckets; then the nodes of a bucket that are
    not connected by that meet each other, so large groups of copies give few pairs."""
    docs = keyed(docs)
    sets = cut(shingle_sets(docs, shingle), "sets")
    nodes = cut(sets.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("key").alias("key"), F.min("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    ends = links(heads.select("fp"), radius, blocks)
    ends = ends.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b").select("u", "v")
    ends = ends.unionByName(nodes.join(heads, "fp").select(F.col("node").alias("u"), F.col("head").alias("v")))
    rows = nodes.select("node", "size", F.explode("bands").alias("band"))
    rows = cut(rows.join(rows.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1"), "band").select("band", "node", "size", "head"), "bands")
    ends = ends.unionByName(rows.select(F.col("node").alias("u"), F.col("head").alias("v")))
    pairs = cut(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a <> b").distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "key"), "node")

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "body"])

    texts = docs.select("key", "text").join(asked, "key").select("node", "text")
    # equal rows give their body once each
    bodies = cut(arrow_map(texts, body, "node long, body binary"), "bodies").dropDuplicates(["node"])
    linked = cut(_verified(pairs, bodies, similarity), "linked")
    known = components(linked, "a", "b")
    rows = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = cut(rows.join(rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band"), "band").select("band", "node", "size", "component"), "apart")
    other = rows.select("band", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b"))
    apart = rows.join(other, "band").filter("component < component_b").filter(F.least("size", "size_b") >= F.greatest("size", "size_b") * similarity - 1e-9)
    apart = apart.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    found = components(linked.unionByName(_verified(apart, bodies, similarity)), "a", "b")
    named = nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    return sets.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 5, blocks: int | None = None) -> DataFrame:
    """``docs`` with one document of each group: the row of its component's smallest doc_id.
    Of rows that share that doc_id the one with the smallest text hash stays. Rows without a
    doc_id are kept. Only fingerprints and ids are shuffled to find the groups."""
    return _first_of_each(docs, simhash_components(docs, radius, shingle, blocks))


def keep_one_of_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of ``near_copies``, as ``keep_one_of_each``."""
    return _first_of_each(docs, near_copies(docs, similarity, shingle=shingle))


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__llm_keep")).distinct()
    rows = docs.join(keep, docs["doc_id"] == keep["__llm_keep"], "left_semi")
    # rows that share a doc_id are an error of the source: of those the first by its text stays
    first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("__llm_row", F.row_number().over(first)).filter("__llm_row = 1").select(docs.columns)
    return rows.unionByName(docs.filter(docs["doc_id"].isNull()))
