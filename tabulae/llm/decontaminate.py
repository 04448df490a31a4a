"""Operator 6: benchmark decontamination with a BM25 index of the test items and block-max
WAND.

The index holds the test items, which are few; ``MAX_ITEMS`` bounds what is collected and
sent to the workers at once, and a larger benchmark is taken in blocks of that size, one pass each.
Document frequencies, the number of items and their mean length are counted over all items first,
so scores, and with them results, are the same for any size of block.
Every passage of every document is a query: windows of twice the longest item's words, each
beginning in the middle of the one before, so that any item stands whole in some passage.
An item's score is its share of the BM25 score that it has for itself, so one threshold
suits all items. Passages whose terms' largest impacts, in each range of items, add up to less than
the threshold are skipped at once; the others go through the posting lists with WAND's
pivots and the blocks' own largest impacts. All items above the threshold are retrieved and then verified: of the
item's question and, where it marks one with "Answer:", of its answer too, at least
``overlap`` of the five-word shingles stand in the passage; of a part under ten words, where a
changed word would cost too many shingles, at least that share of the words in one place.

Words are runs of letters and digits in lower case. Null and empty texts and items match
nothing. Repeated rows match alike; equal items match all together; a document without a doc_id
is searched as others and, in ``decontaminate``, goes if it holds an item. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.llm.common import arrow_map, cut, only

MAX_ITEMS = 20_000
BLOCK = 8
GRID = 64
WORD = re.compile(r"[^\W_]+")
#: Parts with fewer words are compared by words instead of shingles.
SHORT = 10


def split_item(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer; an item that marks none has no answer."""
    head, mark, tail = text.rpartition("Answer:")
    if not mark:
        head, tail = text, ""
    return WORD.findall(head.lower()), WORD.findall(tail.lower())


def words_in_place(part: list[str], words: list[str]) -> float:
    """The largest share of the part's words, repeats included, that stand in one window of the
    passage, a quarter longer than the part."""
    left, span = Counter(part), math.ceil(len(part) * 1.25)
    shared = best = 0
    for k, w in enumerate(words):
        left[w] -= 1
        shared += left[w] >= 0
        if k >= span:
            gone = words[k - span]
            left[gone] += 1
            shared -= left[gone] > 0
        best = max(best, shared)
    return best / len(part)


def shingles(words: list[str], size: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


class ItemIndex:
    """BM25 postings of the items, as shares of each item's own score. ``df`` (items with a term),
    ``count`` and ``mean`` are those of all items; without them ``items`` are all."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float, df: dict[str, int] | None = None, count: int = 0, mean: float = 0.0, k1: float = 1.2, b: float = 0.75) -> None:
        self.threshold, self.overlap = threshold, overlap
        self.ids, self.parts, bags = [], [], []
        for item, text in sorted(items, key=lambda x: (x[0], x[1])):
            question, answer = split_item(text)
            if question or answer:
                self.ids.append(item)
                self.parts.append([(p if len(p) < SHORT else shingles(p, 5)) for p in (question, answer) if p])
                bags.append(Counter(question + answer))
        sizes = [sum(x.values()) for x in bags]
        self.longest = max(sizes, default=0)
        if df is None:
            df, count, mean = Counter(t for x in bags for t in x), len(bags), sum(sizes) / len(sizes) if sizes else 1
        self.postings: dict[str, tuple[list[int], list[float], list[float]]] = {}
        for k, bag in enumerate(bags):
            raw = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * sizes[k] / mean)) for t, n in bag.items()}
            total = sum(raw.values())
            for t, s in raw.items():
                ids, scores, _ = self.postings.setdefault(t, ([], [], []))
                ids.append(k)
                scores.append(s / total)
        for ids, scores, blocks in self.postings.values():
            blocks += [max(scores[i : i + BLOCK]) for i in range(0, len(scores), BLOCK)]
        # the most frequent terms together are worth at most ``rest`` to any item; an item above the
        # threshold must earn what is left of it from the others, so WAND walks only their lists
        self.common: dict[str, dict[int, float]] = {}
        shares = np.zeros(len(bags))
        for t in sorted(self.postings, key=lambda t: (-len(self.postings[t][0]), t)):
            ids, scores, _ = self.postings[t]
            more = shares.copy()
            more[ids] += scores
            if len(ids) < 2 or more.max() > threshold * 0.6:
                break
            shares = more
            self.common[t] = dict(zip(ids, scores))
        self.rest = float(shares.max()) if len(shares) else 0.0
        self.need = threshold - self.rest - 1e-9
        # largest impacts in at most ``GRID`` ranges of items: one row a term, row 0 for no term
        width = -(-len(bags) // GRID) if bags else 1
        rare = [t for t in self.postings if t not in self.common]
        self.row = {t: k for k, t in enumerate(rare, 1)}
        self.grid = np.zeros((len(rare) + 1, GRID))
        for t, k in self.row.items():
            np.maximum.at(self.grid[k], np.array(self.postings[t][0]) // width, self.postings[t][1])
        self.most = {t: max(p[2]) for t, p in self.postings.items() if t not in self.common}

    def retrieve(self, terms: set[str]) -> list[tuple[int, float]]:
        """All items whose score for these terms reaches the threshold, by block-max WAND."""
        need = self.need
        lists = [(*self.postings[t], self.most[t]) for t in sorted(terms & self.most.keys())]
        frequent = [self.common[t] for t in sorted(terms & self.common.keys())]
        at = [0] * len(lists)
        found = []
        while True:
            live = sorted((lists[i][0][at[i]], i) for i in range(len(lists)) if at[i] < len(lists[i][0]))
            bound, pivot = 0.0, None
            for n, (doc, i) in enumerate(live):
                bound += lists[i][3]
                if bound >= need:
                    pivot = n
                    break
            if pivot is None:
                return found
            doc = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
                pivot += 1
            tight, border = 0.0, 1 << 60
            for _, i in live[: pivot + 1]:
                ids = lists[i][0]
                k = bisect_left(ids, doc, at[i])
                if k < len(ids):
                    tight += lists[i][2][k // BLOCK]
                    end = (k // BLOCK + 1) * BLOCK
                    border = min(border, ids[end - 1] + 1 if end <= len(ids) else 1 << 60)
            if tight < need:
                # no item up to the nearest block's end can reach the threshold with these lists
                target = max(doc + 1, min(border, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60))
            elif live[0][0] == doc:
                score = sum(lists[i][1][at[i]] for d, i in live[: pivot + 1])
                score += sum(c.get(doc, 0.0) for c in frequent)
                if score >= self.threshold - 1e-9:
                    found.append((doc, score))
                target = doc + 1
            else:
                target = doc
            for _, i in live[: pivot + 1]:
                at[i] = bisect_left(lists[i][0], target, at[i])

    def verify(self, item: int, words: list[str]) -> float:
        """The smaller of the question's and the answer's shares found in the passage."""
        return min(words_in_place(p, words) if isinstance(p, list) else len(p & shingles(words, 5)) / len(p) for p in self.parts[item])

    def search(self, text: str) -> dict[int, tuple[int, float, float]]:
        """Verified items of a text, each with its best (passage's first word, score, overlap)."""
        words = WORD.findall(text.lower())
        if not words or not self.ids:
            return {}
        rows = np.fromiter(map(self.row.get, words, repeat(0)), np.int32, len(words))
        places = np.flatnonzero(rows)
        size = 2 * self.longest
        first = np.arange(0, max(1, len(words) - self.longest), self.longest)
        total = np.zeros((len(places) + 1, GRID))
        np.cumsum(self.grid[rows[places]], axis=0, out=total[1:])
        low, high = np.searchsorted(places, first), np.searchsorted(places, first + size)
        bound = (total[high] - total[low]).max(1)
        found: dict[int, tuple[int, float, float]] = {}
        for at in first[bound >= self.need - 1e-6].tolist():
            passage = words[at : at + size]
            terms = set(passage)
            if sum(self.most.get(t, 0.0) for t in terms) < self.need - 1e-6:
                continue
            for item, score in self.retrieve(terms):
                share = self.verify(item, passage)
                if share >= self.overlap - 1e-9 and (item not in found or found[item][1:] < (score, share)):
                    found[item] = (at, score, share)
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, word, score, overlap): each item that a document holds, once."""
    items = only(benchmark, "item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    bags = cut(_bags(items), "items")
    n, words = bags.agg(F.count("*"), F.sum("size")).first()
    out = None
    blocks = max(1, -(-n // MAX_ITEMS))
    frequencies = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(blocks):
        block = bags.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = block.select("item_id", "text").collect()
        # of all terms only those of the block, which is bounded, are collected
        own = block.select(F.explode("terms").alias("term")).distinct()
        df = {r.term: r.df for r in frequencies.join(own, "term").collect()}
        part = _search(docs, ItemIndex([(r.item_id, r.text) for r in rows], threshold, overlap, df, n, (words or 0) / max(n, 1)))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "overlap", F.negative("word").alias("word"))).alias("x")).select("doc_id", "item_id", F.negative("x.word").alias("word"), F.round("x.score", 9).alias("score"), F.round("x.overlap", 9).alias("overlap"))


def _bags(items: DataFrame) -> DataFrame:
    """(item_id, text, size, terms) of the items with a word."""

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [sum(split_item(t), []) for t in batch.column(1).to_pylist()]
        out = pa.record_batch([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["item_id", "text", "size", "terms"])
        return out.filter(pa.array([bool(w) for w in words], pa.bool_()))

    return arrow_map(items.select(F.col("item_id").cast("long"), "text"), bags, "item_id long, text string, size long, terms array<string>")


def _search(docs: DataFrame, index: ItemIndex) -> DataFrame:
    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for item, (word, score, share) in index.search(text or "").items():
                for col, v in zip(out, (doc, index.ids[item], word, score, share)):
                    col.append(v)
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "item_id", "word", "score", "overlap"])

    return arrow_map(only(docs, "doc_id", "text"), find, "doc_id long, item_id long, word long, score double, overlap double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    hits = contaminated(docs, benchmark, threshold, overlap).select(F.col("doc_id").alias("__llm_hit")).distinct()
    named = docs.filter(docs["doc_id"].isNotNull())
    kept = named.join(hits, named["doc_id"] == hits["__llm_hit"], "left_anti")
    # documents without an id, an error of the source, are told apart by a hash of their texts
    nameless = docs.filter(docs["doc_id"].isNull())
    texts = nameless.select(F.xxhash64("text").alias("doc_id"), "text")
    hits = contaminated(texts, benchmark, threshold, overlap).select(F.col("doc_id").alias("__llm_hit")).distinct()
    return kept.unionByName(nameless.join(hits, F.xxhash64(nameless["text"]) == hits["__llm_hit"], "left_anti"))
