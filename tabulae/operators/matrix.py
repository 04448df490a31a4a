"""Matrices of a vocabulary or a set of sites: correspondence analysis, dendrograms, seriation, label
propagation, embeddings and their rotation, trees. Counts are aggregated in Spark; what the
algebra then needs is a matrix of labels, not of documents. Its size is checked (``small``)
before it goes to the driver, and a larger one is refused."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.operators.resampling import generator

CELLS = 4_000_000


def small(counts: DataFrame, row: str, col: str, n: str = "n") -> tuple[list, list, np.ndarray]:
    """Labels in order and the dense matrix of summed counts, if it has at most ``CELLS`` cells."""
    rows = counts.groupBy(row, col).agg(F.sum(n).alias("v")).filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    # counted and collected in one run: a matrix that is small has no more filled cells than cells
    cells = rows.limit(CELLS + 1).collect()
    a, b = sorted({x[0] for x in cells}), sorted({x[1] for x in cells})
    if len(a) * len(b) > CELLS or len(cells) > CELLS:
        raise ValueError(f"{len(a)} x {len(b)} labels or more are more than {CELLS} cells: aggregate or filter them first")
    at, bt = {x: k for k, x in enumerate(a)}, {x: k for k, x in enumerate(b)}
    out = np.zeros((len(a), len(b)))
    for r, c, v in cells:
        out[at[r], bt[c]] = v
    return a, b, out


def _axis(square: np.ndarray, known: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """The largest eigenvalue beside the known vectors', by 300 steps from a fixed start."""
    m = len(square)
    v, value = 1 + np.arange(1, m + 1) / m, 0.0
    for _ in range(300):
        for u in known:
            v = v - (v @ u) * u
        v = square @ v
        value = float(np.linalg.norm(v))
        if value < 1e-12:
            return None
        v = v / value
    return value, v


def correspondence_analysis(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame | None:
    """(side, label, x, y, mass, inertia_x, inertia_y): principal coordinates on the first two axes of
    the standardised residuals. None below three rows or columns."""
    a, b, m = small(counts, row, col, n)
    if min(m.shape) < 3 or m.sum() <= 0:
        return None
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    if (r == 0).any() or (c == 0).any():
        return None
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    total = float((s * s).sum())
    if total < 1e-12 or (first := _axis(s.T @ s, [])) is None:
        return None
    second = _axis(s.T @ s, [first[1]]) or (0.0, np.zeros(len(b)))
    axes, shares = [], []
    for value, v in (first, second):
        sigma = math.sqrt(max(0.0, value))
        u = s @ v / sigma if sigma > 1e-12 else np.zeros(len(a))
        axes.append((u / np.sqrt(r) * sigma, v / np.sqrt(c) * sigma))
        shares.append(value / total)
    out = [("row", str(x), float(axes[0][0][k]), float(axes[1][0][k]), float(r[k]), *shares) for k, x in enumerate(a)]
    out += [("col", str(x), float(axes[0][1][k]), float(axes[1][1][k]), float(c[k]), *shares) for k, x in enumerate(b)]
    return counts.sparkSession.createDataFrame(out, "side string, label string, x double, y double, mass double, inertia_x double, inertia_y double")


def _cosine_gaps(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(1))
    under = np.outer(norms, norms)
    return np.where(under > 0, 1 - np.divide(m @ m.T, under, out=np.zeros_like(under), where=under > 0), 1.0)


def _merges(m: np.ndarray) -> list[tuple[int, int, float, tuple[int, ...]]]:
    """Average linkage; ties take the pair that stands first."""
    n = len(m)
    gap = {(i, j): d for i, row in enumerate(_cosine_gaps(m)) for j, d in enumerate(row.tolist()) if i < j}
    own = {k: (k,) for k in range(n)}
    live, out = list(range(n)), []
    pair = lambda i, j: (i, j) if i < j else (j, i)
    while len(live) > 1:
        best, found = math.inf, None
        for x, i in enumerate(live):
            for j in live[x + 1 :]:
                if gap[pair(i, j)] < best - 1e-12:
                    best, found = gap[pair(i, j)], (i, j)
        if found is None:
            break
        a, b = found
        new, wa, wb = n + len(out), len(own[a]), len(own[b])
        own[new] = tuple(sorted(own[a] + own[b]))
        live = [k for k in live if k not in found]
        for k in live:
            gap[pair(k, new)] = (wa * gap[pair(a, k)] + wb * gap[pair(b, k)]) / (wa + wb)
        live.append(new)
        out.append((a, b, best, own[new]))
    return out


def upgma(counts: DataFrame, item: str, feature: str, n: str = "n", replicates: int = 100, seed: int = 42) -> DataFrame | None:
    """(step, a, b, height, members, support): average linkage of items by cosine over features, and
    the share of seeded feature bootstraps that have the same group. None below three items."""
    items, features, m = small(counts, item, feature, n)
    if len(items) < 3 or len(features) < 2:
        return None
    reference, draw, seen = _merges(m), generator(seed), Counter()
    for _ in range(replicates):
        sample = [int(draw() * len(features)) for _ in features]
        seen.update({x[3] for x in _merges(m[:, sample])})
    rows = [(k, a, b, float(h), ",".join(sorted(str(items[i]) for i in own)), 1.0 if len(own) == len(items) else seen[own] / replicates) for k, (a, b, h, own) in enumerate(reference)]
    return counts.sparkSession.createDataFrame(rows, "step int, a int, b int, height double, members string, support double")


def label_propagation(nodes: DataFrame, edges: DataFrame, seed: int = 7, rounds: int | None = None) -> DataFrame:
    """(node, community): weighted label propagation, node after node in a seeded order, ties to the
    smallest label; communities numbered by falling size. ``nodes`` (node), ``edges`` (source,
    target, weight); at most ``CELLS`` of each."""
    if nodes.count() > CELLS or edges.count() > CELLS:
        raise ValueError("label propagation in order takes a graph that fits the driver")
    order = sorted(r[0] for r in nodes.select("node").distinct().collect())
    label = {x: k for k, x in enumerate(order)}
    near: dict = defaultdict(list)
    for a, b, w in sorted(tuple(r) for r in edges.select("source", "target", "weight").collect()):
        if a in label and b in label and a != b:
            near[a].append((b, w))
            near[b].append((a, w))
    n, draw = len(order), generator(seed)
    for _ in range(max(50, min(n, 400_000 // n)) if rounds is None and n else rounds or 0):
        for i in range(n - 1, 0, -1):
            j = int(draw() * (i + 1))
            order[i], order[j] = order[j], order[i]
        moved = False
        for x in order:
            weight: dict[int, float] = defaultdict(float)
            for y, w in near[x]:
                weight[label[y]] += w
            if weight:
                best = min(weight, key=lambda k: (-weight[k], k))
                moved |= best != label[x]
                label[x] = best
        if not moved:
            break
    sizes = Counter(label.values())
    number = {old: k for k, old in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k)))}
    return nodes.sparkSession.createDataFrame([(x, number[k]) for x, k in sorted(label.items())], "node string, community int")


def seriate(counts: DataFrame, row: str, col: str, n: str = "n") -> DataFrame:
    """(place, label, block): rows in the order of the Fiedler vector of their Brainerd-Robinson
    similarity, block by connected block, each beginning with the smaller of its ends."""
    labels, _, m = small(counts, row, col, n)
    share = 100 * m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    similar = 200 - np.abs(share[:, None, :] - share[None, :, :]).sum(2)
    near = similar > 1e-9
    block = -np.ones(len(labels), int)
    for k in range(len(labels)):
        todo = [k] if block[k] < 0 else []
        for x in todo:
            if block[x] < 0:
                block[x] = k
                todo += np.flatnonzero(near[x] & (block < 0)).tolist()
    out = []
    for number, k in enumerate(dict.fromkeys(block.tolist())):
        own = np.flatnonzero(block == k)
        part = similar[np.ix_(own, own)] * (1 - np.eye(len(own)))
        vector = np.linalg.eigh(np.diag(part.sum(1)) - part)[1][:, min(1, len(own) - 1)]
        names = [str(labels[own[i]]) for i in np.argsort(np.round(vector, 12), kind="stable")]
        out += [(x, number) for x in (names if names[0] <= names[-1] else names[::-1])]
    return counts.sparkSession.createDataFrame([(k, x, b) for k, (x, b) in enumerate(out)], "place int, label string, block int")


def brainerd_robinson(counts: DataFrame, unit: str, kind: str, n: str = "n") -> DataFrame:
    """(a, b, similarity) of all pairs of units with themselves: 200 less the sum of differences of
    percentages, which is twice the sum of smaller ones, so only kinds that both have are joined."""
    total = counts.groupBy(unit).agg(F.sum(n).alias("t"))
    share = counts.groupBy(unit, kind).agg(F.sum(n).alias("v")).join(total, unit).select(unit, kind, (100.0 * F.col("v") / F.col("t")).alias("p"))
    left, right = share.select(F.col(unit).alias("a"), kind, F.col("p").alias("pa")), share.select(F.col(unit).alias("b"), kind, F.col("p").alias("pb"))
    found = left.join(right, kind).filter("a <= b").groupBy("a", "b").agg(F.round(2 * F.sum(F.least("pa", "pb")), 4).alias("similarity"))
    units = total.select(unit)
    every = units.select(F.col(unit).alias("a")).join(units.select(F.col(unit).alias("b")), F.col("a") <= F.col("b"))  # the result's own rows
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def sign_embeddings(words: DataFrame, dim: int = 50, window: int = 1) -> DataFrame:
    """(sign, vector): signs by their neighbours to either side and word edges: positive pointwise
    mutual information, its leading singular directions, unit length. ``words`` has (text, n)."""
    rows = words.filter(F.col("text").contains("-")).select("n", F.split("text", "-").alias("u"))
    # a word's contexts in one pass over the vocabulary: a sign's neighbours, and the edges it stands at
    edge = lambda place, name: F.array(F.struct(F.element_at("u", place).alias("sign"), F.lit(name).alias("context")))
    parts = [edge(1, "initial"), edge(-1, "final")]
    for step in [*range(-window, 0), *range(1, window + 1)]:
        name = f"{'L' if step < 0 else 'R'}{abs(step)}:"
        parts.append(F.transform("u", lambda x, i: F.struct(x.alias("sign"), F.concat(F.lit(name), F.get("u", i + step)).alias("context"))))  # noqa: B023
    found = rows.select("n", F.explode(F.concat(*parts)).alias("x")).select("x.*", "n").filter("context IS NOT NULL")
    signs, _, m = small(found, "sign", "context")
    total = m.sum()
    expected = np.outer(m.sum(1), m.sum(0)) / total if total else m
    ppmi = np.maximum(0, np.log2(np.divide(m, expected, out=np.ones_like(m), where=m > 0)))
    u, s, vt = np.linalg.svd(ppmi, full_matrices=False)
    k = min(dim, len(s))
    # a direction's sign is fixed by its largest context
    flip = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)]) if k else np.zeros(0)
    vectors = u[:, :k] * s[:k] * np.where(flip == 0, 1, flip)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    return words.sparkSession.createDataFrame([(x, v) for x, v in zip(signs, vectors.tolist())], "sign string, vector array<double>")


def rotate(source: DataFrame, target: DataFrame, anchors: DataFrame) -> DataFrame:
    """Source signs (sign, vector) turned onto the target's directions by the orthogonal matrix that
    brings anchor pairs (source, target) closest. Embeddings are vocabulary-sized, and checked."""
    pairs = anchors.join(source.select(F.col("sign").alias("source"), F.col("vector").alias("x")), "source").join(target.select(F.col("sign").alias("target"), F.col("vector").alias("y")), "target")
    if source.count() > CELLS // 100 or pairs.count() > CELLS // 100:
        raise ValueError("more signs than a rotation takes at once")
    rows = pairs.select("x", "y").collect()
    if not rows:
        raise ValueError("no anchors that both sides have")
    a, b = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    k = min(a.shape[1], b.shape[1])
    u, _, vt = np.linalg.svd(a[:, :k].T @ b[:, :k])
    turn = u @ vt
    return source.sparkSession.createDataFrame([(r.sign, (np.array(r.vector[:k]) @ turn).tolist()) for r in source.collect()], "sign string, vector array<double>")


def shared_anchors(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source, target): signs of both sides with the same label but for case and subscripts."""
    key = lambda df, n: df.select(F.col("sign").alias(n), F.upper(F.translate("sign", "₂₃₄", "234")).alias("k"))
    return key(source, "source").join(key(target, "target"), "k").select("source", "target")


def zipf_mandelbrot(frequencies: list[float]) -> dict | None:
    """s, beta, ks, r2_log, log_z of the likeliest Zipf-Mandelbrot law of falling frequencies: a grid,
    refined twice. None below five ranks."""
    f = np.array(sorted(frequencies, reverse=True), float)
    if len(f) < 5 or f.sum() <= 0:
        return None
    ranks = np.arange(1, len(f) + 1)

    def likelihood(s: float, beta: float) -> float:
        logs = np.log(ranks + beta)
        return float(-s * (f * logs).sum() - f.sum() * np.log(np.exp(-s * logs).sum()))

    best = max((likelihood(s, b), -s, -b) for s in np.arange(0.2, 3.05, 0.1) for b in np.arange(0, 15.25, 0.5))
    for ds, db in ((0.02, 0.1), (0.004, 0.02)):
        s0, b0 = -best[1], -best[2]
        grid = [(max(0.01, s0 + i * ds), max(0.0, b0 + j * db)) for i in range(-5, 6) for j in range(-5, 6)]
        best = max([best, *((likelihood(s, b), -s, -b) for s, b in grid)])
    s, beta = -best[1], -best[2]
    weights = (ranks + beta) ** -s
    fit = weights / weights.sum()
    ks = float(np.abs(np.cumsum(f / f.sum()) - np.cumsum(fit)).max())
    some = f > 0
    seen, model = np.log(f[some]), np.log(f.sum() * fit[some])
    spread = float(((seen - seen.mean()) ** 2).sum())
    return {"s": float(s), "beta": float(beta), "ks": ks, "r2_log": max(0.0, 1 - float(((seen - model) ** 2).sum()) / spread) if spread > 0 else 0.0, "log_z": float(np.log(weights.sum()))}


def decode_mst(scores: np.ndarray) -> list[int]:
    """The heads (0 for the root) of the best tree with one root over [words, words + 1] arc scores:
    for each possible root the best arborescence, the best of these."""
    scores = np.asarray(scores, float)
    n = len(scores)
    if scores.ndim != 2 or scores.shape[1] != n + 1 or np.isnan(scores).any() or np.isposinf(scores).any():
        raise ValueError("arc scores must have shape [words, words + 1], finite or minus infinity")
    best: tuple[float, list[int]] | None = None
    for root in range(n):
        if not np.isfinite(scores[root, 0]):
            continue
        weight = {(h, d): float(scores[d, h + 1]) for d in range(n) for h in range(n) if h != d and d != root and np.isfinite(scores[d, h + 1])}
        heads = _arborescence(set(range(n)), root, weight)
        if heads is not None:
            value = float(scores[root, 0]) + sum(weight[h, d] for d, h in heads.items())
            if best is None or value > best[0] + 1e-12:
                best = value, [0 if d == root else heads[d] + 1 for d in range(n)]
    if n and best is None:
        raise ValueError("no tree reaches every word")
    return best[1] if best else []


def _arborescence(nodes: set, root, weight: dict) -> dict | None:
    """Head of each node but the root, by contracting cycles of best heads."""
    into: dict = {}
    for (h, d), w in sorted(weight.items(), key=str):
        if d != root and (d not in into or w > weight[into[d], d]):
            into[d] = h
    if any(d not in into for d in nodes if d != root):
        return None
    for start in sorted(nodes - {root}, key=str):
        path, x = [], start
        while x != root and x not in path:
            path.append(x)
            x = into[x]
        if x != root:
            cycle = path[path.index(x) :]
            break
    else:
        return into
    ring, new = set(cycle), ("cycle", tuple(sorted(map(str, cycle))))
    smaller: dict = {}
    origin: dict = {}
    for (h, d), w in sorted(weight.items(), key=str):
        arc = (h, new) if d in ring and h not in ring else (new, d) if h in ring and d not in ring else (h, d) if not ring & {h, d} else None
        if arc is not None:
            value = w - weight[into[d], d] if d in ring else w
            if arc not in smaller or value > smaller[arc]:
                smaller[arc], origin[arc] = value, (h, d)
    heads = _arborescence(nodes - ring | {new}, root, smaller)
    if heads is None:
        return None
    out = {}
    for d, h in heads.items():
        real_h, real_d = origin[h, d]
        out[real_d] = real_h
    return {**{d: into[d] for d in cycle if d not in out}, **out}


def morphological_clusters(words: DataFrame, min_productivity: int = 5, min_size: int = 2, max_suffix: int = 2) -> DataFrame:
    """(word, stem, suffix, n): hyphenated words linked to the words that they are without a productive
    suffix of one or two signs; the stem is a group's shortest word, then its most frequent one."""
    # every table below reads the vocabulary, which is counted once and kept, on disk where memory is short
    rows = words.filter(F.col("text").contains("-")).select("text", "n", F.split("text", "-").alias("u")).persist(StorageLevel.MEMORY_AND_DISK)
    cut = F.transform(F.sequence(F.lit(1), F.least(F.lit(max_suffix), F.size("u") - 1)), lambda k: F.struct(F.array_join(F.slice(F.col("u"), F.size("u") - k + 1, k), "-").alias("suffix"), F.array_join(F.slice(F.col("u"), F.lit(1), F.size("u") - k), "-").alias("base")))
    cuts = rows.select("text", F.explode(cut).alias("x")).select("text", "x.*")
    productive = cuts.groupBy("suffix").agg(F.count("*").alias("c")).filter(F.col("c") >= min_productivity).select("suffix")
    links = cuts.join(productive, "suffix", "left_semi").join(rows.select(F.col("text").alias("base")), "base", "left_semi").select("text", "base")
    pairs = links.limit(CELLS + 1).collect()
    if len(pairs) > CELLS:
        raise ValueError(f"more than {CELLS} links between words")
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for text, base in pairs:
        a, b = root(text), root(base)
        parent[max(a, b)] = min(a, b)
    found = words.sparkSession.createDataFrame([(x, root(x)) for x in sorted(parent)], "text string, root string")
    groups = found.join(rows.select("text", "n"), "text")
    size = lambda c: F.size(F.split(c, "-"))
    best = groups.groupBy("root").agg(F.min(F.struct(size("text").alias("s"), (-F.col("n")).alias("m"), F.col("text").alias("stem"))).alias("b"), F.count("*").alias("c")).filter(F.col("c") >= min_size)
    out = groups.join(best.select("root", F.col("b.stem").alias("stem")), "root")
    suffix = F.when(F.col("text") == F.col("stem"), "").when(F.col("text").startswith(F.concat("stem", F.lit("-"))), F.expr("substring(text, length(stem) + 2)")).otherwise("≠")
    return out.select(F.col("text").alias("word"), "stem", suffix.alias("suffix"), "n")
