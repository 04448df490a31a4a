"""Matrix methods on small cases that can be worked out otherwise."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.operators import matrix


def table(spark, m):
    return spark.createDataFrame([(f"r{i}", f"c{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "r string, c string, n double")


def test_correspondence_analysis_is_the_svd(spark):
    m = np.array([[5, 3, 0, 1], [2, 9, 1, 1], [1, 1, 7, 3], [0, 2, 4, 8]])
    got = {(r.side, r.label): r for r in matrix.correspondence_analysis(table(spark, m), "r", "c").collect()}
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, d, _ = np.linalg.svd(s)
    assert np.allclose(np.abs([got["row", f"r{k}"].x for k in range(4)]), np.abs(u[:, 0] * d[0] / np.sqrt(r)))
    assert np.isclose(got["col", "c0"].inertia_x, d[0] ** 2 / (s * s).sum()) and matrix.correspondence_analysis(table(spark, m[:2]), "r", "c") is None


def test_upgma_and_seriation(spark):
    m = [[9, 1, 0, 0], [8, 2, 0, 0], [0, 0, 5, 5], [0, 1, 4, 5]]
    rows = matrix.upgma(table(spark, m), "r", "c", replicates=20).collect()
    assert rows[0].members in ("r0,r1", "r2,r3") and rows[-1].members == "r0,r1,r2,r3" and rows[-1].support == 1.0 and rows[0].height <= rows[1].height <= rows[2].height
    line = [[3, 0, 0, 0, 0], [2, 2, 0, 0, 0], [0, 2, 2, 0, 0], [0, 0, 2, 2, 0], [0, 0, 0, 2, 3]]
    order = [2, 0, 4, 1, 3]
    got = [r.label for r in matrix.seriate(table(spark, [line[k] for k in order]), "r", "c").orderBy("place").collect()]
    want = [f"r{order.index(k)}" for k in range(5)]
    assert got in (want, want[::-1])
    blocks = matrix.seriate(table(spark, [[1, 0], [0, 1]]), "r", "c").collect()
    assert [r.block for r in blocks] == [0, 1]


def test_label_propagation_finds_cliques(spark):
    edges = [(a, b, 1.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("d", "w", 0.1)]
    nodes = spark.createDataFrame([(x,) for x in "abcdwxyzq"], "node string")
    got = {r.node: r.community for r in matrix.label_propagation(nodes, spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["w"] and got["q"] == 2


def test_embeddings_rotate_back(spark):
    words = spark.createDataFrame([("-".join(w), n) for w, n in [("abc", 3), ("abd", 2), ("bca", 1), ("cab", 2), ("dab", 1), ("acd", 4)]], "text string, n long")
    emb = matrix.sign_embeddings(words, 4).cache()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in emb.collect())
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(4, 4)))[0]
    other = spark.createDataFrame([(r.sign, (np.array(r.vector) @ turn).tolist()) for r in emb.collect()], "sign string, vector array<double>")
    back = {r.sign: r.vector for r in matrix.rotate(emb, other, matrix.shared_anchors(emb, other)).collect()}
    assert all(np.allclose(back[r.sign], r.vector, atol=1e-6) for r in other.collect())


@pytest.mark.parametrize("seed", range(6))
def test_best_tree_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = 4
    scores = rng.normal(size=(n, n + 1))

    def value(heads):
        if sum(h == 0 for h in heads) != 1 or any(h == d for d, h in enumerate(heads, 1)):
            return -np.inf
        for d in range(1, n + 1):
            seen, x = set(), d
            while x:
                if x in seen:
                    return -np.inf
                seen.add(x)
                x = heads[x - 1]
        return sum(scores[d, h] for d, h in enumerate(heads))

    best = max(itertools.product(range(n + 1), repeat=n), key=value)
    assert matrix.decode_mst(scores) == list(best) and matrix.decode_mst(np.zeros((0, 1))) == []


def test_zipf_mandelbrot_recovers_its_law():
    f = [round(1e6 / (r + 2.5) ** 1.2) for r in range(1, 300)]
    fit = matrix.zipf_mandelbrot(f)
    assert abs(fit["s"] - 1.2) < 0.02 and abs(fit["beta"] - 2.5) < 0.3 and fit["ks"] < 0.01 and fit["r2_log"] > 0.999 and matrix.zipf_mandelbrot([1, 2]) is None


def test_clusters_follow_productive_suffixes(spark):
    rng = random.Random(0)
    stems = ["-".join(rng.sample(["ka", "ru", "te", "lo", "mi"], 3)) for _ in range(6)]
    words = {s: 5 for s in stems} | {f"{s}-jo": 2 for s in stems} | {"pa-ra": 1}
    got = {r.word: (r.stem, r.suffix) for r in matrix.morphological_clusters(spark.createDataFrame(list(words.items()), "text string, n long"), 5).collect()}
    assert {f"{s}-jo": (s, "jo") for s in stems} | {s: (s, "") for s in stems} == got


def test_similarity_has_all_pairs(spark):
    got = {(r.a, r.b): r.similarity for r in matrix.brainerd_robinson(spark.createDataFrame([("x", "k", 1), ("y", "k", 1), ("y", "l", 1), ("z", "m", 4)], "u string, k string, n int"), "u", "k").collect()}
    assert got == {("x", "x"): 200.0, ("y", "y"): 200.0, ("z", "z"): 200.0, ("x", "y"): 100.0, ("x", "z"): 0.0, ("y", "z"): 0.0}
