"""What is shuffled, read and held, and odd inputs of the queries that were changed for larger tables."""

import math

import numpy as np
import pytest

from tabulae.operators import accounts, association, counts, matrix, morphology
from tabulae.operators.ledgers import check_balances
from tabulae.operators.query import Condition, query
from tabulae.plans import corpus_queries
from tabulae.sources import adapter

TEXTS = [(1, "the thin man\nA man, the END", "s0", "en"), (2, "thin thin\n\nthe", "s1", "en"), (2, "old thin", "s1", "fr"), (3, None, "s0", "fr"), (4, "12 --", "s0", "fr"), (None, "thin the ox", "s0", None), (5, "ox man the", None, "en")]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string")


def plan(df):
    return df._jdf.queryExecution().toString()


def shuffled(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_sets_are_counted_where_they_are_read(spark, documents):
    lines = {(d, n): {w.strip(",").lower() for w in x.split()} - {"", "12", "--"} for d, t, *_ in TEXTS[:2] + TEXTS[4:] for n, x in enumerate(t.split("\n"), 1)}
    lines[2, 1] |= {"old"}
    units = [(d, s) for (d, _), s in lines.items() if s]
    df = association.line_pmi(adapter.line_sets(documents), "the", 1)
    got = {r.text: tuple(r) for r in df.collect()}
    held = [s for d, s in units if "the" in s and d is not None]
    anchored = sum("the" in s for _, s in units)
    for w in set().union(*held) - {"the"}:
        joint, n = sum(w in s for s in held), sum(w in s for _, s in units)
        assert got.pop(w) == (w, joint, n, pytest.approx(math.log2(joint * len(units) / (n * anchored)), abs=2e-6))
    assert not got
    once = documents.filter("doc_id IN (1, 5)")
    for df in (association.line_pmi(adapter.line_sets(once), "the", 1), association.assoc(adapter.document_sets(once), "the")):
        assert shuffled(df) == [] or not any("doc_id" in x for x in shuffled(df))
        assert "InMemoryRelation" in plan(df)  # one pass over the texts
    found = {r.text: (r.joint, r.right_n) for r in association.assoc(adapter.document_sets(documents), "thin").collect()}
    assert found == {"the": (2, 4), "man": (1, 2), "a": (1, 1), "end": (1, 1), "old": (1, 1)}


def test_words_of_a_line_are_found_once(documents):
    df = corpus_queries.line_positions(corpus_queries.line_tokens_with_place(documents))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    got = {r.text: tuple(r)[1:] for r in df.collect()}
    assert got["the"] == (2, 2, 2) and got["thin"] == (2, 2, 1) and got["ox"] == (1, 1, 0)


def test_documents_are_counted_where_they_are_read(spark, documents):
    tokens = adapter.tokens(documents.filter("doc_id IS NOT NULL"))
    df = counts.document_dispersions(adapter.document_counts(documents.filter("doc_id IS NOT NULL")), 2)
    want = sorted(map(tuple, counts.dispersions(tokens, 2).collect()))
    assert sorted(map(tuple, df.collect())) == want and len(want) == 3
    once = counts.document_dispersions(adapter.document_counts(documents.filter("doc_id IN (1, 5)")), 1)
    assert not any("doc_id" in x for x in shuffled(once))


def test_coverage_joins_no_tokens(documents):
    df = counts.coverage(adapter.tokens(documents), "site = 's0'", 2, "period")
    assert "Join" not in plan(df)
    assert {r.period: (r.tokens, r.known) for r in df.collect()} == {"en": (13, 10), "fr": (2, 1), None: (3, 2)}


def test_document_conditions_fold_tokens_before_they_are_shuffled(documents):
    tokens = adapter.tokens(documents)
    df = query(tokens, [Condition("ins-contains-word", "thin"), Condition("ins-contains-word", "old", "AND"), Condition("site-is", "s0", "OR")])
    assert "ObjectHashAggregate" not in plan(df) and "Join" not in plan(df)
    assert {r.doc_id for r in df.collect()} == {1, 2, None}
    df = query(tokens, [Condition("ins-contains-word", "old"), Condition("word-prefix", "t")], "words")
    assert sorted(map(tuple, df.collect())) == [("the", 1), ("thin", 1)]


def test_neighbours_hold_few_pairs_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(90)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want, m = [], np.array([v for _, v in vectors])
    norms = np.linalg.norm(m, axis=1)
    for q in range(0, 90, 20):
        cosine = np.round(np.divide(m / np.where(norms > 0, norms, 1)[:, None] @ m[q] / (norms[q] or 1), 1), 6)
        near = sorted((-c + 0.0, k) for k, c in enumerate(cosine) if k != q)[:5]
        want += [(q, k, c and -c, r) for r, (c, k) in enumerate(near, 1)]
    for cells in (1 << 19, 40, 1):
        monkeypatch.setattr(association, "CELLS", cells)
        got = sorted(map(tuple, association.cosine_neighbours(df, df.filter("vec_id % 20 = 0"), 5, 3).collect()), key=lambda r: (r[0], r[3]))
        assert [(*r[:2], round(r[2], 5), r[3]) for r in got] == [(*r[:2], pytest.approx(r[2], abs=1e-4), r[3]) for r in want]


def jobs(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_a_small_matrix_is_counted_once(spark, monkeypatch):
    words = spark.createDataFrame([("a-b-a", 2), ("b-c", 1), ("a-c", 5)], "text string, n long").coalesce(1)
    assert jobs(spark, lambda: matrix.sign_embeddings(words, 3)) <= 2
    seen = {}
    monkeypatch.setattr(matrix, "small", lambda df, *_: seen.update({(r.sign, r.context, r.n) for r in df.collect()} and {"rows": sorted(map(tuple, df.select("sign", "context", "n").collect()))}) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        matrix.sign_embeddings(words, 3)
    assert seen["rows"] == sorted([("b", "L1:a", 2), ("a", "L1:b", 2), ("a", "R1:b", 2), ("b", "R1:a", 2), ("a", "initial", 2), ("a", "final", 2), ("c", "L1:b", 1), ("b", "R1:c", 1), ("b", "initial", 1), ("c", "final", 1), ("c", "L1:a", 5), ("a", "R1:c", 5), ("a", "initial", 5), ("c", "final", 5)])


def test_clusters_read_the_vocabulary_once(spark):
    words = spark.createDataFrame([(f"{a}-{b}" if b else a + "-x", 1) for a in ("k-a", "k-e", "k-i", "k-o", "k-u") for b in ("", "s")], "text string, n long")
    assert "InMemoryRelation" in plan(matrix.morphological_clusters(words))


def test_cut_words_read_the_vocabulary_once(spark):
    words = spark.createDataFrame([(w, 1) for w in ("a-b-c-x", "a-b-d-y", "a--b-e-z", "q", "--", "abcx")], "text string, n long")
    df = morphology.segment(words)
    got = {r.text: (r.cuts, r.pieces) for r in df.collect()}
    assert got["a-b-c-x"] == ([2], ["a-b", "c-x"]) and got["abcx"] == ([2], ["ab", "cx"]) and got["a--b-e-z"] == ([2], ["a-b", "e-z"]) and got["q"] == ([], ["q"]) and got["--"] == ([], [])
    assert "InMemoryRelation" in plan(df)


def test_sections_are_sorted_once(spark):
    lines = [(1, 1, "item", 2.0), (1, 2, "total", 2.0), (1, 3, "item", 1.0), (1, 4, "item", 1.5), (1, 5, "total", 3.0), (1, 6, "item", 0.25), (1, 7, "grand-total", 5.25), (1, 8, "total", 0.0), (1, 9, "grand-total", 0.0), (1, 10, "item", 9.0), (2, 1, "total", None)]
    df = check_balances(spark.createDataFrame(lines, "doc_id long, line_no long, role string, value double"))
    # one sort of the lines, one of the totals alone
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
    assert sorted(map(tuple, df.collect()), key=str) == [
        (1, 2, "total", 2.0, 2.0, True), (1, 5, "total", 3.0, 2.5, False), (1, 7, "grand-total", 5.25, 5.25, True), (1, 8, "total", 0.0, 0.0, True), (1, 9, "grand-total", 0.0, 0.0, True), (2, 1, "total", None, 0.0, None),
    ]


def test_accounts_are_parsed_and_added_up_once(spark):
    lines = spark.createDataFrame([(1, 1, ["KU-RO", "5"]), (1, 2, ["A-DU", "GRA", "2", "1/2"]), (1, 3, ["PA-TO", "x", "3"]), (1, 4, ["A-DU", "VIN"]), (2, 1, ["A-DU", "GRA", "1"]), (None, 1, ["A-DU", "4"])], "doc_id long, line_no long, tokens array<string>")
    df = accounts.account_dossiers(lines)
    assert {tuple(r) for r in df.collect()} == {("A-DU", 3, 2, 7.5, 2, 1), ("PA-TO", 1, 1, 3.0, 0, 1)} and df.columns == ["head", "entries", "tablets", "total", "with_commodity", "co_listed"]
    metrology = accounts.commodity_metrology(lines, 1)
    assert {(r["head"], r.entries, r.fractional_pct, r["median"], r.largest) for r in metrology.collect()} == {("GRA", 2, 50.0, 2.5, 2.5)}
    for x in (df, metrology):
        tree = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in tree and tree.count("Generate explode") == 1
