import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulae.functions import text
from tabulae.functions.measures import chi_squared_2x2, log_likelihood_2x2, mulberry32, wilson
from tabulae.functions.numerals import format_value, parse_value
from tabulae.operators.ledgers import check_balances
from tabulae.operators import resampling
from tabulae.operators.query import Condition, query, sign_pattern
from tabulae.streaming.sentences import sentences, windowed_counts


def draws(seed, n):
    out, full = [], 0xFFFFFFFF
    for _ in range(n):
        seed = (seed + 0x6D2B79F5) & full
        t = ((seed ^ seed >> 15) * (seed | 1)) & full
        t ^= (t + (((t ^ t >> 7) * (t | 61)) & full)) & full
        out.append((t ^ t >> 14) / 2**32)
    return out


@pytest.mark.parametrize("seed", [0, 42, 2**32 - 1])
def test_mulberry_is_the_sequential_generator(spark, seed):
    got = [r.u for r in spark.range(500).select(mulberry32(seed, F.col("id")).alias("u")).collect()]
    assert sorted(got) == sorted(draws(seed, 500))


def test_degenerate_margins(spark):
    row = spark.range(1).select(chi_squared_2x2(*[F.lit(0)] * 4).alias("a"), log_likelihood_2x2(*[F.lit(0)] * 4).alias("b"), wilson(F.lit(0), F.lit(0)).alias("w")).first()
    assert (row.a, row.b, tuple(row.w)) == (0.0, 0.0, (0.0, 1.0))


def test_numerals(spark):
    tokens = {"12": 12.0, "≈ 3": 3.0, "2½": None, "¾": 0.75, "¹⁄₂": 0.5, "3/4": 0.75, "x": None, "": None, "1-2": None, "¹⁄₀": None, "1/0": None, "≈": None, "~3": None, "1.5": None, "9" * 25: 1e25, "9" * 400: None, "٣": None}
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", parse_value(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == tokens
    shown = {2.5: "2½", -0.75: "-¾", 3.0: "3", 0.123: "0.123", -2.0: "-2", 0.0625: "¹⁄₁₆", 1.4: "1.4", -0.0001: "0"}
    df = spark.createDataFrame([(v,) for v in shown], "v double").select("v", format_value(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == shown


def test_balances_reset_at_each_total(spark):
    rows = [(1, 1, "item", 2.0), (1, 2, "item", 3.0), (1, 3, "total", 5.0), (1, 4, "item", 1.0), (1, 5, "total", 2.0), (1, 6, "item", 4.0), (1, 7, "grand-total", 11.0)]
    out = check_balances(spark.createDataFrame(rows, "doc_id int, line_no int, role string, value double")).orderBy("line_no").collect()
    assert [(r.computed, r.balanced) for r in out] == [(5.0, True), (1.0, False), (11.0, True)]


def test_fold_is_left_to_right_and_one_word_meets_all(spark):
    t = spark.createDataFrame([("a", "s", "ka-ru"), ("a", "s", "te-lo"), ("b", "t", "ka-lo")], "doc_id string, site string, text string").withColumn("period", F.lit("p")).withColumn("scribe", F.lit("x"))
    both = [Condition("word-prefix", "ka"), Condition("word-suffix", "lo")]
    assert [r.doc_id for r in query(t, both).collect()] == ["b"]
    folded = [Condition("site-is", "s"), Condition("site-is", "t", "OR"), Condition("id-contains", "b")]
    assert [r.doc_id for r in query(t, folded).collect()] == ["b"]
    assert query(t, []).count() == 2
    with pytest.raises(ValueError):
        query(t, [Condition("nothing", 1)])


def test_sign_patterns():
    import re

    assert re.match(sign_pattern("ka-**-ru"), "-KA-RU") and re.match(sign_pattern("ka-*-ru"), "-KA-X-RU")
    assert not re.match(sign_pattern("ka-*-ru"), "-KA-RU")


def test_tails(spark):
    assert math.isclose(float(resampling._fisher(*(pd.Series([x]) for x in (3, 4, 4, 8)))[0]), 0.485714285714, rel_tol=1e-9)
    row = spark.createDataFrame([(3.841458820694124,)], "x double").select(text.chi_squared_p("x").alias("p")).first()
    assert math.isclose(row.p, 0.05, rel_tol=1e-9)


def test_nulls_and_temperature(spark):
    words = ["ka-ru", "te-lo", "mi-ka-no", "pa"]
    draw = resampling.generator(3)
    assert sorted(resampling.length_reshuffle_null(words, draw)) == sorted(words)
    dealt = resampling.within_word_null(words, draw)
    assert [w.count("-") for w in dealt] == [w.count("-") for w in words] and sorted("-".join(dealt).split("-")) == sorted("-".join(words).split("-"))
    row = resampling.monte_carlo(spark.createDataFrame([(w,) for w in words], "text string"), lambda ws: float(len(ws)), replicates=9).first()
    assert (row.observed, row.p, row.null_low, row.null_high) == (4.0, 1.0, 4.0, 4.0)
    rows = spark.createDataFrame([([2.0 * k, 0.0], 0 if k % 4 else 1) for k in range(40)], "logits array<double>, label int")
    assert 0.05 < resampling.fit_temperature(rows) < 20 and rows.select(resampling.top1_confidence(F.col("logits"), 1.0).alias("p")).filter("p < 0.5").count() == 0


def test_draws_in_blocks_are_the_sequential_generator():
    draw = resampling.generator(7)
    want = [draw() for _ in range(400)]
    assert resampling.draws_block(7, 0, 400).tolist() == want and resampling.draws_block(7, 150, 100).tolist() == want[150:250]


def test_entropy_shuffles_no_draws_and_takes_any_block(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 50), ("b", 0), ("c", 7), (None, 3)], "item string, n long")
    want = tuple(resampling.bootstrap_entropy(counts, 30).first())
    draw, words, hs = resampling.generator(1), ["a"] * 50 + ["c"] * 7 + ["-"] * 3, []
    for _ in range(30):
        got = Counter(words[int(draw() * 60)] for _ in range(60))
        hs.append(math.log2(60) - sum(c * math.log2(c) for c in got.values()) / 60)
    assert want == pytest.approx((sorted(hs)[1], sorted(hs)[28]), abs=2e-6)
    # a row for each block of draws, not one for each draw
    assert resampling._resampled(spark, 2, 3_000_000, 1, lambda rep, k: [np.array([len(k)])], "n long").count() == 6
    monkeypatch.setattr(resampling, "BLOCK", 40)
    monkeypatch.setattr(resampling, "HELD", 2)
    assert tuple(resampling.bootstrap_entropy(counts, 30).first()) == want


def test_resampled_means_take_any_block(spark, monkeypatch):
    rows = [(k, float(k * k % 17), None if k % 5 == 0 else k % 3) for k in range(60)]
    run = lambda: sorted(map(tuple, resampling.bootstrap_means(spark.createDataFrame(rows, "k long, x double, y int"), ["x", "y"], 20).collect()))
    draw, ms = resampling.generator(0), []
    for _ in range(20):
        own = [rows[int(draw() * 60)] for _ in rows]
        ms.append((np.mean([r[1] for r in own]), np.mean([r[2] for r in own if r[2] is not None])))
    want = [(*np.quantile([m[j] for m in ms], (0.025, 0.975)),) for j in (0, 1)]
    got = run()
    assert [r[2:] for r in got] == [pytest.approx(w, abs=2e-6) for w in want]
    monkeypatch.setattr(resampling, "BLOCK", 40)
    monkeypatch.setattr(resampling, "HELD", 50)
    assert run() == got


@pytest.mark.parametrize("null", sorted(resampling.NULLS))
def test_null_replicates_run_apart_on_the_same_draws(spark, null):
    words = sorted("a-b-c b-c a-a d c-d-a-b b-b c a-d".split())
    statistic = lambda ws: float(sum(len(w) * k for k, w in enumerate(ws)) + sum(w[0] == w[-1] for w in ws) + 3 * ws.index(min(ws, key=lambda w: w[::-1])))
    draw = resampling.generator(0)
    want = [statistic(resampling.NULLS[null](words, draw)) for _ in range(9)]
    df = resampling.monte_carlo(spark.createDataFrame([(w,) for w in words], "text string"), statistic, null, 9)
    got = df.first()
    assert got.observed == statistic(words) and got.null_mean == pytest.approx(sum(want) / 9) and got.p == pytest.approx((1 + sum(v >= statistic(words) for v in want)) / 10)
    assert "Coalesce" not in df._jdf.queryExecution().optimizedPlan().toString()  # which would make one task of all


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": 1, "text": "One. Two! "}\n{"doc_id": 2, "text": "Three"}\n')
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    q = sentences(stream).writeStream.format("memory").queryName("sents").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text.strip() for r in spark.table("sents").collect()) == ["One.", "Three", "Two!"]
    batch = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.k, r.n) for r in windowed_counts(batch, "ts", "k").collect()) == [("a", 2), ("b", 1)]
