"""Queries of resampling; the seeded generator is written in SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions.measures import mulberry32
from tabulae.operators import resampling
from tabulae.plans.corpus_queries import SCORED, TOK
from tabulae.plans.morphology_queries import words
from tabulae.plans.registry import register
from tabulae.sources.adapter import table, tokens


def draws_sql(seed: int, count: str) -> str:
    """CTEs ``u0`` to ``u``: (k, u) for k from 0."""
    m = 4294967295
    return f"""u0 AS (SELECT k, (({seed} + (k + 1) * 1831565813) % 4294967296)::UBIGINT AS t FROM (SELECT unnest(range(CAST(({count}) AS BIGINT))) AS k)), u1 AS (SELECT k, (xor(t, t >> 15) * (t | 1::UBIGINT)) & {m}::UBIGINT AS t FROM u0),
u2 AS (SELECT k, xor(t, (t + ((xor(t, t >> 7) * (t | 61::UBIGINT)) & {m}::UBIGINT)) & {m}::UBIGINT) AS t FROM u1), u AS (SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM u2)"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return resampling.numbered(table(s, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("diff")), "doc_id").select("k", "diff")


N = "(SELECT count(*) FROM labels)"
register("mulberry32", lambda s, d: s.range(5000).select(F.col("id").alias("k"), F.round(mulberry32(42, F.col("id")), 9).alias("u")), "WITH " + draws_sql(42, "5000") + " SELECT k, round(u, 9) AS u FROM u")
PICK = draws_sql(0, f"200 * {N}") + f", dr AS (SELECT k // {N} AS rep, CAST(floor(u * {N}) AS BIGINT) AS k FROM u), it AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, quality, toxic, quality - toxic AS diff FROM labels)"
register(
    "paired_bootstrap",
    lambda s, d: resampling.paired_bootstrap(_pairs(s, d), 200),
    "WITH " + PICK + """, m AS (SELECT rep, avg(diff) AS m FROM dr JOIN it USING (k) GROUP BY rep)
SELECT (SELECT round(avg(diff), 6) FROM it) AS mean, count(*) AS replicates, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(count(*) FILTER (round(m, 9) > 0) / count(*)::DOUBLE, 6) AS favour_a, round(count(*) FILTER (round(m, 9) < 0) / count(*)::DOUBLE, 6) AS favour_b FROM m""",
)
register(
    "bootstrap_means",
    lambda s, d: resampling.bootstrap_means(resampling.numbered(table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")), "doc_id"), ["quality", "toxic"], 200),
    "WITH " + PICK + """, m AS (SELECT rep, avg(quality) AS q, avg(toxic) AS t FROM dr JOIN it USING (k) GROUP BY rep)
SELECT 'quality' AS statistic, (SELECT round(avg(quality), 6) FROM it) AS estimate, round(quantile_cont(q, 0.025), 6) AS low, round(quantile_cont(q, 0.975), 6) AS high FROM m UNION ALL SELECT 'toxic', (SELECT round(avg(toxic), 6) FROM it), round(quantile_cont(t, 0.025), 6), round(quantile_cont(t, 0.975), 6) FROM m""",
)
register(
    "bootstrap_entropy",
    lambda s, d: resampling.bootstrap_entropy(table(s, d, "events").groupBy(F.col("event_type").alias("item")).agg(F.count("*").alias("n")), 40),
    "WITH n AS (SELECT count(*) AS n FROM events), " + draws_sql(1, "40 * (SELECT n FROM n)") + """, it AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS k, event_type AS item FROM events), g AS (SELECT u.k // n AS rep, item, count(*) AS c FROM u, n JOIN it ON it.k = CAST(floor(u * n) AS BIGINT) GROUP BY ALL),
h AS (SELECT rep, log2((SELECT n FROM n)) - sum(c * log2(c)) / (SELECT n FROM n) AS h FROM g GROUP BY rep), l AS (SELECT list_sort(list(h)) AS hs FROM h) SELECT round(hs[2], 6) AS low, round(hs[39], 6) AS high FROM l""",
)
register("mcnemar_exact", lambda s, d: resampling.mcnemar(table(s, d, "labels").filter("doc_id % 9 = 0"), "quality", "toxic").drop("p"), "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels WHERE doc_id % 9 = 0) SELECT only_a, only_b, round(CASE WHEN only_a + only_b <= 25 THEN least(only_a, only_b) ELSE pow(greatest(0, abs(only_a - only_b) - 1), 2) / (only_a + only_b) END, 6) AS statistic, CASE WHEN only_a + only_b <= 25 THEN 'exact' ELSE 'chi2' END AS method FROM c")
register("fisher_p", lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("a"), F.count_if(F.col("p_size") > 20).alias("j")).select("p_brand", F.round(resampling.fisher_p("j", "a", F.lit(300), F.lit(900)), 8).alias("p")))


def repeated_signs(ws: list[str]) -> float:
    """How many words hold a sign twice in a row: a statistic for the null models."""
    return float(sum(any(a == b for a, b in zip(p, p[1:])) for p in (w.split("-") for w in ws)))


for null in resampling.NULLS:
    register(f"monte_carlo_{null}", lambda s, d, n=null: resampling.monte_carlo(words(s, d).filter("n >= 5"), repeated_signs, n, 40))
LOGITS = "SELECT vec_id, embedding[1:4]::DOUBLE[] AS l FROM embeddings"
register(
    "softmax",
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("l")).select("vec_id", F.round(resampling.top1_confidence(F.col("l"), 2.0), 6).alias("top1"), F.round(F.get(resampling.temperature_softmax(F.col("l"), 2.0), F.lit(0)), 6).alias("first")),
    f"WITH e AS ({LOGITS}), x AS (SELECT vec_id, list_transform(l, lambda v: exp(v / 2.0)) AS p FROM e) SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS top1, round(p[1] / list_sum(p), 6) AS first FROM x",
)
