"""Queries of scores over made-up predictions of the documents' words, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.operators import scoring
from tabulae.plans.corpus_queries import SCORED, TOK, _scored
from tabulae.plans.registry import register
from tabulae.sources.adapter import table, tokens, vocabulary

COLUMNS = {
    "form": "text", "gold_lemma": "substring(text, 1, 3)", "gold_pos": "CASE pos % 3 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' ELSE 'ADJ' END", "lemma": "CASE WHEN pos % 7 = 0 THEN 'x' WHEN pos % 11 = 0 THEN NULL ELSE concat(substring(text, 1, 3), '2') END",
    "pos": "CASE WHEN (doc_id + pos) % 5 = 0 THEN 'X' WHEN pos % 3 = 0 THEN 'NOUN' WHEN pos % 3 = 1 THEN 'VERB' ELSE 'ADJ' END", "seen": "doc_id % 4 <> 0", "scored": "pos % 13 <> 0",
}
HITS = TOK + ", pr AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM tok), ht AS (SELECT *, coalesce(regexp_replace(lemma, '[0-9]+$', ''), '') AS cl, coalesce(regexp_replace(lemma, '[0-9]+$', ''), '') = gold_lemma AS lh, pos = gold_pos AS ph FROM pr WHERE scored)"


def predictions(s: SparkSession, d: str) -> DataFrame:
    return tokens(table(s, d, "documents")).select(*[F.expr(e).alias(n) for n, e in COLUMNS.items()])


register("tagger_score", lambda s, d: scoring.score(predictions(s, d)), HITS + " SELECT round(count(*) FILTER (lh) / count(*)::DOUBLE, 6) AS lemma_all, round(count(*) FILTER (ph) / count(*)::DOUBLE, 6) AS pos_all, round(count(*) FILTER (lh AND NOT seen) / (count(*) FILTER (NOT seen))::DOUBLE, 6) AS lemma_unseen, round(count(*) FILTER (ph AND NOT seen) / (count(*) FILTER (NOT seen))::DOUBLE, 6) AS pos_unseen, count(*) AS n_all, count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_unseen FROM ht")
register("pos_confusions", lambda s, d: scoring.confusions(predictions(s, d)), HITS + " SELECT gold_pos AS gold, pos AS predicted, count(*) AS n FROM ht WHERE NOT ph GROUP BY ALL")
register("lemma_confusions", lambda s, d: scoring.confusions(predictions(s, d), "lemma"), HITS + " SELECT gold_lemma AS gold, cl AS predicted, count(*) AS n FROM ht WHERE NOT lh GROUP BY ALL")
register("score_by_tag", lambda s, d: scoring.by_tag(predictions(s, d)), HITS + " SELECT gold_pos, count(*) AS n, count(*) FILTER (ph) AS pos_correct, count(*) FILTER (lh) AS lemma_correct FROM ht GROUP BY gold_pos")
register(
    "score_by_frequency",
    lambda s, d: scoring.by_frequency(predictions(s, d), vocabulary(tokens(table(s, d, "documents")).filter("site = 'src0'")).withColumnRenamed("text", "form")),
    HITS + ", fr AS (SELECT text AS form, count(*) AS n FROM tok WHERE site = 'src0' GROUP BY text) SELECT CASE WHEN coalesce(n, 0) <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 50 THEN '6-50' ELSE '51+' END AS band, count(*) AS n, count(*) FILTER (ph) AS pos_correct, count(*) FILTER (lh) AS lemma_correct FROM ht LEFT JOIN fr USING (form) GROUP BY 1",
)
ARCS = "l_linenumber AS gold_head, l_returnflag AS gold_deprel, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_linenumber END AS head, CASE WHEN l_suppkey % 4 = 0 THEN 'dep' ELSE l_returnflag END AS deprel, l_linestatus"
register("attachment_scores", lambda s, d: scoring.attachment(table(s, d, "lineitem").selectExpr(*ARCS.split(", ")), ["l_linestatus"]), f"WITH a AS (SELECT {ARCS} FROM lineitem) SELECT l_linestatus, count(*) AS tokens, round(count(*) FILTER (head = gold_head) / count(*)::DOUBLE, 6) AS uas, round(count(*) FILTER (head = gold_head AND deprel = gold_deprel) / count(*)::DOUBLE, 6) AS las FROM a GROUP BY l_linestatus")
register(
    "abstention",
    lambda s, d: _scored(s, d).select("doc_id", scoring.decide(F.expr("CASE quality WHEN 1 THEN 'pos' ELSE 'other' END"), F.expr("CASE WHEN toxic = 1 THEN NULL ELSE p END"), {"pos": 0.4}).alias("x")).select("doc_id", "x.action", "x.reason"),
    SCORED + " SELECT doc_id, CASE WHEN toxic = 1 OR quality <> 1 THEN 'unavailable' WHEN p >= 0.4 THEN 'accept' ELSE 'review' END AS action, CASE WHEN toxic = 1 THEN 'no confidence' WHEN quality <> 1 THEN 'no threshold' END AS reason FROM s",
)
register("calibrated", lambda s, d: _scored(s, d).select("doc_id", F.round(scoring.calibrate_logit(F.col("p"), 1.5, -0.25), 6).alias("q")), SCORED + " SELECT doc_id, round(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 1 ELSE 1 / (1 + exp(-(1.5 * ln(p / (1 - p)) - 0.25))) END, 6) AS q FROM s")
