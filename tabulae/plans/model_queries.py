"""Queries over the corpus model, Greek text, phonetics and matrices, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions import greek, phonetics
from tabulae.functions.numerals import value_sql
from tabulae.operators import association, corpus, matrix
from tabulae.plans.corpus_queries import TOK
from tabulae.plans.morphology_queries import words
from tabulae.plans.registry import register
from tabulae.sources.adapter import table, tokens, vocabulary

STATUS = "CASE (doc_id + pos) % 17 WHEN 0 THEN 'unclear' WHEN 1 THEN 'restored' WHEN 2 THEN 'lost' ELSE 'certain' END"
KIND = "CASE WHEN pos % 13 = 0 THEN 'numeral' WHEN pos % 7 = 0 THEN 'logogram' ELSE 'word' END"
SOURCE = "CASE pos % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'lexicon' WHEN 2 THEN 'unresolved' ELSE 'rule' END"
MODEL = TOK + f", md AS (SELECT doc_id, site, pos, text, {STATUS} AS status, {KIND} AS kind, {SOURCE} AS source, (doc_id * pos) % 23 = 0 AS has_alt FROM tok)"


def model(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(table(spark, d, "documents"))
    rows = t.select("doc_id", F.col("doc_id").alias("doc_order"), "site", (F.col("pos") - 1).cast("int").alias("token_order"), F.col("pos").cast("int").alias("position"), "pos", "text", F.expr(STATUS).alias("status"), F.expr(KIND).alias("kind"), F.split("text", "").alias("signs"), F.create_map(F.lit("lemma_source"), F.expr(SOURCE)).alias("annotations"))
    return rows.withColumn("alt", F.when((F.col("doc_id") * F.col("pos")) % 23 == 0, F.array("text")).otherwise(F.array().cast("array<string>")))


register("apparatus_summary", lambda s, d: corpus.apparatus_summary(model(s, d)), MODEL + " SELECT count(DISTINCT doc_id) AS documents, count(*) AS tokens, count(*) FILTER (status = 'certain') AS certain, count(*) FILTER (status = 'unclear') AS unclear, count(*) FILTER (status = 'restored') AS restored, count(*) FILTER (status = 'lost') AS lost, count(DISTINCT CASE WHEN status <> 'certain' THEN doc_id END) AS documents_with_apparatus, count(*) FILTER (has_alt) AS alt FROM md")
register("alt_readings", lambda s, d: corpus.alt_readings(model(s, d)).select("doc_id", "position", "text", "kind", "status"), MODEL + " SELECT doc_id, pos::INT AS position, text, kind, status FROM md WHERE has_alt")
register(
    "diagnose",
    lambda s, d: corpus.diagnose(model(s, d), model(s, d).select(F.explode("signs").alias("label")).filter("label < 't'")),
    MODEL + f""", sg AS (SELECT label, count(*) AS c FROM (SELECT unnest(string_split(text, '')) AS label FROM md WHERE kind <> 'numeral' AND status <> 'lost') GROUP BY label), kn AS (SELECT DISTINCT label FROM (SELECT unnest(string_split(text, '')) AS label FROM md) WHERE label < 't'),
a AS (SELECT count(*) AS tokens, count(*) FILTER (status = 'certain') AS certain, count(*) FILTER (status = 'unclear') AS unclear, count(*) FILTER (status = 'restored') AS restored, count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (has_alt) AS alternatives, count(*) FILTER (kind = 'numeral' AND {value_sql('text')} IS NULL) AS numeral_anomalies, count(*) FILTER (kind = 'word') AS words, count(*) FILTER (kind = 'word' AND source IN ('identity', 'unresolved')) AS needs_review FROM md),
b AS (SELECT count(*) AS signs, count(*) FILTER (c = 1) AS sign_hapaxes, count(*) FILTER (label NOT IN (SELECT label FROM kn)) AS unknown_signs, CAST(coalesce(sum(c) FILTER (label NOT IN (SELECT label FROM kn)), 0) AS BIGINT) AS unknown_sign_tokens FROM sg)
SELECT name AS "check", value AS n FROM (UNPIVOT a ON COLUMNS(*)) UNION ALL SELECT name, value FROM (UNPIVOT b ON COLUMNS(*))""",
)
register("missing_forms", lambda s, d: corpus.missing_forms(model(s, d)), MODEL + " SELECT text, count(*) AS n, arg_min(doc_id, doc_id * 1000000 + pos) AS first_doc, arg_min(pos, doc_id * 1000000 + pos)::INT AS first_place FROM md WHERE kind = 'word' AND source IN ('identity', 'unresolved') GROUP BY text")
register("tokens_of_kind", lambda s, d: corpus.of_kind(model(s, d), "logogram").select("doc_id", "position", "text"), MODEL + " SELECT doc_id, pos::INT AS position, text FROM md WHERE kind = 'logogram'")
register("word_index", lambda s, d: corpus.word_index(model(s, d)), MODEL + " SELECT text, count(*) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT site) AS sites FROM md GROUP BY text")
register("cooccurring_words", lambda s, d: corpus.cooccurring(model(s, d), s.createDataFrame([("thin",), ("ouan",)], "word string")), MODEL + ", u AS (SELECT DISTINCT doc_id, text FROM md) SELECT DISTINCT a.text AS word, b.text FROM u a JOIN u b USING (doc_id) WHERE a.text IN ('thin', 'ouan') AND a.text <> b.text")


def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.expr("concat('KN:', CAST(c_custkey % 60 AS STRING), ' ', c_mktsegment, '.')").alias("doc_id"), F.col("c_custkey").alias("doc_order"), F.col("c_mktsegment").alias("site"), F.col("c_nationkey").alias("nation"))


CUST = "WITH d AS (SELECT concat('KN:', CAST(c_custkey % 60 AS VARCHAR), ' ', c_mktsegment, '.') AS doc_id, c_custkey AS doc_order, c_mktsegment AS site, c_nationkey AS nation FROM customer)"
register("filter_documents", lambda s, d: corpus.filter_documents(_customers(s, d), site="BUILDING", nation=3), CUST + " SELECT * FROM d WHERE site = 'BUILDING' AND nation = 3")
register("subset_documents", lambda s, d: corpus.subset(_customers(s, d), _customers(s, d).filter("nation = 5")), CUST + " SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM d WHERE nation = 5)")
GAZ = "SELECT concat(' ', c_mktsegment, '  ') AS site, CAST(ascii(c_mktsegment) AS DOUBLE) AS lat, CAST(length(c_mktsegment) AS DOUBLE) AS lon, 'r' AS region FROM customer WHERE c_mktsegment <> 'FURNITURE'"


def _gazetteer(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").filter("c_mktsegment <> 'FURNITURE'").selectExpr("concat(' ', c_mktsegment, '  ') AS site", "CAST(ascii(c_mktsegment) AS DOUBLE) AS lat", "CAST(length(c_mktsegment) AS DOUBLE) AS lon", "'r' AS region").distinct()


register("places", lambda s, d: corpus.to_places(_customers(s, d), _gazetteer(s, d)), CUST + f", g AS (SELECT DISTINCT trim(site) AS site, lat, lon, region FROM ({GAZ})) SELECT d.*, lat, lon, region FROM d JOIN g USING (site)")
register("word_distribution", lambda s, d: corpus.word_distribution(_customers(s, d).withColumn("text", F.col("nation").cast("string")), "7", _gazetteer(s, d)), CUST + f", g AS (SELECT DISTINCT trim(site) AS site, lat, lon FROM ({GAZ})) SELECT site, count(DISTINCT doc_id) AS docs, first(lat) AS lat, first(lon) AS lon FROM d JOIN g USING (site) WHERE nation = 7 GROUP BY site")
LEX = ", lx AS (SELECT text AS headword, 'g' || text AS gloss FROM tok WHERE length(text) = 4 GROUP BY text), wd AS (SELECT DISTINCT text FROM tok)"
register(
    "lexicon_lookup",
    lambda s, d: corpus.lookup(vocabulary(tokens(table(s, d, "documents"))), vocabulary(tokens(table(s, d, "documents"))).filter(F.length("text") == 4).select(F.col("text").alias("headword"), F.concat(F.lit("g"), "text").alias("gloss")), vocabulary(tokens(table(s, d, "documents"))).select("text", F.substring("text", 1, 4).alias("lemma"))),
    TOK + LEX + " SELECT text, coalesce(a.headword, b.headword) AS headword, coalesce(a.gloss, b.gloss) AS gloss FROM wd LEFT JOIN lx a ON a.headword = text LEFT JOIN lx b ON b.headword = left(text, 4)",
)
register("modal_values", lambda s, d: corpus.modal_value(table(s, d, "lineitem"), "l_suppkey", "l_returnflag"), "SELECT l_suppkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1")
register("positional_split", lambda s, d: corpus.split_positional(table(s, d, "documents").select(F.col("doc_id").alias("sentence"))), "WITH c AS (SELECT quantile_cont(doc_id, 0.9) AS c FROM documents) SELECT doc_id AS sentence, CASE WHEN doc_id <= c THEN 'train' ELSE 'dev' END AS part FROM documents, c")
register("brainerd_robinson", lambda s, d: matrix.brainerd_robinson(tokens(table(s, d, "documents")).groupBy("site", "text").agg(F.count("*").alias("n")), "site", "text"), TOK + ", c AS (SELECT site, text, count(*) AS n FROM tok GROUP BY ALL), s AS (SELECT site, text, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY site) AS p FROM c), u AS (SELECT DISTINCT site FROM c) SELECT a, b, coalesce(v, 0) AS similarity FROM (SELECT x.site AS a, y.site AS b FROM u x JOIN u y ON x.site <= y.site) LEFT JOIN (SELECT x.site AS a, y.site AS b, round(2 * sum(least(x.p, y.p)), 4) AS v FROM s x JOIN s y USING (text) GROUP BY ALL) USING (a, b)")

# -- Greek and phonetics --------------------------------------------------------------------
BETA = "translate(regexp_replace(regexp_replace(text, 's([^abgdezhqiklmncoprstufxyw])', 'ς\\1', 'g'), 's$', 'ς'), 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω')"


def _beta(s: SparkSession, d: str) -> DataFrame:
    return vocabulary(tokens(table(s, d, "documents"))).select("text", "n", greek.column(greek.betacode_to_unicode)("text").alias("word"))


register("beta_words", _beta, TOK + f" SELECT text, count(*) AS n, {BETA} AS word FROM tok GROUP BY text")
register("beta_round_trip", lambda s, d: _beta(s, d).filter(~F.col("text").rlike("[^a-z]|[jv]")).select("text", greek.column(greek.unicode_to_betacode)("word").alias("code")), TOK + " SELECT DISTINCT text, text AS code FROM tok WHERE NOT regexp_matches(text, '[^a-z]|[jv]')")
register("plain_words", lambda s, d: vocabulary(tokens(table(s, d, "documents"))).select("text", greek.column(greek.strip_diacritics)("text").alias("plain")), TOK + " SELECT DISTINCT text, strip_accents(text) AS plain FROM tok")
register("syllables", lambda s, d: _beta(s, d).select("word", greek.column(greek.prosody, greek.PROSODY)("word").alias("p")).select("word", "p.*"))
register("greek_tokens", lambda s, d: greek.token_rows(table(s, d, "documents")))
PERIOD = "CASE doc_id % 5 WHEN 0 THEN '480-450 BCE' WHEN 1 THEN 'Third century BC' WHEN 2 THEN '27 BC - 14 AD' WHEN 3 THEN 'Hellenistic' ELSE 'II-III century CE' END"
register(
    "period_bins",
    lambda s, d: table(s, d, "documents").select(greek.column(greek.parse_period, "start int, stop int")(F.expr(PERIOD)).alias("p")).groupBy((F.floor((F.col("p.start") + F.col("p.stop")) / 2 / 100) * 100).alias("bin")).agg(F.count("*").alias("n")),
    f"SELECT CASE doc_id % 5 WHEN 0 THEN -500 WHEN 1 THEN -300 WHEN 2 THEN -100 WHEN 4 THEN 200 END::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1",
)
TAG = "concat(CASE p_size % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN '-' ELSE 'z' END, '3', CASE p_size % 3 WHEN 0 THEN 's' WHEN 1 THEN 'p' ELSE '-' END, 'p---', CASE p_size % 2 WHEN 0 THEN 'n' ELSE '-' END)"
register(
    "postags",
    lambda s, d: table(s, d, "part").select("p_partkey", greek.decode_postag(F.expr(TAG)).alias("m")).select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("pos", "person", "number", "tense", "case", "mood")]),
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' END AS pos, '3' AS person, CASE p_size % 3 WHEN 0 THEN 'sg' WHEN 1 THEN 'pl' END AS number, 'pres' AS tense, CASE p_size % 2 WHEN 0 THEN 'nom' END AS \"case\", NULL::VARCHAR AS mood FROM part",
)
register("reference_keys", lambda s, d: words(s, d).select("text", phonetics.reference_key(F.concat(F.lit("*"), "text", F.lit("₂"))).alias("key")), TOK + " SELECT DISTINCT array_to_string(string_split(text, ''), '-') AS text, text AS key FROM tok")
register("nearest_words", lambda s, d: vocabulary(tokens(table(s, d, "documents"))).select("text", "n", F.round(phonetics.distance_column("text", F.lit("thintion")), 6).alias("distance")).orderBy("distance", "text").limit(20))
register("sequence_similarity", lambda s, d: vocabulary(tokens(table(s, d, "documents"))).filter("NOT text RLIKE '[^a-z]'").select("text", F.round(phonetics.sequence_similarity(F.split("text", ""), F.array(*[F.lit(c) for c in "thintion"])), 6).alias("similarity")), TOK + " SELECT DISTINCT text, round(1 - levenshtein(text, 'thintion') / greatest(length(text), 8)::DOUBLE, 6) AS similarity FROM tok WHERE NOT regexp_matches(text, '[^a-z]')")

# -- matrices ----------------------------------------------------------------------------------


def _sites(s: SparkSession, d: str) -> DataFrame:
    return tokens(table(s, d, "documents")).select("site", F.substring("text", 1, 1).alias("letter")).groupBy("site", "letter").agg(F.count("*").alias("n"))


register("correspondence", lambda s, d: matrix.correspondence_analysis(_sites(s, d), "site", "letter").select("side", "label", *[F.round(c, 6).alias(c) for c in ("x", "y", "mass", "inertia_x", "inertia_y")]))
register("upgma", lambda s, d: matrix.upgma(_sites(s, d), "site", "letter", replicates=20))
register("seriation", lambda s, d: matrix.seriate(_sites(s, d), "site", "letter"))
register("communities", lambda s, d: (lambda e: matrix.label_propagation(e.select(F.col("source").alias("node")).union(e.select("target")), e))(association.cooccurrence_edges(table(s, d, "events").withColumn("hour", F.hour("ts").cast("string")), "user_id", "hour", 1)))
register("sign_embeddings", lambda s, d: matrix.sign_embeddings(words(s, d), 8).select("sign", F.size("vector").alias("dim")))
register("morphological_clusters", lambda s, d: matrix.morphological_clusters(words(s, d)))
