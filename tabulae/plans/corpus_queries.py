"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions.measures import fold
from tabulae.functions.numerals import parse_value, value_sql
from tabulae.functions.text import chi_squared_p, strip_diacritics
from tabulae.operators import association, counts, evaluation, ledgers, sequences
from tabulae.operators.query import Condition, merge, query, search
from tabulae.plans.registry import Query, register
from tabulae.sources.adapter import document_counts, document_sets, line_sets, table, tokens, vocabulary

TOK = """WITH x AS (SELECT doc_id, source AS site, lang AS period, CAST(doc_id % 10 AS VARCHAR) AS scribe, regexp_extract_all(lower(text), '\\p{L}+') AS a FROM documents),
tok AS (SELECT doc_id, site, period, scribe, unnest(a) AS text, CAST(generate_subscripts(a, 1) AS BIGINT) AS pos FROM x)"""
LINES = """WITH y AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
z AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no FROM y),
ltok AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '\\p{L}+')) AS text FROM z)"""
VOCAB = TOK + ", voc AS (SELECT text, count(*) AS n FROM tok GROUP BY text)"
STEPS = """, st AS (SELECT n, unnest(list_transform(range(1, length(w)), lambda i: {'a': w[i:i], 'b': w[i+1:i+1]})) AS s FROM (SELECT n, %s AS w FROM voc)),
pairs AS (SELECT s.a AS a, s.b AS b, CAST(sum(n) AS BIGINT) AS n FROM st GROUP BY 1, 2)"""


def _tok(f) -> Query:
    return lambda spark, d: f(tokens(table(spark, d, "documents")))


def _voc(f) -> Query:
    return lambda spark, d: f(vocabulary(tokens(table(spark, d, "documents"))))


def term(o: str, e: str) -> str:
    return f"(CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END)"


def g2_sql(a: str, b: str, n1: str, n2: str) -> str:
    rate = f"(({a} + {b})::DOUBLE / ({n1} + {n2}))"
    return f"(2 * ({term(f'{a}::DOUBLE', f'{n1} * {rate}')} + {term(f'{b}::DOUBLE', f'{n2} * {rate}')}))"


def llr_sql(j: str, a: str, b: str, t: str) -> str:
    cells = [(f"({j})::DOUBLE", f"{a}::DOUBLE * {b} / {t}"), (f"({a} - {j})::DOUBLE", f"{a}::DOUBLE * ({t} - {b}) / {t}"), (f"({b} - {j})::DOUBLE", f"({t} - {a})::DOUBLE * {b} / {t}"), (f"({t} - {a} - {b} + {j})::DOUBLE", f"({t} - {a})::DOUBLE * ({t} - {b}) / {t}")]
    return f"(CASE WHEN {a} <= 0 OR {b} <= 0 OR {a} >= {t} OR {b} >= {t} THEN 0 ELSE 2 * ({' + '.join(term(*c) for c in cells)}) END)"


def wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"(({k})::DOUBLE / ({n}))"
    z = 1.96
    edge = f"(({p} + {z * z / 2} / ({n})) / (1 + {z * z} / ({n})) {sign} {z} * sqrt({p} * (1 - {p}) / ({n}) + {z * z / 4} / (({n}) * ({n}))) / (1 + {z * z} / ({n})))"
    return f"greatest(0.0, {edge})" if sign == "-" else f"least(1.0, {edge})"


# -- counts ------------------------------------------------------------------------------
register("word_frequencies", _tok(counts.word_frequencies), TOK + " SELECT text, count(*) AS n FROM tok GROUP BY text")
register("top_words", _tok(lambda t: counts.word_frequencies(t).orderBy(F.desc("n"), "text").limit(100)), TOK + " SELECT text, count(*) AS n FROM tok GROUP BY text ORDER BY n DESC, text LIMIT 100")
DISP = """, p AS (SELECT {item} AS item, {part} AS part, count(*) AS c FROM {rows} GROUP BY 1, 2), s AS (SELECT part, sum(c) / (SELECT sum(c) FROM p)::DOUBLE AS share FROM p GROUP BY part),
f AS (SELECT item, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY item HAVING sum(c) >= {least})
SELECT item, first(n) AS n, count(*) AS parts, round(0.5 * (sum(abs(c / n::DOUBLE - share)) + 1 - sum(share)), 6) AS dp FROM p JOIN f USING (item) JOIN s USING (part) GROUP BY item"""
register("dispersions", lambda s, d: counts.document_dispersions(document_counts(table(s, d, "documents")), 5), TOK + DISP.format(item="text", part="doc_id", rows="tok", least=5))
register("dispersion_by_site", _tok(lambda t: counts.dispersions(t, 5, part="site")), TOK + DISP.format(item="text", part="site", rows="tok", least=5))
register("event_dispersion", lambda s, d: counts.dispersions(table(s, d, "events"), 1, "event_type", "user_id"), "WITH a AS (SELECT 1)" + DISP.format(item="event_type", part="user_id", rows="events", least=1))
KEY = """, c AS (SELECT text, count(*) FILTER ({cond}) AS a, count(*) FILTER (NOT ({cond})) AS b FROM tok GROUP BY text), t AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM c)
SELECT text, a, b, round({g2}, 4) AS g2, round(log2(((CASE WHEN a = 0 THEN 0.5 ELSE a END) / n1) / ((CASE WHEN b = 0 THEN 0.5 ELSE b END) / n2)), 6) AS log_ratio FROM c, t WHERE a >= 3 OR b >= 3"""
for name, cond in (("keyness", "period = 'en'"), ("hand_keyness", "scribe = '3'"), ("site_keyness", "site = 'src0'")):
    register(name, _tok(lambda t, c=cond: counts.keyness(t, c)), TOK + KEY.format(cond=cond, g2=g2_sql("a", "b", "n1", "n2")))
PER = ", c AS (SELECT {by}, text, count(*) AS n FROM tok GROUP BY ALL) "
register(
    "entropy",
    _tok(lambda t: counts.entropy(t.groupBy("period", "text").agg(F.count("*").alias("n")), "period")),
    TOK + PER.format(by="period") + "SELECT period, count(*) AS types, CAST(sum(n) AS BIGINT) AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) + CASE WHEN count(*) > 1 THEN (count(*) - 1) / (2 * sum(n) * ln(2)) ELSE 0 END, 6) AS miller_madow FROM c GROUP BY period",
)
register(
    "chao1",
    _tok(lambda t: counts.chao1(t.groupBy("site", "text").agg(F.count("*").alias("n")), "site")),
    TOK + PER.format(by="site") + "SELECT site, count(*) AS types, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2, round(count(*) + CASE WHEN count(*) FILTER (n = 2) > 0 THEN (count(*) FILTER (n = 1)) * (count(*) FILTER (n = 1)) / (2.0 * count(*) FILTER (n = 2)) ELSE (count(*) FILTER (n = 1)) * (count(*) FILTER (n = 1) - 1) / 2.0 END, 6) AS chao1 FROM c GROUP BY site",
)
register(
    "heaps",
    _tok(lambda t: counts.heaps(t, "period")),
    TOK + """, s AS (SELECT period, doc_id, count(*) AS size FROM tok GROUP BY ALL), f AS (SELECT period, doc_id, count(*) AS fresh FROM (SELECT period, text, min(doc_id) AS doc_id FROM tok GROUP BY 1, 2) GROUP BY ALL),
p AS (SELECT period, ln(sum(size) OVER w) AS x, ln(sum(coalesce(fresh, 0)) OVER w) AS y FROM s LEFT JOIN f USING (period, doc_id) WINDOW w AS (PARTITION BY period ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT period, count(*) AS points, round(regr_slope(y, x), 6) AS beta, round(exp(regr_intercept(y, x)), 4) AS k, round(regr_r2(y, x), 6) AS r2 FROM p GROUP BY period HAVING count(*) >= 5""",
)
register(
    "spearman",
    lambda s, d: counts.spearman(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"),
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(x, y), 0) END, 6) AS rho FROM r GROUP BY l_returnflag""",
)
register(
    "mattr",
    _tok(lambda t: counts.mattr(t, 50)),
    TOK + """, b AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS size, lag(pos) OVER (PARTITION BY doc_id, text ORDER BY pos) AS before FROM tok),
c AS (SELECT doc_id, size, greatest(0, least(pos, size - 49) - greatest(pos - 49, coalesce(before + 1, 1), 1) + 1) AS adds FROM b WHERE size >= 50)
SELECT doc_id, first(size) AS size, round(sum(adds) / (50 * (first(size) - 49.0)), 6) AS mattr FROM c GROUP BY doc_id""",
)
register(
    "rarity",
    _tok(lambda t: counts.rarity(t, vocabulary(t.filter("site = 'src0'")))),
    TOK + """, r AS (SELECT text, count(*) AS n FROM tok WHERE site = 'src0' GROUP BY text)
SELECT doc_id, count(*) AS words, round(avg(1 - ln(1 + coalesce(n, 0)) / ln(1 + (SELECT max(n) FROM r))), 6) AS rarity FROM tok LEFT JOIN r USING (text) GROUP BY doc_id""",
)
# -- associations ------------------------------------------------------------------------
register(
    "assoc",
    lambda s, d: association.assoc(document_sets(table(s, d, "documents")), "thin"),
    TOK + f""", u AS (SELECT DISTINCT doc_id, text FROM tok), w AS (SELECT doc_id FROM u WHERE text = 'thin'), k AS (SELECT (SELECT count(DISTINCT doc_id) FROM tok) AS total, (SELECT count(*) FROM w) AS left_n),
j AS (SELECT text, count(*) AS joint FROM u WHERE doc_id IN (SELECT doc_id FROM w) AND text <> 'thin' GROUP BY text), r AS (SELECT text, count(*) AS right_n FROM u GROUP BY text)
SELECT text, joint, right_n, round(CASE WHEN left_n::DOUBLE * right_n * (total - left_n) * (total - right_n) <= 0 THEN 0 ELSE total * pow(greatest(0.0, abs(joint::DOUBLE * (total - left_n - right_n + joint) - (left_n - joint)::DOUBLE * (right_n - joint)) - total / 2.0), 2) / (left_n::DOUBLE * right_n * (total - left_n) * (total - right_n)) END, 4) AS chi2,
round({llr_sql('joint', 'left_n', 'right_n', 'total')}, 4) AS g2, round(log2(joint::DOUBLE * total / (left_n::DOUBLE * right_n)), 6) AS pmi FROM j JOIN r USING (text), k""",
)
register("cooccur", _tok(lambda t: association.cooccur(t, "thin")), TOK + " SELECT text, count(DISTINCT doc_id) AS docs FROM tok WHERE text <> 'thin' AND doc_id IN (SELECT doc_id FROM tok WHERE text = 'thin') GROUP BY text ORDER BY docs DESC, text LIMIT 50")
EDGES = """ u AS (SELECT DISTINCT {unit} AS unit, {item} AS item FROM {rows}), k AS (SELECT item FROM u GROUP BY item HAVING count(*) >= {least}), v AS (SELECT unit, item FROM u WHERE item IN (SELECT item FROM k))
SELECT a.item AS source, b.item AS target, count(*) AS weight FROM v a JOIN v b ON a.unit = b.unit AND a.item < b.item GROUP BY ALL HAVING count(*) >= {least}"""
register("event_graph", lambda s, d: association.cooccurrence_edges(table(s, d, "events"), "user_id", "event_type", 2), "WITH" + EDGES.format(unit="user_id", item="event_type", rows="events", least=2))
register("part_graph", lambda s, d: association.cooccurrence_edges(table(s, d, "lineitem"), "l_orderkey", "l_partkey", 2), "WITH" + EDGES.format(unit="l_orderkey", item="l_partkey", rows="lineitem", least=2))
register(
    "line_pmi",
    lambda s, d: association.line_pmi(line_sets(table(s, d, "documents")), "the", 2),
    LINES + """, u AS (SELECT DISTINCT doc_id, line_no, text FROM ltok), a AS (SELECT doc_id, line_no FROM u WHERE text = 'the'), k AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, line_no FROM u)) AS total, (SELECT count(*) FROM a) AS anchor_n),
n AS (SELECT text, count(*) AS n FROM u WHERE text <> 'the' GROUP BY text), j AS (SELECT text, count(*) AS joint FROM u JOIN a USING (doc_id, line_no) WHERE text <> 'the' GROUP BY text HAVING count(*) >= 2)
SELECT text, joint, n, round(log2(joint::DOUBLE * total / (n::DOUBLE * anchor_n)), 6) AS pmi FROM j JOIN n USING (text), k""",
)
register(
    "exclusivity",
    _tok(lambda t: association.exclusivity(t, "text", "period", 5)),
    TOK + f""", p AS (SELECT text AS item, period, count(*) AS n FROM tok GROUP BY ALL), b AS (SELECT item, CAST(sum(n) AS BIGINT) AS total, max({{'n': n, 'period': period}}) AS top FROM p GROUP BY item HAVING sum(n) >= 5)
SELECT item, total, top.period AS top_group, round(top.n / total::DOUBLE, 6) AS share, round({wilson_sql('top.n', 'total', '-')}, 6) AS low, round({wilson_sql('top.n', 'total', '+')}, 6) AS high FROM b""",
)
register(
    "divergence",
    _tok(lambda t: association.divergence(vocabulary(t.filter("period = 'en'")), vocabulary(t.filter("period = 'fr'")), "text")),
    TOK + """, l AS (SELECT text, count(*) AS l FROM tok WHERE period = 'en' GROUP BY text), r AS (SELECT text, count(*) AS r FROM tok WHERE period = 'fr' GROUP BY text)
SELECT text, l, r, round(log2(((l + 0.5) / ((SELECT sum(l) FROM l) + 0.5)) / ((r + 0.5) / ((SELECT sum(r) FROM r) + 0.5))), 6) AS log_ratio FROM l JOIN r USING (text)""",
)
register(
    "cosine_neighbours",
    lambda s, d: association.cosine_neighbours(table(s, d, "embeddings"), table(s, d, "embeddings").filter("vec_id % 20 = 0")),
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT q, v, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS rank FROM s) WHERE rank <= 5""",
)
# -- sequences ---------------------------------------------------------------------------
register("transitions", _voc(sequences.transitions), VOCAB + STEPS % "'^' || text || '$'" + " SELECT * FROM pairs")
register(
    "bigram_pmi",
    _voc(sequences.bigram_pmi),
    VOCAB + STEPS % "text" + """, l AS (SELECT a, sum(n) AS l FROM pairs GROUP BY a), r AS (SELECT b, sum(n) AS r FROM pairs GROUP BY b)
SELECT a, b, n, round(log2(n::DOUBLE * (SELECT sum(n) FROM pairs) / (l::DOUBLE * r)), 6) AS pmi FROM pairs JOIN l USING (a) JOIN r USING (b)""",
)
register(
    "edge_bias",
    _voc(sequences.edge_bias),
    VOCAB + f""", s AS (SELECT n, length(text) AS size, unnest(string_split(text, '')) AS sign, unnest(range(length(text))) AS k FROM voc WHERE length(text) >= 3),
c AS (SELECT sign, CAST(coalesce(sum(n) FILTER (k = 0 OR k = size - 1), 0) AS BIGINT) AS edge_n, CAST(coalesce(sum(n) FILTER (k > 0 AND k < size - 1), 0) AS BIGINT) AS inner_n FROM s GROUP BY sign), t AS (SELECT sum(edge_n)::DOUBLE AS et, sum(inner_n)::DOUBLE AS it FROM c)
SELECT sign, edge_n, inner_n, round((CASE WHEN edge_n / et >= inner_n / it THEN 1 ELSE -1 END) * {g2_sql('edge_n', 'inner_n', 'et', 'it')}, 3) AS bias FROM c, t""",
)
register("productivity", _voc(sequences.productivity), VOCAB + " SELECT right(text, 3) AS suffix, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n = 1) AS hapaxes, round(count(*) FILTER (n = 1) / sum(n)::DOUBLE, 6) AS productivity FROM voc WHERE length(text) > 3 GROUP BY 1")
register(
    "surprisal",
    _voc(sequences.witten_bell_surprisal),
    VOCAB + """, o AS (SELECT text, n, s.a AS a, s.b AS b, count(*) AS m FROM (SELECT text, n, unnest(list_transform(range(1, length(text) + 2), lambda i: {'a': ('^' || text || '$')[i:i], 'b': ('^' || text || '$')[i+1:i+1]})) AS s FROM voc) GROUP BY ALL),
p AS (SELECT a, b, sum(m * n)::DOUBLE AS ab FROM o GROUP BY ALL), l AS (SELECT a, sum(ab) AS a_n, count(*) AS a_types FROM p GROUP BY a), r AS (SELECT b, sum(ab) AS b_n FROM p GROUP BY b), own AS (SELECT text, a, sum(m * n)::DOUBLE AS own_a FROM o GROUP BY ALL),
q AS (SELECT text, m, (b_n - m * n + 1.0) / ((SELECT sum(ab) FROM p) - m * n + 100.0) AS base, a_types - CASE WHEN ab = m * n THEN 1 ELSE 0 END AS types, a_n - own_a AS c_a, ab - m * n AS c_ab FROM o JOIN own USING (text, a) JOIN p USING (a, b) JOIN l USING (a) JOIN r USING (b)),
w AS (SELECT text, m, CASE WHEN c_a + types > 0 THEN (c_ab + types * base) / (c_a + types) ELSE base END AS p0, base FROM q)
SELECT text, CAST(sum(m) AS BIGINT) AS steps, round(sum(-log2(CASE WHEN p0 > 0 THEN p0 ELSE base END) * m) / sum(m), 5) AS bits FROM w GROUP BY text""",
)
register(
    "line_position",
    lambda s, d: line_positions(line_tokens_with_place(table(s, d, "documents"))),
    LINES + """, q AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '\\p{L}+') AS a FROM z), r AS (SELECT unnest(a) AS text, unnest(range(len(a))) AS k, len(a) AS size FROM q)
SELECT text, count(*) FILTER (k = 0) AS first_n, count(*) FILTER (k = size - 1) AS last_n, count(*) FILTER (k > 0 AND k < size - 1) AS medial_n FROM r GROUP BY text""",
)


def line_tokens_with_place(documents: DataFrame) -> DataFrame:
    """(text, first, last): words with whether they begin or end their line. A line's words are found
    once: they are bound to a name inside the expression, which no plan can take apart."""
    words = lambda line: F.array(F.regexp_extract_all(F.lower(line), F.lit("(\\p{L}+)"), F.lit(1)))
    placed = lambda w: F.transform(w, lambda x, k: F.struct(x.alias("text"), (k == 0).alias("first"), (k == F.size(w) - 1).alias("last")))
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.explode(F.flatten(F.transform(words("line"), placed))).alias("x")).select("x.*")


def line_positions(rows: DataFrame) -> DataFrame:
    """Counts of each word in the first, last and other places of lines; a lone word is both."""
    return rows.groupBy("text").agg(F.count_if("first").alias("first_n"), F.count_if("last").alias("last_n"), F.count_if(~F.col("first") & ~F.col("last")).alias("medial_n"))


# -- queries, search, sets ---------------------------------------------------------------
C = Condition
QUERIES = {
    "query_fold": ([C("site-is", "src0"), C("period-is", "fr", "OR"), C("id-contains", "7", "AND", True), C("word-prefix", "the"), C("word-suffix", "ing", "AND")], "documents", "((site = 'src0' OR period = 'fr') AND NOT contains(CAST(doc_id AS VARCHAR), '7')) AND (starts_with(upper(text), 'THE') AND ends_with(upper(text), 'ING'))"),
    "query_words": ([C("period-is", "de"), C("scribe-is", "3", "OR"), C("word-contains", "ung"), C("word-prefix", "en", "OR"), C("word-suffix", "s", "AND", True)], "words", "(period = 'de' OR scribe = '3') AND ((contains(upper(replace(text, 'ß', 'ss')), 'UNG') OR starts_with(upper(text), 'EN')) AND NOT ends_with(upper(replace(text, 'ß', 'ss')), 'S'))"),
    "query_contains_word": ([C("ins-contains-word", "thin"), C("ins-contains-word", "ouan", "OR"), C("site-is", "src3", "AND", True)], "documents", "(doc_id IN (SELECT doc_id FROM tok WHERE text = 'thin') OR doc_id IN (SELECT doc_id FROM tok WHERE text = 'ouan')) AND NOT site = 'src3'"),
    "query_empty_value": ([C("site-is", ""), C("word-prefix", "thin")], "documents", "starts_with(text, 'thin')"),
    "query_cooccurs": ([C("period-is", "en"), C("word-cooccurs-with", "thin"), C("word-prefix", "a")], "words", "period = 'en' AND starts_with(text, 'a') AND text <> 'thin' AND text IN (SELECT text FROM tok WHERE doc_id IN (SELECT doc_id FROM tok WHERE text = 'thin'))"),
}
for name, (conditions, output, where) in QUERIES.items():
    tail = f" SELECT text, count(DISTINCT doc_id) AS docs FROM tok WHERE {where} GROUP BY text" if output == "words" else f" SELECT DISTINCT doc_id FROM tok WHERE {where}"
    register(name, _tok(lambda t, c=conditions, o=output: query(t, c, o)), TOK + tail)
HYPHENS = "array_to_string(string_split(text, ''), '-')"


def _hyphenated(t: DataFrame) -> DataFrame:
    return t.withColumn("text", F.array_join(F.split("text", ""), "-"))


register(
    "sign_pattern",
    _tok(lambda t: query(_hyphenated(t), [C("word-sign-pattern", "t-*-e-**-n"), C("word-min-syllables", 5), C("word-max-syllables", 8), C("word-contains-sign", "a")], "words")),
    TOK + f", h AS (SELECT doc_id, upper({HYPHENS}) AS u, {HYPHENS} AS text, length(text) AS k FROM tok) SELECT text, count(DISTINCT doc_id) AS docs FROM h WHERE regexp_full_match('-' || u, '-T-[^-]*-E(?:-[^-]*)*-N') AND k BETWEEN 5 AND 8 AND contains(u, 'A') GROUP BY text",
)
register("search_token", _tok(lambda t: search(t, "Ción")), TOK + " SELECT doc_id, pos, text FROM tok WHERE translate(lower(text), 'ς', 'σ') = 'ción'")
register("search_substring", _tok(lambda t: search(t, "Queau", "substring")), TOK + " SELECT doc_id, pos, text FROM tok WHERE contains(translate(lower(text), 'ς', 'σ'), 'queau')")
register(
    "merge_first",
    lambda s, d: merge([table(s, d, "documents").filter("lang = 'en'").select(F.col("source").alias("id"), "lang").distinct(), table(s, d, "documents").filter("lang <> 'en'").groupBy(F.col("source").alias("id")).agg(F.min("lang").alias("lang"))], "id", "first"),
    "SELECT id, lang FROM (SELECT DISTINCT source AS id, lang, 0 AS k FROM documents WHERE lang = 'en' UNION ALL SELECT source, min(lang), 1 FROM documents WHERE lang <> 'en' GROUP BY source) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1",
)
register(
    "merge_suffix",
    lambda s, d: merge([table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))], "id", "suffix"),
    "SELECT CASE WHEN n = 1 THEN CAST(id AS VARCHAR) ELSE CAST(id AS VARCHAR) || '#' || CAST(n AS VARCHAR) END AS id FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM (SELECT c_custkey AS id, 0 AS k FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier))",
)
# -- ledgers -----------------------------------------------------------------------------


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("line_no"), F.lit("item").alias("role"), F.round("l_extendedprice", 2).alias("value"))
    last = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1000).cast("long").alias("line_no"), F.lit("total").alias("role"), F.round("o_totalprice", 2).alias("value"))
    return items.unionByName(last)


register(
    "check_balances",
    lambda s, d: ledgers.check_balances(_ledger(s, d)),
    """WITH i AS (SELECT l_orderkey AS doc_id, sum(round(l_extendedprice, 2)) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, 1000::BIGINT AS line_no, 'total' AS role, round(o_totalprice, 2) AS stated, round(coalesce(v, 0), 2) AS computed, abs(round(o_totalprice, 2) - coalesce(v, 0)) <= 0.01 AS balanced FROM orders LEFT JOIN i ON doc_id = o_orderkey""",
)
register(
    "metrology",
    lambda s, d: ledgers.metrology(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice"),
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sum(v), 2) AS total, round(count(*) FILTER (v <> floor(v)) / count(*)::DOUBLE, 6) AS fractional, first(v) FILTER (k = n // 2) AS upper_median FROM r GROUP BY l_returnflag""",
)
# -- evaluation --------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", "quality", "toxic", ((F.col("doc_id") * 37 % 101) / 101.0).alias("p"))


SCORED = "WITH s AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 101) / 101.0::DOUBLE AS p FROM labels)"
register("ece", lambda s, d: evaluation.expected_calibration_error(_scored(s, d), "p", "quality"), SCORED + ", b AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, abs(avg(p) - avg(quality)) AS gap FROM s GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
register("brier", lambda s, d: evaluation.brier(_scored(s, d), "p", "quality"), SCORED + " SELECT count(*) AS n, round(avg(pow(p - quality, 2)), 6) AS brier FROM s")
register(
    "mcnemar",
    lambda s, d: evaluation.mcnemar(_scored(s, d), "quality", "toxic"),
    SCORED + ", c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM s) SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 0 ELSE pow(greatest(0, abs(only_a - only_b) - 1), 2) / (only_a + only_b) END, 6) AS chi2 FROM c",
)
register(
    "coverage_risk",
    lambda s, d: evaluation.coverage_risk(_scored(s, d), "p", "quality", [0.1, 0.25, 0.5, 0.75, 0.9]),
    SCORED + " SELECT threshold, count(*) FILTER (p >= threshold) AS accepted, round(count(*) FILTER (p >= threshold) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (p >= threshold AND quality = 0) / nullif(count(*) FILTER (p >= threshold), 0)::DOUBLE, 6) AS risk FROM s, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold) GROUP BY threshold",
)
register("confusion", lambda s, d: evaluation.confusion(table(s, d, "labels"), "quality", "toxic"), "SELECT quality AS gold, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
register(
    "accuracy",
    lambda s, d: evaluation.accuracy(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id"), "quality", "toxic", "lang"),
    f"WITH a AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = toxic) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, hits, round(hits / n::DOUBLE, 6) AS accuracy, round({wilson_sql('hits', 'n', '-')}, 6) AS low, round({wilson_sql('hits', 'n', '+')}, 6) AS high FROM a",
)
register(
    "merge_reviews",
    lambda s, d: evaluation.merge_reviews([table(s, d, "labels").select("doc_id", F.col("quality").alias("value")), table(s, d, "labels").select("doc_id", F.col("toxic").alias("value"))], "doc_id", "value"),
    "SELECT doc_id, count(*) AS reviews, CASE WHEN count(DISTINCT value) = 1 THEN 'agreed' ELSE 'conflict' END AS state, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM (SELECT doc_id, quality AS value FROM labels UNION ALL SELECT doc_id, toxic FROM labels) GROUP BY doc_id",
)
PROFILE = """, c AS (SELECT {by}, text, count(*) AS n FROM tok GROUP BY ALL), r AS (SELECT {by}, text, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, text) AS r FROM c), t AS (SELECT {by}, string_agg(text, ',' ORDER BY r) AS top_words FROM r WHERE r <= 3 GROUP BY {by})
SELECT {by}, count(*) AS tokens, count(DISTINCT doc_id) AS docs, count(DISTINCT text) AS types, first(top_words) AS top_words FROM tok JOIN t USING ({by}) GROUP BY {by}"""
for name, by in (("scribal_hands", "scribe"), ("site_profile", "site"), ("period_profile", "period")):
    register(name, _tok(lambda t, b=by: evaluation.label_profile(t, b)), TOK + PROFILE.format(by=by))
# -- bins, numerals, dossiers ------------------------------------------------------------
register("timeline_bins", lambda s, d: table(s, d, "events").groupBy((F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("bin")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")), "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bin, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
register("numerals", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\\s+")).alias("token")).select("doc_id", "token", parse_value(F.col("token")).alias("value")).filter("value IS NOT NULL"), f"SELECT doc_id, token, {value_sql('token')} AS value FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents) WHERE {value_sql('token')} IS NOT NULL")
register("dossiers", lambda s, d: counts.group_heads(table(s, d, "documents"), ["source", "lang"], "doc_id", "n_chars"), "SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') AS first_docs FROM documents GROUP BY ALL")
register("split_tokens_unseen", _tok(lambda t: t.filter("doc_id % 10 = 9").select("text").distinct().join(t.filter("doc_id % 10 <> 9").select("text").distinct(), "text", "left_anti")), TOK + " SELECT DISTINCT text FROM tok WHERE doc_id % 10 = 9 AND text NOT IN (SELECT text FROM tok WHERE doc_id % 10 <> 9)")
register("bridge_coverage", _tok(lambda t: counts.coverage(t, "site = 'src0'", 3, "period")), TOK + ", k AS (SELECT text FROM tok WHERE site = 'src0' GROUP BY text HAVING count(*) >= 3) SELECT period, count(*) AS tokens, count(k.text) AS known FROM tok LEFT JOIN k USING (text) GROUP BY period")
register("search_fold_counts", _tok(lambda t: t.select(fold(F.col("text")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))), TOK + " SELECT translate(lower(text), 'ς', 'σ') AS text, count(*) AS n FROM tok GROUP BY 1")
register("sentences", lambda s, d: _sentences(s, d), "SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS sentence, unnest(a) AS text FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.;·!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS a FROM documents)")
register("hourly_counts", lambda s, d: _hourly(s, d), "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
register("stripped_words", _tok(lambda t: t.select(strip_diacritics(F.col("text")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))), TOK + " SELECT translate(text, 'àáâäãåèéêëìíîïòóôöõùúûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy') AS text, count(*) AS n FROM tok GROUP BY 1")
register("assoc_p_values", lambda s, d: association.assoc(document_sets(table(s, d, "documents")), "thin").select("text", "chi2", F.round(chi_squared_p("chi2"), 6).alias("p")))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    from tabulae.streaming.sentences import sentences

    return sentences(table(spark, d, "documents"))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    from tabulae.streaming.sentences import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type").select("event_type", F.unix_timestamp("start").alias("hour"), "n")
