"""Queries over accounts made from the order tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions.numerals import format_value, is_numeral_token, is_value_token, value_sql
from tabulae.operators import accounts
from tabulae.plans.registry import register
from tabulae.sources.adapter import table

HEAD = "CASE l_partkey % 9 WHEN 0 THEN 'KU-RO' WHEN 1 THEN 'ki-ro' WHEN 2 THEN 'A-DU' WHEN 3 THEN 'PA-I-TO' WHEN 4 THEN '*306-TU' WHEN 5 THEN 'PO-TO-KU-RO' WHEN 6 THEN 'DA-ME' WHEN 7 THEN 'te' ELSE 'QA-*410-VAS' END"
GOODS = "CASE l_suppkey % 7 WHEN 0 THEN 'GRA' WHEN 1 THEN 'VIN+RA' WHEN 2 THEN 'OVISm' WHEN 3 THEN '*304' WHEN 4 THEN '[OLE]?' WHEN 5 THEN '—' ELSE 'A-DU' END"
NUMBER = "CASE l_linenumber % 6 WHEN 0 THEN '½' WHEN 1 THEN '3/4' WHEN 2 THEN '≈ 5' WHEN 3 THEN 'x' WHEN 4 THEN '¹⁄₈' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END"
LINES = f"WITH ln AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line_no, [{HEAD}, {GOODS}, {NUMBER}] AS tokens FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)), tk AS (SELECT doc_id, line_no, unnest(tokens) AS t FROM ln)"
SKIP = "('\U00010101', '\U0001076b', '—', '≈')"
IDEO = "regexp_matches(t, '^[A-Z*][A-Z0-9*+''\\[\\]?]*$')"
V = value_sql("t")
AMONG = "lower(t) IN ({})".format
TERM = f"({V} IS NULL AND t NOT IN {SKIP} AND (contains(t, '-') OR NOT {IDEO}))"
PARSED = (
    LINES
    + f""", pv AS MATERIALIZED (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no) AS k, t, {V} AS v, {TERM} AS term FROM tk),
pl AS (SELECT doc_id, line_no, coalesce(sum(v), 0.0) AS value, bool_or(v IS NOT NULL) AS has_number, count(*) FILTER (term) AS terms, count(*) FILTER (v IS NULL AND t NOT IN {SKIP} AND NOT term) AS ideograms,
bool_or(term AND {AMONG("'po-to-ku-ro'")}) AS g, bool_or(term AND {AMONG("'ku-ro', 'ku-ra'")}) AS tt, bool_or(term AND {AMONG("'ki-ro', 'ku-ro₂'")}) AS df FROM pv GROUP BY ALL),
al AS (SELECT *, CASE WHEN g THEN 'grand-total' WHEN tt THEN 'total' WHEN df THEN 'deficit' WHEN NOT has_number THEN 'header' ELSE 'item' END AS role FROM pl)"""
)
HEADSQL = """CASE WHEN contains({0}, '-') THEN NULL WHEN {1} IN ({2}) THEN {1} WHEN regexp_replace({1}, '[mf]$', '') IN ({2}) THEN regexp_replace({1}, '[mf]$', '') END"""


def head_sql(t: str) -> str:
    first = f"regexp_replace(string_split({t}, '+')[1], '[\\[\\]?''\"]', '', 'g')"
    return HEADSQL.format(t, first, ", ".join(f"'{c}'" for c in accounts.COMMODITIES))


def lexical_sql(t: str) -> str:
    num = "regexp_extract(p, '^\\*([0-9]+)', 1)"
    return f"(contains({t}, '-') AND NOT regexp_matches({t}, '[+\\[\\]?]') AND len(list_filter(string_split({t}, '-'), lambda p: {head_sql('p')} IS NOT NULL OR coalesce(TRY_CAST({num} AS DOUBLE), 0) >= 400)) = 0 AND len(list_filter(string_split({t}, '-'), lambda p: {num} = '')) > 0)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    # an order's lines come together once, for all that follows
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("line_no"), F.array(F.expr(HEAD), F.expr(GOODS), F.expr(NUMBER)).alias("tokens"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", F.explode("tokens").alias("text"))


register(
    "account_lines",
    lambda s, d: accounts.parse_lines(lines(s, d)).select("doc_id", "line_no", F.size("terms").cast("long").alias("terms"), F.size("ideograms").cast("long").alias("ideograms"), F.round("value", 6).alias("value"), "has_number", "role"),
    PARSED + " SELECT doc_id, line_no, terms, ideograms, round(value, 6) AS value, has_number, role FROM al",
)
register(
    "balance_check",
    lambda s, d: accounts.balance_check(lines(s, d)).select("doc_id", "line_no", "role", F.round("stated", 6).alias("stated"), F.round("computed", 6).alias("computed"), "items", "balances"),
    PARSED
    + """, c AS (SELECT *, count(*) FILTER (role IN ('total', 'grand-total')) OVER w AS sec, count(*) FILTER (role = 'grand-total') OVER w AS gsec FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, coalesce(sum(value) FILTER (role = 'item' AND has_number) OVER (PARTITION BY doc_id, sec), 0) + CASE WHEN role = 'grand-total' THEN coalesce(sum(value) FILTER (role = 'total') OVER (PARTITION BY doc_id, gsec), 0) ELSE 0 END AS computed,
count(*) FILTER (role = 'item' AND has_number) OVER (PARTITION BY doc_id, sec) + CASE WHEN role = 'grand-total' THEN count(*) FILTER (role = 'total') OVER (PARTITION BY doc_id, gsec) ELSE 0 END AS items FROM c)
SELECT doc_id, line_no, role, round(value, 6) AS stated, round(computed, 6) AS computed, items, abs(computed - value) < 1e-6 AS balances FROM x WHERE role IN ('total', 'grand-total')""",
)
register(
    "checkable_accounts",
    lambda s, d: accounts.checkable_accounts(lines(s, d), tokens(s, d).withColumn("status", F.when(F.col("doc_id") % 11 == 0, "lost").otherwise("certain"))),
    PARSED
    + """, c AS (SELECT *, count(*) FILTER (role IN ('total', 'grand-total')) OVER w AS sec, count(*) FILTER (role = 'grand-total') OVER w AS gsec FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, coalesce(sum(value) FILTER (role = 'item' AND has_number) OVER (PARTITION BY doc_id, sec), 0) + CASE WHEN role = 'grand-total' THEN coalesce(sum(value) FILTER (role = 'total') OVER (PARTITION BY doc_id, gsec), 0) ELSE 0 END AS computed FROM c)
SELECT DISTINCT doc_id FROM x WHERE role IN ('total', 'grand-total') AND abs(computed - value) <= greatest(1.0, 0.1 * abs(value)) AND doc_id % 11 <> 0 AND doc_id NOT IN (SELECT doc_id FROM tk WHERE regexp_matches(t, '[\\[\\]]'))""",
)
FLAGS = "nums AS (SELECT doc_id, bool_or(regexp_matches(t, '^[0-9]')) AS nums, bool_or(t = 'KU-RO') AS total, bool_or(t = 'JA-SA-SA-RA-ME') AS formula, count(*) FILTER (contains(t, '-')) AS multi FROM tk GROUP BY doc_id), st AS (SELECT doc_id, CASE WHEN total OR (nums AND multi > 2) THEN 'accounting' WHEN formula THEN 'libation' WHEN multi > 4 AND NOT nums THEN 'text' ELSE 'other' END AS structure FROM nums)"
register("structure_classes", lambda s, d: accounts.classify_structure(tokens(s, d)), LINES + ", " + FLAGS + " SELECT * FROM st")
register("structure_counts", lambda s, d: accounts.structure_counts(tokens(s, d)), LINES + ", " + FLAGS + " SELECT k AS structure, count(st.doc_id) AS docs FROM (SELECT unnest(['accounting', 'libation', 'list', 'text', 'other']) AS k) LEFT JOIN st ON k = structure GROUP BY k")
register(
    "token_predicates",
    lambda s, d: tokens(s, d).select("text").distinct().select("text", is_value_token(F.col("text")).alias("is_value"), is_numeral_token(F.col("text")).alias("is_numeral"), accounts.commodity_head(F.col("text")).alias("head"), accounts.is_undeciphered_logogram(F.col("text")).alias("undeciphered"), accounts.is_lexical_word(F.col("text")).alias("lexical")),
    LINES + f" SELECT DISTINCT t AS text, {V} IS NOT NULL AS is_value, regexp_matches(t, '^[0-9¹²³⁴⁵⁶⁷⁸⁹⁰⅟₁₂₃₄₅₆₇₈₉₀≈\U00010101]+$') AS is_numeral, {head_sql('t')} AS head, regexp_matches(t, '^\\*[0-9]') AS undeciphered, {lexical_sql('t')} AS lexical FROM tk",
)
ENTRIES = f""", hd AS (SELECT doc_id, line_no, list_filter(tokens, lambda x: {lexical_sql('x')})[1] AS head, tokens FROM ln), ft AS (SELECT *, tokens[list_position(tokens, head) + 1:] AS rest FROM hd WHERE head IS NOT NULL AND lower(head) NOT IN ('ku-ro', 'ku-ra', 'po-to-ku-ro', 'ki-ro', 'ku-ro₂')),
fx AS (SELECT doc_id, line_no, head, unnest(rest) AS t, generate_subscripts(rest, 1) AS k FROM ft), en AS (SELECT doc_id, line_no, head, sum({V}) AS value, count(CASE WHEN {head_sql('t')} IS NOT NULL OR regexp_matches(t, '^\\*[0-9]') THEN 1 END) > 0 AS c FROM fx GROUP BY ALL HAVING count({V}) > 0)"""
register(
    "account_dossiers",
    lambda s, d: accounts.account_dossiers(lines(s, d)).withColumn("total", F.round("total", 6)),
    LINES + ENTRIES + """, pr AS (SELECT DISTINCT doc_id, head FROM en), co AS (SELECT a.head, count(b.head) AS co_listed FROM pr a LEFT JOIN pr b ON a.doc_id = b.doc_id AND a.head <> b.head GROUP BY a.head)
SELECT head, count(*) AS entries, count(DISTINCT doc_id) AS tablets, round(sum(value), 6) AS total, count(*) FILTER (c) AS with_commodity, first(co_listed) AS co_listed FROM en JOIN co USING (head) GROUP BY head""",
)
register("fraction_census", lambda s, d: accounts.fraction_census(lines(s, d)), LINES + f", a AS (SELECT {V} AS v FROM tk), b AS (SELECT CASE WHEN v - floor(v) > 0 THEN v - floor(v) ELSE v END AS value FROM a WHERE v IS NOT NULL AND (v < 1 OR v <> floor(v))) SELECT round(value, 9) AS value, count(*) AS n FROM b WHERE value > 0 AND value < 1 GROUP BY 1")
register(
    "commodity_metrology",
    lambda s, d: accounts.commodity_metrology(lines(s, d)),
    LINES + f""", a AS (SELECT doc_id, line_no, arg_min(h, k) FILTER (h IS NOT NULL) AS head, sum(v) AS value, bool_or(v <> floor(v)) AS fractional FROM (SELECT doc_id, line_no, generate_subscripts(tokens, 1) AS k, unnest(tokens) AS t, coalesce({head_sql('t')}, CASE WHEN regexp_matches(t, '^\\*[0-9]') THEN t END) AS h, {V} AS v FROM ln) GROUP BY ALL HAVING count(v) > 0),
b AS (SELECT head, list_sort(list(value)) AS vs, count(*) AS entries, round(100.0 * count(*) FILTER (fractional) / count(*), 6) AS fractional_pct FROM a WHERE head IS NOT NULL GROUP BY head HAVING count(*) >= 3)
SELECT head, entries, fractional_pct, vs[entries // 2 + 1] AS median, list_max(vs) AS largest FROM b""".replace("generate_subscripts(tokens, 1) AS k, unnest(tokens) AS t,", "k, t,").replace("AS v FROM ln)", "AS v FROM (SELECT doc_id, line_no, generate_subscripts(tokens, 1) AS k, unnest(tokens) AS t FROM ln))"),
)
SUPPORT = "CASE c_nationkey % 5 WHEN 0 THEN 'tablet' WHEN 1 THEN ' Nodule' WHEN 2 THEN '' WHEN 3 THEN 'odd thing' ELSE 'Roundel' END"
register(
    "document_types",
    lambda s, d: accounts.document_type_profile(table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(SUPPORT).alias("support"), F.col("c_mktsegment").alias("site"), (F.col("c_custkey") % 4).alias("words"), (F.col("c_custkey") % 3).alias("numerals"))),
    f"""WITH d AS (SELECT CASE trim({SUPPORT}) WHEN 'tablet' THEN 'Tablet' WHEN '' THEN '(unrecorded)' ELSE trim({SUPPORT}) END AS type, c_mktsegment AS site, c_custkey % 4 AS words, c_custkey % 3 AS numerals FROM customer),
t AS (SELECT type, string_agg(site, ',' ORDER BY n DESC, site) AS top_sites FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, site) AS r FROM (SELECT type, site, count(*) AS n FROM d GROUP BY ALL)) WHERE r <= 2 GROUP BY type)
SELECT type, count(*) AS docs, round(100 * count(*) / (SELECT count(*) FROM d), 6) AS share_pct, round(sum(words) / count(*), 6) AS words_per_doc, round(100 * count(*) FILTER (numerals > 0) / count(*), 6) AS numerals_pct, first(top_sites) AS top_sites FROM d JOIN t USING (type) GROUP BY type""",
)
SERIES = "CASE c_custkey % 4 WHEN 0 THEN concat('KN Fp ', CAST(c_custkey AS VARCHAR(20))) WHEN 1 THEN concat('PY Ta', CAST(c_custkey AS VARCHAR(20))) WHEN 2 THEN 'lone' ELSE concat('X 1', CAST(c_custkey AS VARCHAR(20))) END"
register(
    "series_dossiers",
    lambda s, d: accounts.series_dossiers(table(s, d, "customer").select(F.expr(SERIES).alias("doc_id"), F.col("c_custkey").alias("doc_order"), F.col("c_mktsegment").alias("site"), F.concat(F.lit(" "), (F.col("c_nationkey") % 3).cast("string")).alias("scribe"), F.lit("LM").alias("period"), (F.col("c_custkey") % 7).alias("tokens"), (F.col("c_custkey") % 5).alias("words"))),
    f"""WITH d AS (SELECT {SERIES} AS doc_id, c_custkey AS o, c_mktsegment AS site, c_nationkey % 3 AS h, c_custkey % 7 AS tokens, c_custkey % 5 AS words FROM customer), e AS (SELECT *, nullif(regexp_extract(doc_id, '^\\s*\\S+\\s+([A-Za-z]+)', 1), '') AS series FROM d)
SELECT site, series, count(*) AS docs, count(DISTINCT h) AS hands, 1::BIGINT AS periods, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(words) AS BIGINT) AS words, arg_min(doc_id, o) AS first_doc FROM e WHERE series IS NOT NULL GROUP BY ALL""",
)
register(
    "format_values",
    lambda s, d: table(s, d, "lineitem").select((F.col("l_quantity") / F.lit(8.0) - F.lit(3)).alias("v")).distinct().select("v", format_value(F.col("v")).alias("shown")),
    """WITH a AS (SELECT DISTINCT l_quantity / 8.0 - 3 AS v FROM lineitem), b AS (SELECT v, abs(v) - floor(abs(v)) AS r FROM a)
SELECT v, CASE WHEN r = 0 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN abs(v) >= 1 THEN CAST(CAST(floor(abs(v)) AS BIGINT) AS VARCHAR) ELSE '' END || CASE r WHEN 0.125 THEN '⅛' WHEN 0.25 THEN '¼' WHEN 0.375 THEN '⅜' WHEN 0.5 THEN '½' WHEN 0.625 THEN '⅝' WHEN 0.75 THEN '¾' ELSE '⅞' END END AS shown FROM b""",
)
