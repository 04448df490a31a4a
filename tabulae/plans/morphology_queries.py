"""Queries over the signs of words, each with its SQL. A word's signs are its letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.operators import morphology
from tabulae.plans.corpus_queries import TOK, llr_sql, wilson_sql
from tabulae.plans.registry import register
from tabulae.sources.adapter import table, tokens, vocabulary

HY = TOK + ", hy AS (SELECT array_to_string(string_split(text, ''), '-') AS text, doc_id, pos FROM tok), voc AS (SELECT text, count(*) AS n FROM hy GROUP BY text), pt AS (SELECT text, n, string_split(text, '-') AS p FROM voc)"


def hyphenated(spark: SparkSession, d: str) -> DataFrame:
    return tokens(table(spark, d, "documents")).withColumn("text", F.array_join(F.split("text", ""), "-"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of ``hyphenated``: words of letters differ as their hyphenated forms do, so hyphens are put once a word."""
    return vocabulary(tokens(table(spark, d, "documents"))).withColumn("text", F.array_join(F.split("text", ""), "-"))


def signed(g2: str, more: str, empty: str) -> str:
    return f"CASE WHEN {empty} THEN 0 WHEN {more} THEN {g2} ELSE -{g2} END + 0.0"


for mode, length in (("suffix", 1), ("prefix", 2)):
    cut = f"p[len(p) - {length - 1}:]" if mode == "suffix" else f"p[:{length}]"
    AFF = HY + f", af AS (SELECT n, p, array_to_string({cut}, '-') AS affix FROM pt WHERE len(p) > {length})"
    register(
        f"affix_edge_bias_{mode}",
        lambda s, d, m=mode, k=length: morphology.affix_edge_bias(words(s, d), k, m),
        AFF + f""", e AS (SELECT affix, CAST(sum(n) AS BIGINT) AS edge_n FROM af GROUP BY affix), w AS (SELECT affix, CAST(sum(n) AS BIGINT) AS all_n FROM (SELECT n, unnest(list_transform(range(1, len(p) - {length} + 2), lambda i: array_to_string(p[i:i + {length - 1}], '-'))) AS affix FROM af) GROUP BY affix),
t AS (SELECT (SELECT sum(edge_n) FROM e)::DOUBLE AS et, (SELECT sum(all_n) FROM w)::DOUBLE AS tt), j AS (SELECT affix, edge_n, all_n - edge_n AS inner_n, et, tt - et AS it FROM e JOIN w USING (affix), t)
SELECT affix, edge_n, inner_n, 0.0 + round({signed(llr_sql('edge_n', 'et', '(edge_n + inner_n)', '(et + it)'), 'edge_n / et >= inner_n / it', 'et <= 0 OR it <= 0')}, 4) AS g2 FROM j""",
    )
    register(f"affix_productivity_{mode}", lambda s, d, m=mode, k=length: morphology.affix_productivity(words(s, d), k, m), AFF + " SELECT affix, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS hapaxes, round(count(*) FILTER (n = 1) / sum(n)::DOUBLE, 6) AS productivity FROM af GROUP BY affix")
register(
    "positional_bias",
    lambda s, d: morphology.positional_bias(hyphenated(s, d)),
    HY + f""", pa AS (SELECT text AS word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS size FROM hy WHERE contains(text, '-')),
c AS (SELECT word, count(*) AS n, count(*) FILTER (k = 1) AS initial, count(*) FILTER (k > 1 AND k < size) AS medial, count(*) FILTER (k = size) AS final FROM pa GROUP BY word), t AS (SELECT sum(initial) AS ai, sum(medial) AS am, sum(final) AS af FROM c),
s AS (SELECT *, CASE WHEN initial >= medial AND initial >= final THEN 'initial' WHEN final >= medial AND final >= initial THEN 'final' ELSE 'medial' END AS dominant, initial + medial + final AS slots, ai + am + af AS grand FROM c, t WHERE n >= 2),
xx AS (SELECT *, CASE dominant WHEN 'initial' THEN initial WHEN 'final' THEN final ELSE medial END AS i, CASE dominant WHEN 'initial' THEN ai WHEN 'final' THEN af ELSE am END AS st FROM s)
SELECT word, n, initial, medial, final, dominant, 0.0 + round({signed(llr_sql('i', 'slots', 'st', 'grand'), 'i / slots::DOUBLE >= (st - i) / (grand - slots)::DOUBLE', 'slots <= 0 OR grand - slots <= 0')}, 4) AS g2 FROM xx""",
)
register(
    "successor_varieties",
    lambda s, d: morphology.successor_variety(words(s, d)),
    HY + """, st AS (SELECT DISTINCT i AS depth, array_to_string(p[:i], '-') AS prefix, array_to_string(p[:i - 1], '-') AS parent, p[i + 1] AS next FROM (SELECT p, unnest(range(1, len(p))) AS i FROM pt WHERE len(p) >= 2)),
v AS (SELECT depth, prefix, first(parent) AS parent, count(DISTINCT next) AS variety FROM st GROUP BY depth, prefix), m AS (SELECT depth, avg(variety) AS mean FROM v GROUP BY depth)
SELECT v.prefix AS stem, v.variety, coalesce(q.variety, 0) AS parent_variety, round(v.variety / mean, 6) AS ratio FROM v JOIN m USING (depth) LEFT JOIN v q ON q.prefix = v.parent AND q.depth = v.depth - 1 WHERE v.depth >= 2 AND v.variety >= 3""",
)
SEG = (
    HY
    + """, rv AS (SELECT 's' AS side, p AS o FROM pt UNION ALL SELECT 'p', list_reverse(p) FROM pt), vr AS (SELECT side, prefix, count(DISTINCT next) AS variety FROM (SELECT side, array_to_string(o[:i], '-') AS prefix, o[i + 1] AS next FROM (SELECT side, o, unnest(range(0, len(o))) AS i FROM rv)) GROUP BY ALL),
q AS (SELECT text, len(p) AS size, i, 's' AS side, array_to_string(p[:i], '-') AS prefix FROM (SELECT text, p, unnest(range(1, len(p))) AS i FROM pt) UNION ALL SELECT text, len(p), i, 'p', array_to_string(list_reverse(p)[:i], '-') FROM (SELECT text, p, unnest(range(1, len(p))) AS i FROM pt)),
pk AS (SELECT *, variety >= coalesce(lag(variety) OVER w, 0) AND variety > coalesce(lead(variety) OVER w, variety) AS peak FROM q JOIN vr USING (side, prefix) WINDOW w AS (PARTITION BY text, side ORDER BY i)),
ct AS (SELECT text, list_sort(list_distinct(list(CASE side WHEN 's' THEN i ELSE size - i END))) AS cuts FROM pk WHERE peak GROUP BY text), sg AS (SELECT text, p, coalesce(cuts, []) AS cuts FROM pt LEFT JOIN ct USING (text)), pc AS (SELECT text, cuts, p, list_concat([0], list_concat(cuts, [len(p)])) AS b FROM sg)"""
)
register(
    "segmentation",
    lambda s, d: morphology.segment(words(s, d)).select("text", F.array_join(F.transform("cuts", lambda c: c.cast("string")), ",").alias("cuts"), F.array_join("pieces", "|").alias("pieces")),
    SEG + " SELECT text, array_to_string(cuts, ',') AS cuts, array_to_string(list_transform(range(1, len(b)), lambda i: array_to_string(p[b[i] + 1:b[i + 1]], '-')), '|') AS pieces FROM pc",
)
register("candidate_morphs", lambda s, d: morphology.candidate_morphs(words(s, d)), SEG + " SELECT array_to_string(p[b[len(b) - 1] + 1:], '-') AS morph, count(*) AS n FROM pc WHERE len(cuts) > 0 GROUP BY 1 HAVING count(*) >= 2")
register(
    "pmi_interval",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("j")).withColumn("l", F.col("j") + 7).withColumn("r", F.col("j") + 90).withColumn("t", F.col("j") * 3 + 100).select("l_returnflag", "l_linestatus", morphology.pmi_interval(F.col("j"), F.col("l"), F.col("r"), F.col("t")).alias("b")).select("l_returnflag", "l_linestatus", F.round("b.low", 6).alias("low"), F.round("b.high", 6).alias("high")),
    f"WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS j FROM lineitem GROUP BY ALL), b AS (SELECT *, j + 7 AS l, j + 90 AS r, j * 3 + 100 AS t FROM a) SELECT l_returnflag, l_linestatus, round(log2({wilson_sql('j', 't', '-')} / ((l / t::DOUBLE) * (r / t::DOUBLE))), 6) AS low, round(log2({wilson_sql('j', 't', '+')} / ((l / t::DOUBLE) * (r / t::DOUBLE))), 6) AS high FROM b",
)
register(
    "chao1_interval",
    lambda s, d: vocabulary(tokens(table(s, d, "documents"))).withColumn("g", F.length("text").cast("long")).groupBy("g").agg(F.count("*").alias("s"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2")).select("g", morphology.chao1_interval(F.col("s"), F.col("f1"), F.col("f2")).alias("c")).select("g", *[F.round(f"c.{x}", 4).alias(x) for x in ("estimate", "low", "high", "unseen")]),
    TOK + """, v AS (SELECT text, count(*) AS n FROM tok GROUP BY text), c AS (SELECT length(text) AS g, count(*)::DOUBLE AS s, (count(*) FILTER (n = 1))::DOUBLE AS f1, (count(*) FILTER (n = 2))::DOUBLE AS f2 FROM v GROUP BY 1),
e AS (SELECT *, s + CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END AS est FROM c), w AS (SELECT *, CASE WHEN f2 > 0 THEN f2 * (pow(f1 / f2, 2) / 2 + pow(f1 / f2, 3) + pow(f1 / f2, 4) / 4) ELSE f1 * (f1 - 1) / 2 + f1 * pow(2 * f1 - 1, 2) / 4 - pow(f1, 4) / (4 * est) END AS var, est - s AS t FROM e),
k AS (SELECT *, s <= 0 OR f1 <= 0 AS flat, s <= 0 OR f1 <= 0 OR t <= 0 OR var <= 0 AS narrow FROM w), z AS (SELECT *, CASE WHEN narrow THEN 1 ELSE exp(1.96 * sqrt(ln(1 + var / (t * t)))) END AS q FROM k)
SELECT g, round(CASE WHEN flat THEN s ELSE est END, 4) AS estimate, round(CASE WHEN flat THEN s WHEN narrow THEN est ELSE s + t / q END, 4) AS low, round(CASE WHEN flat THEN s WHEN narrow THEN est ELSE s + t * q END, 4) AS high, round(CASE WHEN flat THEN 0 ELSE t END, 4) AS unseen FROM z""",
)
register(
    "sign_value_counts",
    lambda s, d: morphology.sign_value_counts(words(s, d), words(s, d).select(F.explode(F.split("text", "-")).alias("label")).distinct().select("label", F.translate("label", "aeioubdgpc", "VVVVVptkpk").alias("value"))),
    HY + ", l AS (SELECT unnest(p) AS label, n FROM pt WHERE len(p) > 1), c AS (SELECT label, CAST(sum(n) AS BIGINT) AS n, translate(label, 'aeioubdgpc', 'VVVVVptkpk') AS value FROM l GROUP BY label) SELECT value, CAST(sum(n) AS BIGINT) AS n, string_agg(label, ',' ORDER BY label) AS labels FROM c GROUP BY value",
)
LABELS = "CASE p_partkey % 5 WHEN 0 THEN concat('PA', CAST(p_size % 10 AS VARCHAR(3))) WHEN 1 THEN concat('CM0', CAST(p_size AS VARCHAR(3)), 'B') WHEN 2 THEN 'PA' WHEN 3 THEN concat('CM0', CAST(p_size AS VARCHAR(3))) ELSE 'RA2+X' END"
register(
    "variant_groups",
    lambda s, d: morphology.variant_groups(table(s, d, "part").select(F.expr(LABELS).alias("label"))),
    f"""WITH l AS (SELECT DISTINCT {LABELS} AS label FROM part), f AS (SELECT label, coalesce(nullif(regexp_extract(label, '^([A-Z]{{1,4}})[0-9]$', 1), ''), nullif(regexp_extract(label, '^(CM[0-9]+)[A-Z]$', 1), '')) AS base, CASE WHEN regexp_matches(label, '^[A-Z]{{1,4}}[0-9]$') THEN 'homophone-number' ELSE 'catalog-suffix' END AS kind FROM l WHERE NOT contains(label, '+')),
g AS (SELECT base, kind, list_sort(list(label)) AS own FROM f WHERE base IS NOT NULL GROUP BY ALL), m AS (SELECT base, kind, CASE WHEN base IN (SELECT label FROM l) THEN list_concat([base], own) ELSE own END AS m FROM g)
SELECT base, kind, array_to_string(m, ',') AS members, len(m) AS n FROM m WHERE len(m) >= 2""",
)
