"""SQL for DuckDB that says the same as the queries of operators 3, 4 and 7."""

from __future__ import annotations

from tabulae.llm.quality_rules import BOILERPLATE
from tabulae.llm.url_trust import ITERATIONS, ONE, RULES

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql() -> str:
    line = "x"
    symbols = f"(length({line}) - length(regexp_replace({line}, '[#*$%&|<>]', '', 'g')))"
    word = "'[^\\x20\\x09-\\x0D]'"
    passes = f"""(NOT regexp_matches({line}, {word}) OR (regexp_matches({line}, {_quote('[.!?:;"' + chr(39) + '”’»)…。！？][ \\t-\\r]*$')})
    AND NOT ({symbols} > 0 AND regexp_matches({line}, '^[^|>]{{0,40}}([|>][^|>]{{0,40}}){{2,}}$')) AND {symbols} * 10 <= length({line}) AND NOT regexp_matches({line}, {_quote(BOILERPLATE)})))"""
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(1)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM a)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {word})) AS l, list_filter(string_split(text, chr(10)), lambda x: {passes}) AS c FROM a),
d AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
CAST(len(list_filter(string_split_regex(array_to_string(c, chr(10)), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_kept_words FROM b LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM d"""


def url_sql(iterations: int = ITERATIONS, threshold: float = 0.5) -> str:
    fits = lambda r, path="path": f"((host = {_quote(r.split('/')[0])} OR ends_with(host, {_quote('.' + r.split('/')[0])})) AND starts_with({path}, {_quote('/' + r.partition('/')[2])}))"
    longest = sorted(RULES, key=lambda x: (-len(x[0]), x[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quote(r)}" for r, _ in longest) + " END"
    whole = "CASE " + " ".join(f"WHEN {fits(r, _quote('/'))} THEN {_quote(v)}" for r, v in longest) + " END"
    host = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = ", ".join(
        f"r{k + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(rank) AS BIGINT) AS rank FROM (SELECT m.kind, m.dst AS host, CAST(floor(r.rank::DOUBLE * 85 * n / (100 * total)) AS BIGINT) AS rank FROM r{k} r JOIN m ON r.kind = m.kind AND r.host = m.src UNION ALL SELECT kind, host, CAST(floor(rank::DOUBLE * 15 / 100) AS BIGINT) FROM r0) GROUP BY kind, host)"
        for k in range(iterations)
    )
    return f"""WITH p AS (SELECT page_id, {host.format('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT {host.format('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS u FROM pages),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 0 AS kind, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e), m AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM both_ways),
q AS (SELECT *, {rule} AS rule FROM p), d AS (SELECT *, CASE {' '.join(f'WHEN rule = {_quote(r)} THEN {_quote(v)}' for r, v in RULES)} END AS decided FROM q),
own AS (SELECT host, count(*) AS n, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b FROM d WHERE host <> '' GROUP BY host),
named AS (SELECT DISTINCT host FROM (SELECT src AS host FROM e UNION ALL SELECT dst FROM e) WHERE host NOT IN (SELECT host FROM own)),
h AS (SELECT * FROM own UNION ALL SELECT host, 1, CASE WHEN {whole} = 'allow' THEN 1 ELSE 0 END, CASE WHEN {whole} = 'block' THEN 1 ELSE 0 END FROM named),
r0 AS MATERIALIZED (SELECT 0 AS kind, host, CAST(floor(a::DOUBLE * {ONE} / n) AS BIGINT) AS rank FROM h WHERE a > 0 UNION ALL SELECT 1, host, CAST(floor(b::DOUBLE * {ONE} / n) AS BIGINT) FROM h WHERE b > 0),
{steps}, t AS (SELECT host, CAST(coalesce(sum(rank) FILTER (kind = 0), 0) AS BIGINT) AS trust, CAST(coalesce(sum(rank) FILTER (kind = 1), 0) AS BIGINT) AS distrust FROM r{iterations} GROUP BY host),
s AS (SELECT coalesce(sum(rank) FILTER (kind = 0), 1)::DOUBLE AS ts, coalesce(sum(rank) FILTER (kind = 1), 1)::DOUBLE AS ds FROM r0)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN distrust / ds > trust / ts AND distrust >= {threshold * 0.15 * ONE} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM d LEFT JOIN t USING (host), s"""


def windows_sql(length: int = 13) -> str:
    return f"""WITH a AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+{length - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {length - 2}, 1))) AS i FROM a)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range({length})) AS k)),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM a),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM tok ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM a LEFT JOIN kept USING (doc_id)"""
