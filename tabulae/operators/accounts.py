"""Accounts as arrays of tokens: line roles, reconciliation, commodities, structure, profiles.

``lines`` tables have (doc_id, line_no, tokens array<string>); ``tokens`` tables one row a token.
Each rule is a column expression, so documents and lines run in parallel."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.numerals import has_value, line_value, parse_value, some_value, sum_values
from tabulae.operators.ledgers import closed_sections


class Markers(NamedTuple):
    total: tuple[str, ...]
    grand_total: tuple[str, ...]
    deficit: tuple[str, ...]


LINEAR_A = Markers(("KU-RA", "KU-RO"), ("PO-TO-KU-RO",), ("KI-RO", "KU-RO₂"))
LINEAR_B = Markers(("TO-SA", "TO-SO", "TO-SO-DE"), (), ("O-PE-RO", "O-PE-RO-SI"))
SKIPPED = ("\U00010101", "\U0001076b", "—", "≈")
SEPARATOR = "\U00010101"
LIBATION = ("A-TA-I-*301-WA-JA", "JA-SA-SA-RA-ME", "A-DI-KI-TE", "A-DI-KI-TE-TE", "JA-DI-KI-TE-TE-DU-PU₂-RE", "JA-DI-KI-TE-TE-*307-PU₂-RE")
STRUCTURES = ("accounting", "libation", "list", "text", "other")
COMMODITIES = {
    "GRA": "grain / wheat", "HORD": "barley", "OLE": "olive oil", "OLIV": "olives", "VIN": "wine", "FIC": "figs", "NI": "figs (logogram)", "CYP": "cyperus (sedge / spice)", "AROM": "aromatic", "GRA_PA": "grain (qualified)", "OVIS": "sheep",
    "CAP": "goat", "SUS": "pig", "BOS": "ox / cattle", "VIR": "man / person", "MUL": "woman", "TELA": "cloth", "LANA": "wool", "AES": "bronze", "AUR": "gold", "ARG": "silver",
}
TYPES = ("Tablet", "Nodule", "Roundel", "Stone vessel", "Clay vessel", "Lames (short thin tablet)", "Sealing", "Inked inscription", "3-sided bar", "4-sided bar", "Metal object", "Stone object", "Architecture", "Graffito", "Label", "Loom weight", "Triton", "ivory object")


def markers_for(script: str) -> Markers:
    return LINEAR_B if script == "linearb" else LINEAR_A


def _among(token: Column, words: tuple[str, ...]) -> Column:
    return F.lower(token).isin([w.lower() for w in words]) if words else F.lit(False)


def terms_of(tokens: Column) -> Column:
    """Tokens that are no numbers, marks or ideograms."""
    return F.filter(tokens, lambda t: parse_value(t).isNull() & ~t.isin(*SKIPPED) & (t.contains("-") | ~t.rlike("^[A-Z*][A-Z0-9*+'\\[\\]?]*$")))


def ideograms_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: parse_value(t).isNull() & ~t.isin(*SKIPPED) & ~t.contains("-") & t.rlike("^[A-Z*][A-Z0-9*+'\\[\\]?]*$"))


def parse_lines(lines: DataFrame, markers: Markers = LINEAR_A) -> DataFrame:
    """The lines with their terms, ideograms, value, has_number and role: a grand total, a total
    or a deficit by its marker, a header without a number, else an item."""
    rows = lines.withColumn("terms", terms_of(F.col("tokens"))).withColumn("ideograms", ideograms_of(F.col("tokens")))
    rows = rows.withColumn("value", line_value(F.col("tokens"))).withColumn("has_number", has_value(F.col("tokens")))
    some = lambda words: F.exists("terms", lambda t: _among(t, words))
    role = F.when(some(markers.grand_total), "grand-total").when(some(markers.total), "total").when(some(markers.deficit), "deficit")
    return rows.withColumn("role", role.when(~F.col("has_number"), "header").otherwise("item"))


def balance_check(lines: DataFrame, markers: Markers = LINEAR_A) -> DataFrame:
    """Each stated total of parsed lines against what stands before it: a total against the items
    since the last total of any kind, a grand total against the totals since the last grand
    total and the items behind them. Two running counts number the sections."""
    marker = F.coalesce(F.get(F.filter("terms", lambda t: _among(t, markers.total) | _among(t, markers.grand_total)), F.lit(0)), F.lit(""))
    # the tokens stay behind: what is sorted is a line's number, role, value and marker
    rows = parse_lines(lines, markers).withColumn("marker", marker)
    rows = closed_sections(rows, (F.col("role") == "item") & F.col("has_number"), "marker")
    gap = F.col("computed") - F.col("value")
    return rows.select("doc_id", "line_no", "role", "marker", F.col("value").alias("stated"), "computed", "items", gap.alias("difference"), (F.abs(gap) < 1e-6).alias("balances"))


def checkable_accounts(lines: DataFrame, tokens: DataFrame, tolerance: float = 0.1, markers: Markers = LINEAR_A) -> DataFrame:
    """Ids of documents whose tokens (doc_id, text, status) are all certain and without brackets and
    of whose totals at least one is near: within 1, or within ``tolerance`` of what is stated."""
    near = balance_check(lines, markers).filter(F.abs("difference") <= F.greatest(F.lit(1.0), tolerance * F.abs("stated"))).select("doc_id").distinct()
    spoilt = tokens.filter((F.col("status") != "certain") | F.col("text").rlike("[\\[\\]]")).select("doc_id")
    return near.join(spoilt, "doc_id", "left_anti")


def classify_structure(tokens: DataFrame) -> DataFrame:
    """(doc_id, structure) by the first rule that holds for a document's tokens (doc_id, text)."""
    t = F.col("text")
    rows = tokens.groupBy("doc_id").agg(
        F.bool_or(t.rlike("^[0-9]")).alias("nums"), F.bool_or(t == "KU-RO").alias("total"), F.bool_or(t.isin(*LIBATION)).alias("formula"), F.count_if(t.contains("-")).alias("multi"), F.count_if(t == SEPARATOR).alias("marks")
    )
    kind = F.when(F.col("total") | (F.col("nums") & (F.col("multi") > 2)), "accounting").when(F.col("formula"), "libation")
    kind = kind.when((F.col("marks") > 3) & ~F.col("nums"), "list").when((F.col("multi") > 4) & ~F.col("nums"), "text").otherwise("other")
    return rows.select("doc_id", kind.alias("structure"))


def structure_counts(tokens: DataFrame) -> DataFrame:
    """(structure, docs) with a row for every class, also for those without documents."""
    spark = tokens.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STRUCTURES])).alias("structure"))
    found = classify_structure(tokens).groupBy("structure").agg(F.count("*").alias("docs"))
    return every.join(found, "structure", "left").select("structure", F.coalesce("docs", F.lit(0)).alias("docs"))


def commodity_head(token: Column) -> Column:
    """The commodity that a logogram stands for: what is before a ligature, without brackets and
    marks, and if need be without a sex marker. Null for hyphenated tokens and unknown ones."""
    head = F.regexp_replace(F.element_at(F.split(token, "\\+"), 1), "[\\[\\]?'\"]", "")
    bare = F.regexp_replace(head, "[mf]$", "")
    known = list(COMMODITIES)
    return F.when(~token.contains("-"), F.when(head.isin(known), head).when(bare.isin(known), bare))


def is_undeciphered_logogram(token: Column) -> Column:
    return token.rlike("^\\*[0-9]")


def is_lexical_word(word: Column) -> Column:
    """Hyphenated, without ligatures, brackets or doubt, without commodities or vessel numbers of
    400 and more among its signs, and with a sign that is not just a number."""
    parts = F.split(word, "-")
    number = lambda p: F.regexp_extract(p, "^\\*([0-9]+)", 1)
    bad = F.exists(parts, lambda p: commodity_head(p).isNotNull() | F.coalesce(number(p).try_cast("double") >= 400, F.lit(False)))
    return word.contains("-") & ~word.rlike("[+\\[\\]?]") & ~bad & F.exists(parts, lambda p: number(p) == "")


def _commodity(tokens: Column) -> Column:
    """The first commodity, or undeciphered logogram, of a line."""
    return F.get(F.filter(F.transform(tokens, lambda t: F.coalesce(commodity_head(t), F.when(is_undeciphered_logogram(t), t))), F.isnotnull), F.lit(0))


def account_entries(lines: DataFrame, markers: Markers = LINEAR_A) -> DataFrame:
    """(doc_id, line_no, head, value, commodity): lines whose first lexical word, no marker, has a
    number behind it, with what stands behind it. Tokens are parsed once: what is found is bound to names
    inside one expression, and what is not asked for goes there."""
    tokens = F.col("tokens")

    def entry(head: Column) -> Column:
        after = F.slice(tokens, F.array_position(tokens, head) + 1, F.size(tokens))
        return F.transform(F.array(after), lambda t: F.transform(F.array(F.transform(t, parse_value)), lambda v: F.struct(head.alias("head"), some_value(v).alias("some"), sum_values(v).alias("value"), _commodity(t).alias("commodity"))))

    heads = F.filter(F.array(F.get(F.filter(tokens, is_lexical_word), F.lit(0))), lambda h: h.isNotNull() & ~_among(h, sum(markers, ())))
    found = F.filter(F.flatten(F.flatten(F.transform(heads, entry))), lambda x: x["some"])
    return lines.select("doc_id", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.head", "x.value", "x.commodity")


def account_dossiers(lines: DataFrame, markers: Markers = LINEAR_A) -> DataFrame:
    """One row a head: entries, tablets, total value, commodities by count, and how many other
    heads its tablets list (each once for each tablet). Entries are added up by tablet and head, and these by head."""
    rows = account_entries(lines, markers).groupBy("doc_id", "head").agg(F.count("*").alias("entries"), F.sum("value").alias("total"), F.count("commodity").alias("with_commodity"))
    # a head is listed with as many others as its tablet has heads, less itself: no pairs are built
    others = F.when(F.col("doc_id").isNotNull(), F.count("*").over(W.partitionBy("doc_id")) - 1).otherwise(0)
    return rows.withColumn("others", others).groupBy("head").agg(F.sum("entries").alias("entries"), F.count("doc_id").alias("tablets"), F.sum("total").alias("total"), F.sum("with_commodity").alias("with_commodity"), F.sum("others").alias("co_listed"))


def fraction_census(lines: DataFrame) -> DataFrame:
    """(value, n): how often each fractional part below one is written."""
    v = parse_value(F.col("t"))
    rows = lines.select(F.explode("tokens").alias("t")).select(v.alias("v")).filter("v IS NOT NULL AND (v < 1 OR v <> floor(v))")
    part = F.col("v") - F.floor("v")
    rows = rows.select(F.when(part > 0, part).otherwise(F.col("v")).alias("value")).filter("value > 0 AND value < 1")
    return rows.select(F.round("value", 9).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def commodity_metrology(lines: DataFrame, min_entries: int = 3) -> DataFrame:
    """One row a commodity with enough valued lines: entries, share with fractions in percent,
    upper median and largest value. Tokens are parsed once a line, lines read once."""
    valued = F.transform(F.array(F.transform("tokens", parse_value)), lambda v: F.struct(F.when(some_value(v), _commodity(F.col("tokens"))).alias("head"), sum_values(v).alias("value"), F.exists(v, lambda x: x != F.floor(x)).alias("fractional")))
    rows = lines.select(F.explode(F.filter(valued, lambda x: x["head"].isNotNull())).alias("x")).select("x.*")
    # counts of equal values are ranked, not lines: few rows a commodity reach one task
    counts = rows.groupBy("head", "value").agg(F.count("*").alias("n"), F.count_if("fractional").alias("fractional"))
    upto = W.partitionBy("head").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("head")))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("value")))
    out = ranked.groupBy("head").agg(F.sum("n").alias("entries"), F.round(100.0 * F.sum("fractional") / F.sum("n"), 6).alias("fractional_pct"), F.max("value").alias("largest"), median.alias("median"))
    return out.filter(F.col("entries") >= min_entries)


def fold_support(support: Column) -> Column:
    t = F.trim(support)
    upper = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    return F.when(t.isin(*TYPES), t).when(upper.isin(*TYPES), upper).when(t == "", "(unrecorded)").otherwise(t)


def document_type_profile(documents: DataFrame) -> DataFrame:
    """One row a folded support: documents, their share in percent, hyphenated words a document,
    percent with a number, the two most frequent sites. ``documents`` has doc_id, support, site,
    words (hyphenated) and numerals (counts)."""
    rows = documents.withColumn("type", fold_support(F.col("support")))
    total = rows.agg(F.count("*").alias("total"))
    sites = rows.filter("site <> ''").groupBy("type", "site").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("type").orderBy(F.desc("n"), "site"))
    top = sites.withColumn("r", place).filter("r <= 2").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "site"))), lambda x: x["site"]), ",").alias("top_sites"))
    base = rows.groupBy("type").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.count_if(F.col("numerals") > 0).alias("numbered"))
    base = base.crossJoin(F.broadcast(total)).join(top, "type", "left")  # one row
    return base.select("type", "docs", F.round(100 * F.col("docs") / F.col("total"), 6).alias("share_pct"), F.round(F.col("words") / F.col("docs"), 6).alias("words_per_doc"), F.round(100 * F.col("numbered") / F.col("docs"), 6).alias("numerals_pct"), F.coalesce("top_sites", F.lit("")).alias("top_sites"))


def series_of(doc_id: Column) -> Column:
    """The letters that begin an id's second field, as in ``KN Fp 1``; null without them."""
    return F.nullif(F.regexp_extract(doc_id, "^\\s*\\S+\\s+([A-Za-z]+)", 1), F.lit(""))


def series_dossiers(documents: DataFrame, min_docs: int = 1) -> DataFrame:
    """One row a (site, series): documents, hands, periods, tokens and words, and the first
    document by order. ``documents`` has doc_id, doc_order, site, scribe, period, tokens, words."""
    rows = documents.withColumn("series", series_of(F.col("doc_id"))).filter("series IS NOT NULL")
    hand = F.nullif(F.trim("scribe"), F.lit(""))
    out = rows.groupBy("site", "series").agg(F.count("*").alias("docs"), F.countDistinct(hand).alias("hands"), F.countDistinct(F.nullif("period", F.lit(""))).alias("periods"), F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), F.min_by("doc_id", "doc_order").alias("first_doc"))
    return out.filter(F.col("docs") >= min_docs)
