"""Compound queries over documents and words, and literal search.

Conditions fold strictly from left to right without precedence: the first one's connector
is ignored, ``negate`` flips its own row, a missing connector means AND, none is true.
Document and word conditions fold apart and are joined by AND; in document output one and the
same word must meet all word conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.measures import fold


@dataclass(frozen=True)
class Condition:
    field: str
    value: Any
    connector: str = "AND"
    negate: bool = False


def sign_pattern(pattern: str) -> str:
    """A regular expression over ``-`` and the hyphenated word: ``*`` is one sign, ``**`` any."""
    parts: list[str] = []
    for p in pattern.upper().split("-"):
        if p == "**" and parts and parts[-1] == "(?:-[^-]*)*":
            continue
        parts.append("(?:-[^-]*)*" if p == "**" else "-[^-]*" if p == "*" else "-" + re.escape(p))
    return "^" + "".join(parts) + "$"


_DOCUMENT = {
    "id-contains": lambda v: F.upper(F.col("doc_id").cast("string")).contains(str(v).upper()),
    "site-is": lambda v: F.col("site") == v,
    "period-is": lambda v: F.col("period") == v,
    "scribe-is": lambda v: F.col("scribe") == v,
    "support-is": lambda v: F.col("support") == v,
    "has-image": lambda v: (F.size("images") > 0) == bool(v),
    "has-annotation": lambda v: F.col("annotated") == bool(v),
    "ins-contains-word": lambda v: F.array_contains("words", v),
}
#: What column a condition on documents reads.
_LABEL = {"site-is": "site", "period-is": "period", "scribe-is": "scribe", "support-is": "support", "has-image": "images", "has-annotation": "annotated"}
_WORD = {
    "word-contains": lambda v: F.upper("text").contains(v.upper()),
    "word-prefix": lambda v: F.upper("text").startswith(v.upper()),
    "word-suffix": lambda v: F.upper("text").endswith(v.upper()),
    "word-min-syllables": lambda v: F.size(F.split("text", "-")) >= int(v),
    "word-max-syllables": lambda v: F.size(F.split("text", "-")) <= int(v),
    "word-contains-sign": lambda v: F.array_contains(F.split(F.translate(F.upper("text"), "*", ""), "-"), v.upper().replace("*", "")),
    "word-sign-pattern": lambda v: F.col("text").contains("-") & F.concat(F.lit("-"), F.upper("text")).rlike(sign_pattern(v)),
    "word-cooccurs-with": lambda v: F.coalesce(F.col(_flag(v)), F.lit(False)),
}


def _flag(word: str) -> str:
    return "_with_" + word.encode().hex()


def _fold(conditions: list[Condition], table: dict) -> Column:
    out: Column | None = None
    for c in conditions:
        empty = c.value in (None, "") and c.field not in ("has-image", "has-annotation")
        term = F.lit(True) if empty else table[c.field](c.value)
        term = ~term if c.negate else term
        out = term if out is None else out | term if c.connector.upper() == "OR" else out & term
    return F.lit(True) if out is None else out


def query(tokens: DataFrame, conditions: list[Condition], output: str = "documents") -> DataFrame:
    """``documents``: the ids of documents that meet all; ``words``: words with the number of
    such documents that hold them."""
    on_doc = [c for c in conditions if c.field in _DOCUMENT]
    on_word = [c for c in conditions if c.field in _WORD]
    if unknown := {c.field for c in conditions} - _DOCUMENT.keys() - _WORD.keys():
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    words = sorted({c.value for c in on_doc if c.field == "ins-contains-word" and c.value})
    rows = tokens
    for word in {c.value for c in on_word if c.field == "word-cooccurs-with" and c.value}:
        # of all documents, also of those that the document rows leave out
        docs = tokens.filter(F.col("text") == word).select("doc_id").distinct()
        shared = tokens.filter(F.col("text") != word).join(docs, "doc_id", "left_semi").select("text").distinct()
        rows = rows.join(shared.withColumn(_flag(word), F.lit(True)), "text", "left")
    rows = rows.filter(_fold(on_word, _WORD))
    if words and output == "documents" and not on_word:
        # tokens are folded to a row a document and its labels by plain flags, before anything is shuffled
        labels = sorted({_LABEL[c.field] for c in on_doc if c.field in _LABEL} - {"doc_id"})
        flags = [f"_holds_{k}" for k in range(len(words))]
        rows = tokens.groupBy("doc_id", *labels).agg(*[F.bool_or(F.col("text") == w).alias(f) for f, w in zip(flags, words)])
        every = W.partitionBy("doc_id")
        held = F.array_compact(F.array(*[F.when(F.bool_or(f).over(every), F.lit(w)) for f, w in zip(flags, words)]))
        rows = rows.withColumn("words", F.when(F.col("doc_id").isNotNull(), held))
    elif words:
        held = tokens.filter(F.col("text").isin(words)).select("doc_id", "text").distinct().groupBy("doc_id").agg(F.collect_list("text").alias("words"))
        rows = rows.join(held, "doc_id", "left").withColumn("words", F.when(F.col("doc_id").isNotNull(), F.coalesce("words", F.array().cast("array<string>"))))
    rows = rows.filter(_fold(on_doc, _DOCUMENT))
    if output == "words":
        return rows.select("doc_id", "text").distinct().groupBy("text").agg(F.count("*").alias("docs"))
    return rows.select("doc_id").distinct()


LABELS = {
    "id-contains": "Inscription ID contains", "site-is": "Site is", "scribe-is": "Scribe is", "period-is": "Period is", "support-is": "Support is", "has-image": "Has facsimile image", "has-annotation": "Has annotation", "ins-contains-word": "Contains exact word",
    "word-contains": "Word contains text", "word-prefix": "Word starts with", "word-suffix": "Word ends with", "word-min-syllables": "Word has ≥ N signs", "word-max-syllables": "Word has ≤ N signs", "word-contains-sign": "Word contains sign", "word-cooccurs-with": "Word co-occurs with", "word-sign-pattern": "Word matches sign pattern",
}


def summarize(conditions: list[Condition]) -> str:
    """The conditions in words."""

    def one(c: Condition) -> str:
        value = ("yes" if c.value else "no") if c.field.startswith("has-") else str("" if c.value is None else c.value).strip() or "(any)"
        return f"{'NOT ' if c.negate else ''}{LABELS[c.field]}: {value}"

    return " · ".join(map(one, conditions)) or "(no filters)"


def search(tokens: DataFrame, text: str, mode: str = "token") -> DataFrame:
    """(doc_id, pos, text) of tokens that equal or contain ``text`` after the search fold."""
    wanted = fold(F.lit(text))
    return tokens.filter(fold(F.col("text")) == wanted if mode == "token" else fold(F.col("text")).contains(wanted)).select("doc_id", "pos", "text")


def merge(tables: list[DataFrame], key: str, policy: str = "error", order: str | None = None) -> DataFrame:
    """Ordered concatenation; of equal keys the first or last stays, or later ones get ``#2`` on, or
    any is an error. Within a table rows stand in the order of ``order``, by default the key."""
    if policy not in ("error", "first", "last", "suffix"):
        raise ValueError(f"unknown policy {policy!r}")
    within = order or key
    rows = tables[0].withColumn("_src", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("_src", F.lit(k)))
    if policy == "suffix":
        n = F.row_number().over(W.partitionBy(key).orderBy("_src", within))
        return rows.withColumn(key, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#"), n.cast("string")))).drop("_src")
    if policy == "error":
        n = F.count("*").over(W.partitionBy(key))
        same = F.when(n > 1, F.raise_error(F.concat(F.lit("key occurs more than once: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
        return rows.withColumn("_ok", same).filter("_ok").drop("_ok", "_src")
    by = ["_src", within] if policy == "first" else [F.desc("_src"), F.desc(within)]
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter("_n = 1").drop("_n", "_src")
