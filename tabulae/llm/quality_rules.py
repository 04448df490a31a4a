"""Operator 3: line-first quality rules, in DataFrame functions only.

Each line is judged by itself: it fails when it has no closing punctuation, is a navigation
line (separators between few words), holds a boilerplate phrase, or is made of symbols.
Failing lines are removed; a document that keeps less than ``min_kept`` of its words is
rejected, as is one that fails the base counts (too few words, too many repeated windows).

Nothing is exploded or shuffled: words, lines and windows stay arrays within the row, and
repeats are found by sorting the row's own window hashes, so a row costs n log n time and
memory in its own length only. A ``transform`` over a one-element array binds a value that
several places use, so it is computed once.

Null texts have no words: all counts are 0 and they are not kept. Repeated rows are judged
each on its own, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]+"
BOILERPLATE = "(?i)\\b(cookies?|javascript|lorem ipsum|terms of (use|service)|privacy policy|sign (in|up)|log ?in|subscribe|click here|read more|share (this|on)|skip to|powered by)\\b"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_repeat_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the row."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        def repeated(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
            return F.transform(s, lambda e, i: F.when(same(F.get(s, i - 1), e) | same(F.get(s, i + 1), e), e["i"]))

        def reach(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(ordered, repeated), lambda r: let(F.array_sort(F.filter(r, F.isnotnull)), reach)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line meets every rule; lines without a word pass, they cost nothing."""
    n = F.length(line)
    symbols = n - F.length(F.regexp_replace(line, "[#*$%&|<>]", ""))
    ends = line.rlike("[.!?:;\\\"'”’»)…。！？][ \\t-\\r]*$")
    navigation = (symbols > 0) & line.rlike("^[^|>]{0,40}([|>][^|>]{0,40}){2,}$")
    return ~line.rlike("[^ \\t-\\r]") | (ends & ~navigation & (symbols * 10 <= n) & ~line.rlike(BOILERPLATE))


def quality_columns(text: Column, min_kept: float = 0.5) -> dict[str, Column]:
    """The rule columns for a text column that is not null and has a ``words`` array beside it."""
    words = F.col("__llm_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(words),
        "clean_text": F.array_join(F.filter(F.split(text, "\n"), line_passes), "\n"),
    }


def judge(docs: DataFrame, min_kept: float = 0.5) -> DataFrame:
    """One row for each document: the counts, the cleaned text and the verdict."""
    base = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("__llm_text"))
    base = base.select("doc_id", "__llm_text", words_of(F.col("__llm_text")).alias("__llm_words"))
    rows = base.select("doc_id", *[c.alias(k) for k, c in quality_columns(F.col("__llm_text")).items()])
    kept_words = F.size(words_of(F.col("clean_text"))).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.select("*", kept_words.alias("n_kept_words"), failed.alias("base_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= min_kept * F.col("n_words")))


def quality_rules(docs: DataFrame, min_kept: float = 0.5) -> DataFrame:
    """``judge`` without the texts."""
    return judge(docs, min_kept).drop("clean_text")


def clean_documents(docs: DataFrame, min_kept: float = 0.5) -> DataFrame:
    """``docs`` without the rejected documents and the failing lines of the others; all columns
    stay, ``n_chars`` is counted again. One projection, without a join or a shuffle."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.withColumn("__llm_text", text).withColumn("__llm_words", words_of(F.col("__llm_text")))
    made = quality_columns(F.col("__llm_text"))
    rows = rows.select("*", *[made[k].alias(f"__llm_{k}") for k in ("n_words", "n_repeat_words", "clean_text")])
    kept = F.size(words_of(F.col("__llm_clean_text")))
    rows = rows.filter((F.col("__llm_n_words") >= 10) & (100 * F.col("__llm_n_repeat_words") <= 20 * F.col("__llm_n_words")) & (kept >= min_kept * F.col("__llm_n_words")))
    made = {"text": F.col("__llm_clean_text"), "n_chars": F.length("__llm_clean_text").cast("long")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
