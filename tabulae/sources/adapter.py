"""From a documents table to the corpus model: one row a token, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "(\\p{L}+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, site, period, scribe, pos, text): words in lower case, ``pos`` from 1."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(1))
    rows = documents.select("doc_id", F.col("source").alias("site"), F.col("lang").alias("period"), (F.col("doc_id") % 10).cast("string").alias("scribe"), F.posexplode(words).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("long") + 1)


def _split_by_repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id stands once, and those with an id that stands again, if any. Only ids are shuffled
    to find them."""
    again = documents.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return documents, None
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return documents.join(again, same, "left_anti"), documents.join(again, same, "left_semi")


def document_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, words): each document's different words. A document is a row of its own already, so nothing is
    shuffled, but for ids that stand again: their texts are one document."""
    sets = lambda d: d.select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(1))).alias("words"))
    once, again = _split_by_repeats(documents)
    if again is None:
        return sets(once)
    return sets(once).unionByName(sets(again).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")))


def document_counts(documents: DataFrame) -> DataFrame:
    """(text, c, size): a row for each different word of each document, with its count there and the
    document's words. Words are sorted and counted within the row, so nothing is shuffled, but for
    ids that stand again: their texts are one document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(1))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        count = lambda p: F.transform(p, lambda at, j: F.struct(F.get(s, at).alias("text"), (F.coalesce(F.get(p, j + 1), F.size(s)) - at).cast("long").alias("c"), F.size(s).cast("long").alias("size")))
        return F.flatten(F.transform(F.array(starts), count))

    once, again = _split_by_repeats(documents)
    sorted_words = [once.select(F.array_sort(words).alias("s"))]
    if again is not None:
        sorted_words.append(again.select("doc_id", words.alias("w")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("s")).select("s"))
    # names are bound inside the expression: a filter on it would find the words again
    rows = [d.select(F.explode(F.flatten(F.transform(F.array("s"), runs))).alias("x")).select("x.*") for d in sorted_words]
    out = rows[0] if again is None else rows[0].unionByName(rows[1])
    return out.filter("c > 0")


def line_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, words): each line's different words, lines numbered from 1; of ids that stand again
    lines of one number are one."""

    def sets(d: DataFrame) -> DataFrame:
        lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        return lines.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(LETTERS), F.lit(1))).alias("words"))

    once, again = _split_by_repeats(documents)
    if again is None:
        return sets(once)
    return sets(once).unionByName(sets(again).groupBy("doc_id", "line_no").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")))


def vocabulary(token_rows: DataFrame) -> DataFrame:
    """(text, n): distinct words with their counts; the sign level of a word is its characters."""
    return token_rows.groupBy("text").agg(F.count("*").alias("n"))
