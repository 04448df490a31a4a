"""Evaluation: calibration, paired tests, confusion, review merging, resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.measures import wilson


def expected_calibration_error(rows: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """One row: the weighted gap of mean confidence and accuracy over equal-width bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = rows.select(b.alias("b"), F.col(p).alias("p"), F.col(y).cast("double").alias("y")).groupBy("b").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg(F.round(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(0.0)), 6).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two systems' hits and the continuity-corrected statistic."""
    out = rows.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.lit(0), F.abs(F.col("only_a") - F.col("only_b")) - 1).cast("double")
    return out.withColumn("chi2", F.round(F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(gap * gap, n.cast("double"))), 6))


def coverage_risk(rows: DataFrame, p: str, y: str, thresholds: list[float]) -> DataFrame:
    """Coverage and error rate of the rows that each threshold accepts, in one pass."""
    spread = rows.select(p, y, F.explode(F.array(*[F.lit(t) for t in sorted(set(thresholds))])).alias("threshold"))
    hit = F.col(p) >= F.col("threshold")
    out = spread.groupBy("threshold").agg(F.count_if(hit).alias("accepted"), F.count("*").alias("n"), F.count_if(hit & (F.col(y) == 0)).alias("wrong"))
    return out.select("threshold", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), F.round(F.try_divide(F.col("wrong"), F.col("accepted")), 6).alias("risk"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    hits = F.count_if(F.col(gold) == F.col(pred))
    band = wilson(hits, F.count("*"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("accuracy"), F.round(band["low"], 6).alias("low"), F.round(band["high"], 6).alias("high"))


def merge_reviews(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """All reviewers' values by key: agreed where they are the same, else a conflict."""
    rows = tables[0].select(key, value)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(key, value))
    out = rows.groupBy(key).agg(F.count("*").alias("reviews"), F.countDistinct(value).alias("values"), F.min(value).alias("low"))
    return out.select(key, "reviews", F.when(F.col("values") == 1, "agreed").otherwise("conflict").alias("state"), F.when(F.col("values") == 1, F.col("low")).alias("value"))


def label_profile(tokens: DataFrame, by: str, top: int = 3) -> DataFrame:
    """Tokens, documents, types and most frequent words of each group."""
    counts = tokens.groupBy(by, "text").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "text"))).filter(F.col("r") <= top)
    tops = ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), ",").alias("top_words"))
    base = tokens.groupBy(by, "doc_id").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    types = counts.groupBy(by).agg(F.count("*").alias("types"))
    return base.join(types, by).join(tops, by)
