"""Ledgers: stated totals against items, and a metrology census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.operators.counts import prefix_sums


def closed_sections(lines: DataFrame, item: Column, *keep: str) -> DataFrame:
    """A row for each total of ``lines`` (doc_id, line_no, role, value): what it states (line_no, role, value,
    ``keep``), the sum and number of the lines with ``item`` since the total before (``computed``, ``items``), and for a
    grand total those of the totals since the grand total before besides. Lines are narrowed and sorted
    once; two running counts number the sections, which are then rows of a hash aggregate."""
    closes, grand = F.col("role").isin("total", "grand-total"), F.col("role") == "grand-total"
    rows = lines.select("doc_id", "line_no", "value", *keep, item.alias("_item"), F.when(grand, 2).when(closes, 1).otherwise(0).cast("byte").alias("_close"))
    past = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    number = lambda c: F.coalesce(F.count_if(c).over(past), F.lit(0))
    rows = rows.withColumn("_sec", number(F.col("_close") > 0)).withColumn("_gsec", number(F.col("_close") > 1))
    # of a section's lines the last alone closes it
    last = [F.max(F.when(F.col("_close") > 0, F.col(c))).alias(c) for c in ("line_no", "value", *keep)]
    rows = rows.groupBy("doc_id", "_sec", "_gsec").agg(*last, F.max("_close").alias("_close"), F.sum(F.when(F.col("_item"), F.col("value"))).alias("_sum"), F.count_if("_item").alias("_n")).filter("_close > 0")
    part, total = W.partitionBy("doc_id", "_gsec"), F.col("_close") == 1
    subs = F.coalesce(F.sum(F.when(total, F.col("value"))).over(part), F.lit(0.0))
    grand = F.col("_close") == 2
    computed = F.coalesce("_sum", F.lit(0.0)) + F.when(grand, subs).otherwise(0.0)
    items = F.col("_n") + F.when(grand, F.count_if(total).over(part)).otherwise(0)
    return rows.select("doc_id", "line_no", F.when(grand, "grand-total").otherwise("total").alias("role"), "value", *keep, computed.alias("computed"), items.alias("items"))


def check_balances(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, line_no, role, value), role item, total or grand-total. A total covers
    the items since the total before; a grand total the totals since the grand total before
    and trailing items. The machine that reads line by line becomes numbered sections, so documents run in parallel."""
    rows = closed_sections(lines, F.col("role") == "item")
    return rows.select("doc_id", "line_no", "role", F.round("value", 2).alias("stated"), F.round("computed", 2).alias("computed"), (F.abs(F.col("value") - F.col("computed")) <= 0.01).alias("balanced"))


def metrology(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, sum, upper median and share of fractional values in each group."""
    fractional = F.count_if(F.col(value) != F.floor(value))
    values = prefix_sums(rows.groupBy(by, value).agg(F.count("*").alias("_n")), [by], value, ["_n"])
    total = rows.groupBy(by).agg(F.count("*").alias("_all"))
    mid = values.join(total, by).filter("upto__n > floor(_all / 2)").groupBy(by).agg(F.min(value).alias("upper_median"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(fractional / F.count("*"), 6).alias("fractional")).join(mid, by)
