"""Statistics of count tables: frequencies, dispersion, keyness, diversity, rank correlation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.measures import g2


def prefix_sums(rows: DataFrame, by: list[str], order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """``rows`` with ``upto_x`` for each column x: its sum over the rows of the group up to this one.
    A group is cut into ranges of the order column, whose sums are added up first, so that a large
    group isn't one task. Of equal order values any comes first."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, [k / parts for k in range(1, parts)]).alias("_cuts"))
    placed = rows.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns]).select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in columns])
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(starts, [*by, "_range"])
    return out.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"_start_{c}")).alias(f"upto_{c}") for c in columns])


def group_heads(rows: DataFrame, by: list[str], order: str, size: str, top: int = 3) -> DataFrame:
    """Each group's rows, summed size and first ids: only ``top`` rows of a group are gathered."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order))
    heads = rows.select(*by, order, place.alias("_r")).filter(F.col("_r") <= top).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), ",").alias("first_docs"))
    return rows.groupBy(*by).agg(F.count("*").alias("docs"), F.sum(size).alias("chars")).join(heads, by)


def word_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("text").agg(F.count("*").alias("n"))


def dispersions(tokens: DataFrame, min_count: int = 1, item: str = "text", part: str = "doc_id") -> DataFrame:
    """Deviation of proportions of every item over parts: parts without the item add their own
    share, so only (item, part) pairs that occur are aggregated, never their product."""
    pairs = tokens.groupBy(item, part).agg(F.count("*").alias("c"))
    sizes = pairs.groupBy(part).agg(F.sum("c").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    sizes = sizes.crossJoin(F.broadcast(total)).select(part, (F.col("size") / F.col("total")).alias("share"))
    freq = pairs.groupBy(item).agg(F.sum("c").alias("n")).filter(F.col("n") >= min_count)
    rows = pairs.join(freq, item).join(sizes, part)
    out = rows.groupBy(item).agg(F.first("n").alias("n"), F.count("*").alias("parts"), F.sum(F.abs(F.col("c") / F.col("n") - F.col("share"))).alias("d"), F.sum("share").alias("s"))
    return out.select(F.col(item).alias("item"), "n", "parts", F.round(0.5 * (F.col("d") + 1 - F.col("s")), 6).alias("dp"))


def document_dispersions(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """``dispersions`` over documents, of (text, c, size): a document's size stands beside its counts, so they
    are shuffled once, to their word's total; the totals are kept, a row a word."""
    freq = counts.groupBy("text").agg(F.sum("c").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    total = freq.agg(F.sum("n").alias("total"))  # one row
    rows = counts.join(freq.filter(F.col("n") >= min_count), "text").crossJoin(F.broadcast(total))
    share = F.col("size") / F.col("total")
    out = rows.groupBy("text").agg(F.first("n").alias("n"), F.count("*").alias("parts"), F.sum(F.abs(F.col("c") / F.col("n") - share)).alias("d"), F.sum(share).alias("s"))
    return out.select(F.col("text").alias("item"), "n", "parts", F.round(0.5 * (F.col("d") + 1 - F.col("s")), 6).alias("dp"))


def keyness(tokens: DataFrame, target: str, min_count: int = 3) -> DataFrame:
    """Each word's counts in the target and the rest, signed by nothing: G2 and the log2 ratio of
    rates, a half added to zero cells only. ``target`` is a condition on token rows; both
    counts come from one aggregation, so there is no join of two tables."""
    inside = F.expr(target)
    rows = tokens.groupBy("text").agg(F.count_if(inside).alias("a"), F.count_if(~inside).alias("b"))
    total = rows.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    rows = rows.filter((F.col("a") >= min_count) | (F.col("b") >= min_count)).crossJoin(F.broadcast(total))
    half = lambda c: F.when(F.col(c) == 0, 0.5).otherwise(F.col(c).cast("double"))
    ratio = F.log2((half("a") / F.col("n1")) / (half("b") / F.col("n2")))
    return rows.select("text", "a", "b", F.round(g2(F.col("a"), F.col("b"), F.col("n1"), F.col("n2")), 4).alias("g2"), F.round(ratio, 6).alias("log_ratio"))


def entropy(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Plug-in entropy in bits of the counts in each group, and with the Miller-Madow term."""
    total = F.sum(n)
    plug = F.log2(total.cast("double")) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total
    bias = F.when(F.count("*") > 1, (F.count("*") - 1) / (2 * total * F.ln(F.lit(2.0)))).otherwise(F.lit(0.0))
    return counts.groupBy(by).agg(F.count("*").alias("types"), total.alias("total"), F.round(plug, 6).alias("entropy"), F.round(plug + bias, 6).alias("miller_madow"))


def chao1(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Lower bound of richness from singletons and doubletons."""
    s, f1, f2 = F.count("*"), F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)
    more = F.when(f2 > 0, f1 * f1 / (2.0 * F.nullif(f2, F.lit(0)))).otherwise(f1 * (f1 - 1) / 2.0)
    return counts.groupBy(by).agg(s.alias("types"), f1.alias("f1"), f2.alias("f2"), F.round(s + more, 6).alias("chao1"))


def heaps(tokens: DataFrame, by: str) -> DataFrame:
    """Least squares of log types on log tokens over documents in order, per group: the size and
    vocabulary after each document. First sightings are found by one aggregation."""
    sizes = tokens.groupBy(by, "doc_id").agg(F.count("*").alias("size"))
    first = tokens.groupBy(by, "text").agg(F.min("doc_id").alias("doc_id")).groupBy(by, "doc_id").agg(F.count("*").alias("fresh"))
    steps = sizes.join(first, [by, "doc_id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    points = prefix_sums(steps, [by], "doc_id", ["size", "fresh"]).select(by, F.ln("upto_size").alias("x"), F.ln("upto_fresh").alias("y"))
    fit = points.groupBy(by).agg(F.count("*").alias("points"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("k"), F.regr_r2("y", "x").alias("r2"))
    return fit.filter("points >= 5").select(by, "points", F.round("b", 6).alias("beta"), F.round(F.exp("k"), 4).alias("k"), F.round("r2", 6).alias("r2"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, per group; 0 for under 3 rows or a constant."""

    def ranked(c: str, name: str) -> DataFrame:
        # distinct values are ranked, a range of them a task, and rows find their value's rank
        values = rows.groupBy(by, c).agg(F.count("*").alias("_n"))
        upto = prefix_sums(values, [by], c, ["_n"])
        return upto.select(by, c, (F.col("upto__n") - (F.col("_n") - 1) / 2.0).alias(name))

    ranks = rows.select(by, x, y).join(ranked(x, "rx"), [by, x]).join(ranked(y, "ry"), [by, y])
    n = F.count("*")
    sx, sy = F.sum("rx"), F.sum("ry")
    cov = n * F.sum(F.col("rx") * F.col("ry")) - sx * sy
    spread = F.sqrt((n * F.sum(F.col("rx") * F.col("rx")) - sx * sx) * (n * F.sum(F.col("ry") * F.col("ry")) - sy * sy))
    return ranks.groupBy(by).agg(n.alias("n"), F.round(F.when((n < 3) | (spread == 0), F.lit(0.0)).otherwise(F.try_divide(cov, spread)), 6).alias("rho"))


def mattr(tokens: DataFrame, window: int = 50) -> DataFrame:
    """Mean type-token ratio over all windows of each document with one that long.

    A word adds one type to each window that holds it; counted by gaps between its uses
    (a use adds as many windows as reach it but not its predecessor), so no window is built."""
    size = F.count("*").over(W.partitionBy("doc_id"))
    before = F.lag("pos").over(W.partitionBy("doc_id", "text").orderBy("pos"))
    rows = tokens.select("doc_id", "pos", size.alias("size"), before.alias("before")).filter(F.col("size") >= window)
    # windows start at 1 .. size - window + 1; those with this use and not the one before
    first = F.greatest(F.col("pos") - window + 1, F.coalesce(F.col("before") + 1, F.lit(1)), F.lit(1))
    last = F.least(F.col("pos"), F.col("size") - window + 1)
    rows = rows.withColumn("adds", F.greatest(F.lit(0), last - first + 1))
    return rows.groupBy("doc_id").agg(F.first("size").alias("size"), F.sum("adds").alias("types")).select("doc_id", "size", F.round(F.col("types") / (window * (F.col("size") - window + 1.0)), 6).alias("mattr"))


def coverage(tokens: DataFrame, reference: str, min_count: int, by: str) -> DataFrame:
    """(by, tokens, known): tokens of each group, and those of words that the rows with ``reference`` (a
    condition) hold ``min_count`` times. Words are counted before anything is joined or shuffled."""
    rows = tokens.groupBy("text", by).agg(F.count("*").alias("n"), F.count_if(F.expr(reference)).alias("r"))
    # a word's groups: as many as there are labels, not tokens
    rows = rows.groupBy("text").agg(F.sum("r").alias("r"), F.collect_list(F.struct(F.col(by).alias("by"), "n")).alias("x"))
    rows = rows.select("r", F.explode("x").alias("x"))
    return rows.groupBy(F.col("x.by").alias(by)).agg(F.sum("x.n").alias("tokens"), F.sum(F.when(F.col("r") >= min_count, F.col("x.n")).otherwise(0)).alias("known"))


def rarity(tokens: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean of 1 - log1p(count) / log1p(largest count) over each document's words."""
    most = reference.agg(F.max("n").alias("most"))
    rows = tokens.join(reference, "text", "left").crossJoin(F.broadcast(most))
    return rows.groupBy("doc_id").agg(F.count("*").alias("words"), F.round(F.avg(1 - F.log1p(F.coalesce("n", F.lit(0)).cast("double")) / F.log1p(F.col("most").cast("double"))), 6).alias("rarity"))
