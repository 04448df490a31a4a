"""Edges, varieties and cuts of words in signs. ``words`` tables have (text, n): distinct words
and their counts; signs stand between hyphens, or are the characters of a word without one."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.measures import log_likelihood_2x2, wilson


def units(word: Column) -> Column:
    return F.when(word.contains("-"), F.filter(F.split(word, "-"), lambda p: p != "")).otherwise(F.split(word, ""))


def edge_bias_g2(edge: Column, edge_total: Column, inner: Column, inner_total: Column) -> Column:
    """Signed G2 of an edge rate against an inner rate; 0 where either total is empty."""
    value = log_likelihood_2x2(edge, edge_total, edge + inner, edge_total + inner_total)
    more = F.try_divide(edge, edge_total) >= F.try_divide(inner, inner_total)
    return F.when((edge_total <= 0) | (inner_total <= 0), F.lit(0.0)).otherwise(F.when(more, value).otherwise(-value))


def _affixed(words: DataFrame, length: int, mode: str) -> DataFrame:
    if mode not in ("suffix", "prefix"):
        raise ValueError(f"mode must be suffix or prefix, not {mode!r}")
    parts = F.split("text", "-")
    rows = words.filter(F.size(parts) > length).select("n", parts.alias("p"))
    start = F.size("p") - length + 1 if mode == "suffix" else F.lit(1)
    return rows.withColumn("affix", F.array_join(F.slice("p", start, length), "-"))


def affix_edge_bias(words: DataFrame, length: int = 1, mode: str = "suffix") -> DataFrame:
    """(affix, edge_n, inner_n, g2): tokens with the affix at the word's end (or start) against all
    other windows of that length."""
    rows = _affixed(words, length, mode)
    edge = rows.groupBy("affix").agg(F.sum("n").alias("edge_n"))
    window = F.transform(F.sequence(F.lit(1), F.size("p") - length + 1), lambda i: F.array_join(F.slice(F.col("p"), i, F.lit(length)), "-"))
    every = rows.select("n", F.explode(window).alias("affix")).groupBy("affix").agg(F.sum("n").alias("all_n"))
    totals = edge.agg(F.sum("edge_n").alias("et")).crossJoin(every.agg(F.sum("all_n").alias("at")))  # one row each
    out = edge.join(every, "affix").crossJoin(F.broadcast(totals)).withColumn("inner_n", F.col("all_n") - F.col("edge_n"))
    return out.select("affix", "edge_n", "inner_n", F.round(edge_bias_g2(F.col("edge_n"), F.col("et"), F.col("inner_n"), F.col("at") - F.col("et")), 4).alias("g2"))


def affix_productivity(words: DataFrame, length: int = 1, mode: str = "suffix") -> DataFrame:
    """(affix, tokens, types, hapaxes, productivity): hapaxes over tokens."""
    rows = _affixed(words, length, mode).groupBy("affix").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapaxes"))
    return rows.withColumn("productivity", F.round(F.try_divide("hapaxes", "tokens"), 6))


def positional_bias(tokens: DataFrame, min_count: int = 2) -> DataFrame:
    """(word, n, initial, medial, final, dominant, g2) of hyphenated words over documents: a lone
    word is first and last. ``tokens`` has (doc_id, pos, text); signed G2 of the dominant slot."""
    rows = tokens.filter(F.col("text").contains("-"))
    size = F.count("*").over(W.partitionBy("doc_id"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    rows = rows.select(F.col("text").alias("word"), size.alias("size"), place.alias("k"))
    first, last = F.col("k") == 1, F.col("k") == F.col("size")
    out = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if(first).alias("initial"), F.count_if(~first & ~last).alias("medial"), F.count_if(last).alias("final"))
    totals = out.agg(*[F.sum(c).alias(f"all_{c}") for c in ("initial", "medial", "final")])
    out = out.filter(F.col("n") >= min_count).crossJoin(F.broadcast(totals))  # one row
    a, b, c = F.col("initial"), F.col("medial"), F.col("final")
    slot = F.when((a >= b) & (a >= c), "initial").when((c >= b) & (c >= a), "final").otherwise("medial")
    pick = lambda p: F.when(slot == "initial", F.col(f"{p}initial")).when(slot == "final", F.col(f"{p}final")).otherwise(F.col(f"{p}medial"))
    grand = F.col("all_initial") + F.col("all_medial") + F.col("all_final")
    g2 = positional_bias_g2(pick(""), a + b + c, pick("all_"), grand)
    return out.select("word", "n", "initial", "medial", "final", slot.alias("dominant"), F.round(g2, 4).alias("g2"))


def positional_bias_g2(in_slot: Column, slots: Column, slot_total: Column, grand: Column) -> Column:
    """Signed G2 of an item's share in a slot against the other items' share."""
    value = log_likelihood_2x2(in_slot, slots, slot_total, grand)
    more = F.try_divide(in_slot, slots) >= F.coalesce(F.try_divide(slot_total - in_slot, grand - slots), F.lit(0.0))
    return F.when((slots <= 0) | (grand - slots <= 0), F.lit(0.0)).otherwise(F.when(more, value).otherwise(-value))


def varieties(sequences: DataFrame, column: str = "u") -> DataFrame:
    """(depth, prefix, variety): different signs that follow each prefix, of any length, also the
    empty one. A prefix is cut from the joined signs, which hold no hyphens themselves."""
    step = F.transform(F.sequence(F.lit(1), F.size(column)), lambda i: F.struct((i - 1).alias("depth"), F.call_function("substring_index", F.col("j"), F.lit("-"), i - 1).alias("prefix"), F.element_at(F.col(column), i).alias("next")))
    rows = sequences.filter(F.size(column) > 0).withColumn("j", F.array_join(column, "-")).select(F.explode(step).alias("s")).select("s.*").distinct()
    return rows.groupBy("depth", "prefix").agg(F.count("*").alias("variety"))


def successor_variety(words: DataFrame, min_signs: int = 2, min_variety: int = 3) -> DataFrame:
    """(stem, variety, parent_variety, ratio) of stems with enough signs and followers: the
    followers over the mean of stems of that length. Words of one sign count for nothing."""
    long_words = words.select(F.split("text", "-").alias("u")).filter(F.size("u") >= 2)
    rows = varieties(long_words).filter("depth >= 1")
    mean = rows.groupBy("depth").agg(F.avg("variety").alias("mean"))
    parents = rows.select(F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("variety").alias("parent_variety"))
    kept = rows.filter((F.col("depth") >= min_signs) & (F.col("variety") >= min_variety))
    kept = kept.withColumn("parent", F.array_join(F.slice(F.split("prefix", "-"), F.lit(1), F.col("depth") - 1), "-"))
    out = kept.join(mean, "depth").join(parents, ["parent", "depth"], "left")
    return out.select(F.col("prefix").alias("stem"), "variety", F.coalesce("parent_variety", F.lit(0)).alias("parent_variety"), F.round(F.col("variety") / F.col("mean"), 6).alias("ratio"))


def segment(words: DataFrame) -> DataFrame:
    """(text, cuts, pieces): words cut where the number of successors of the prefix, or of
    predecessors of the suffix, peaks: not below the sign before and above the one behind."""
    # all that follows reads the vocabulary, which is counted once and kept, on disk where memory is short
    rows = words.select("text").distinct().withColumn("u", units(F.col("text"))).persist(StorageLevel.MEMORY_AND_DISK)
    seen = rows.select("u")
    ways = {"s": varieties(seen), "p": varieties(seen.select(F.reverse("u").alias("u")))}
    out = None
    for side, table in ways.items():
        own = F.col("u") if side == "s" else F.reverse("u")
        prefixes = F.transform(F.sequence(F.lit(1), F.size("u") - 1), lambda i: F.struct(i.alias("depth"), F.call_function("substring_index", F.col("j"), F.lit("-"), i).alias("prefix")))
        r = rows.filter(F.size("u") >= 2).withColumn("j", F.array_join(own, "-")).select("text", F.size("u").alias("size"), F.explode(prefixes).alias("x")).select("text", "size", "x.*").join(table, ["depth", "prefix"])
        by = W.partitionBy("text").orderBy("depth")
        peak = F.coalesce(F.col("variety") >= F.lag("variety").over(by), F.lit(True)) & F.coalesce(F.col("variety") > F.lead("variety").over(by), F.lit(False))
        r = r.withColumn("peak", peak).filter("peak").select("text", (F.col("depth") if side == "s" else F.col("size") - F.col("depth")).alias("cut"))
        out = r if out is None else out.unionByName(r)
    found = out.groupBy("text").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    rows = rows.join(found, "text", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    bounds = F.concat(F.array(F.lit(0)), F.col("cuts"), F.array(F.size("u")))
    join = lambda a: F.when(F.col("text").contains("-"), F.array_join(a, "-")).otherwise(F.array_join(a, ""))
    rows = rows.withColumn("b", bounds)
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: join(F.slice(F.col("u"), F.get(F.col("b"), i) + 1, F.get(F.col("b"), i + 1) - F.get(F.col("b"), i))))
    return rows.select("text", "cuts", F.filter(pieces, lambda p: p != "").alias("pieces"))


def candidate_morphs(words: DataFrame, min_count: int = 2) -> DataFrame:
    """(morph, n): last pieces of cut words with the number of different words that bear them."""
    rows = segment(words).filter((F.size("cuts") > 0) & (F.size("pieces") > 1))
    return rows.groupBy(F.element_at("pieces", -1).alias("morph")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def pmi_interval(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """struct(low, high): the joint share's Wilson interval as PMI in bits; low is -20 where the
    interval reaches 0, both are infinite for an empty margin."""
    band = wilson(joint, total)
    base = F.try_divide(left, total) * F.try_divide(right, total)
    empty = (total == 0) | (left == 0) | (right == 0)
    low = F.when(empty, F.lit(float("-inf"))).when(band["low"] > 0, F.log2(F.try_divide(band["low"], base))).otherwise(F.lit(-20.0))
    return F.struct(low.alias("low"), F.when(empty, F.lit(float("inf"))).otherwise(F.log2(F.try_divide(band["high"], base))).alias("high"))


def chao1_interval(s: Column, f1: Column, f2: Column) -> Column:
    """struct(estimate, low, high, unseen): the richness bound with its log-normal interval."""
    s, f1, f2 = (c.cast("double") for c in (s, f1, f2))
    r = F.try_divide(f1, f2)
    some = f2 > 0
    estimate = s + F.when(some, F.try_divide(f1 * f1, 2 * f2)).otherwise(f1 * (f1 - 1) / 2)
    spread = F.when(some, f2 * (r * r / 2 + F.pow(r, 3) + F.pow(r, 4) / 4)).otherwise(f1 * (f1 - 1) / 2 + f1 * F.pow(2 * f1 - 1, 2) / 4 - F.try_divide(F.pow(f1, 4), 4 * estimate))
    t = estimate - s
    flat = (s <= 0) | (f1 <= 0)
    narrow = flat | (t <= 0) | (spread <= 0)
    k = F.exp(1.96 * F.sqrt(F.ln(1 + F.try_divide(spread, t * t))))
    at = F.when(flat, s).otherwise(estimate)
    return F.struct(at.alias("estimate"), F.when(narrow, at).otherwise(s + t / k).alias("low"), F.when(narrow, at).otherwise(s + t * k).alias("high"), F.when(flat, F.lit(0.0)).otherwise(t).alias("unseen"))


def sign_value_counts(words: DataFrame, values: DataFrame) -> DataFrame:
    """(value, n, labels): tokens of the signs of hyphenated words by their phonetic value.
    ``values`` (label, value) is a sign table; signs without a value are left out."""
    rows = words.filter(F.col("text").contains("-")).select("n", F.explode(F.split("text", "-")).alias("label"))
    rows = rows.groupBy("label").agg(F.sum("n").alias("n")).join(values, "label")
    return rows.groupBy("value").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def variant_groups(labels: DataFrame) -> DataFrame:
    """(base, kind, members, n) of sign labels (label): numbered series (up to four capitals and a
    digit) and catalogue numbers with a letter, with the bare base first where it is a label.
    Labels with a plus sign are compounds and in no group."""
    rows = labels.select("label").distinct().filter(~F.col("label").contains("+"))
    number, letter = F.regexp_extract("label", "^([A-Z]{1,4})[0-9]$", 1), F.regexp_extract("label", "^(CM[0-9]+)[A-Z]$", 1)
    kind = F.when(number != "", "homophone-number").when(letter != "", "catalog-suffix")
    found = rows.select("label", F.coalesce(F.nullif(number, F.lit("")), F.nullif(letter, F.lit(""))).alias("base"), kind.alias("kind")).filter("base IS NOT NULL")
    groups = found.groupBy("base", "kind").agg(F.array_sort(F.collect_list("label")).alias("own"))
    groups = groups.join(rows.select(F.col("label").alias("base"), F.lit(True).alias("bare")), "base", "left")
    members = F.when(F.col("bare"), F.concat(F.array("base"), F.col("own"))).otherwise(F.col("own"))
    out = groups.select("base", "kind", members.alias("m")).filter(F.size("m") >= 2)
    return out.select("base", "kind", F.array_join("m", ",").alias("members"), F.size("m").cast("long").alias("n"))
