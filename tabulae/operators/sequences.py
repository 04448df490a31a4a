"""Sequences of signs within words: edges, varieties, transitions, surprisal. A word's signs
are its characters; every table is aggregated over the vocabulary, not over tokens."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.functions.measures import g2, pmi


def signs(vocab: DataFrame) -> DataFrame:
    """(text, n, k, sign, size): a row for each sign of each word, ``k`` from 0."""
    return vocab.select("text", "n", F.length("text").cast("long").alias("size"), F.posexplode(F.split("text", "")).alias("k", "sign")).withColumn("k", F.col("k").cast("long"))


def transitions(vocab: DataFrame, boundaries: bool = True) -> DataFrame:
    """(a, b, n): token-weighted adjacent signs, with ``^`` and ``$`` at the word's ends."""
    word = F.concat(F.lit("^"), F.col("text"), F.lit("$")) if boundaries else F.col("text")
    rows = vocab.select("n", F.split(word, "").alias("s")).select("n", F.explode(F.expr("transform(sequence(1, greatest(size(s) - 1, 1)), i -> struct(s[i-1] as a, get(s, i) as b))")).alias("x"))
    return rows.filter("x.b IS NOT NULL").groupBy("x.a", "x.b").agg(F.sum("n").alias("n"))


def bigram_pmi(vocab: DataFrame, min_count: int = 1) -> DataFrame:
    pairs = transitions(vocab, boundaries=False)
    left = pairs.groupBy("a").agg(F.sum("n").alias("l"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("r"))
    total = pairs.agg(F.sum("n").alias("t"))
    rows = pairs.filter(F.col("n") >= min_count).join(left, "a").join(right, "b").crossJoin(F.broadcast(total))
    return rows.select("a", "b", "n", F.round(pmi(F.col("n"), F.col("l"), F.col("r"), F.col("t")), 6).alias("pmi"))


def edge_bias(vocab: DataFrame) -> DataFrame:
    """Each sign's token counts at word ends against inside, with signed G2."""
    rows = signs(vocab).filter("size >= 3").withColumn("edge", (F.col("k") == 0) | (F.col("k") == F.col("size") - 1))
    counts = rows.groupBy("sign").agg(F.sum(F.when(F.col("edge"), F.col("n")).otherwise(0)).alias("edge_n"), F.sum(F.when(~F.col("edge"), F.col("n")).otherwise(0)).alias("inner_n"))
    total = counts.agg(F.sum("edge_n").alias("et"), F.sum("inner_n").alias("it"))
    rows = counts.crossJoin(F.broadcast(total))
    sign = F.when(F.col("edge_n") / F.col("et") >= F.col("inner_n") / F.col("it"), 1.0).otherwise(-1.0)
    return rows.select("sign", "edge_n", "inner_n", F.round(sign * g2(F.col("edge_n"), F.col("inner_n"), F.col("et"), F.col("it")), 3).alias("bias"))


def productivity(vocab: DataFrame, length: int = 3) -> DataFrame:
    """Hapax types over tokens for each final string of ``length`` signs."""
    rows = vocab.filter(F.length("text") > length).select(F.expr(f"substring(text, length(text) - {length - 1}, {length})").alias("suffix"), "n")
    return rows.groupBy("suffix").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("hapaxes")).withColumn("productivity", F.round(F.col("hapaxes") / F.col("tokens"), 6))


def witten_bell_surprisal(vocab: DataFrame) -> DataFrame:
    """Mean bits a transition of each word under a Witten-Bell model that leaves the word's own
    counts out. Marginals join on sign pairs, a table no larger than the alphabet squared."""
    word = F.concat(F.lit("^"), F.col("text"), F.lit("$"))
    own = vocab.select("text", "n", F.split(word, "").alias("s")).select("text", "n", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(s[i-1] as a, s[i] as b))")).alias("x")).groupBy("text", "n", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("m"))
    # every table below is an aggregate of this one: it is kept, on disk where memory is short
    own = own.persist(StorageLevel.MEMORY_AND_DISK)
    pair = own.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("n")).alias("ab"))
    left = pair.groupBy("a").agg(F.sum("ab").alias("a_n"), F.count("*").alias("a_types"))
    right = pair.groupBy("b").agg(F.sum("ab").alias("b_n"))
    total = pair.agg(F.sum("ab").alias("t"))
    own_a = own.groupBy("text", "a").agg(F.sum(F.col("m") * F.col("n")).alias("own_a"))
    rows = own.join(own_a, ["text", "a"]).join(pair, ["a", "b"]).join(left, "a").join(right, "b").crossJoin(F.broadcast(total))  # one row
    own_ab = F.col("m") * F.col("n")
    base = (F.col("b_n") - own_ab + 1.0) / (F.col("t") - own_ab + 100.0)
    types = F.col("a_types") - F.when(F.col("ab") == own_ab, 1).otherwise(0)
    c_a, c_ab = F.col("a_n") - F.col("own_a"), F.col("ab") - own_ab
    p = F.when(c_a + types > 0, (c_ab + types * base) / F.nullif(c_a + types, F.lit(0))).otherwise(base)
    p = F.when(p > 0, p).otherwise(base)
    return rows.groupBy("text").agg(F.sum("m").alias("steps"), F.round(F.sum(-F.log2(p) * F.col("m")) / F.sum("m"), 5).alias("bits"))
