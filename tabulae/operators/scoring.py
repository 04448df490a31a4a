"""Scores of predicted lemmas, tags and heads, calibration and abstention. Rows have form, gold_lemma,
gold_pos, lemma, pos, seen (in training) and scored; predictions come as columns, from any system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_lemma(lemma: Column) -> Column:
    """Without the numbers that tell homonyms apart; a lemma that is only a number stays."""
    t = F.trim(lemma)
    return F.when(t.rlike("[^0-9]"), F.regexp_replace(t, "[0-9]+$", "")).otherwise(t)


def _hits(rows: DataFrame) -> DataFrame:
    lemma = F.coalesce(clean_lemma(F.col("lemma")), F.lit("")) == F.col("gold_lemma")
    return rows.filter("scored").withColumn("lemma_hit", lemma).withColumn("pos_hit", F.coalesce("pos", F.lit("")) == F.col("gold_pos"))


def score(rows: DataFrame) -> DataFrame:
    """One row: accuracies over all scored tokens and over those of forms unseen in training."""
    r, unseen = _hits(rows), ~F.col("seen")
    share = lambda hit, of: F.round(F.coalesce(F.try_divide(F.count_if(hit & of), F.count_if(of)), F.lit(0.0)), 6)
    every = F.lit(True)
    return r.agg(
        share(F.col("lemma_hit"), every).alias("lemma_all"), share(F.col("pos_hit"), every).alias("pos_all"), share(F.col("lemma_hit"), unseen).alias("lemma_unseen"), share(F.col("pos_hit"), unseen).alias("pos_unseen"),
        F.count("*").alias("n_all"), F.count_if("seen").alias("n_seen"), F.count_if(unseen).alias("n_unseen"),
    )


def confusions(rows: DataFrame, kind: str = "pos") -> DataFrame:
    """(gold, predicted, n) of wrong tags, or of wrong lemmas."""
    r = _hits(rows).filter(~F.col(f"{kind}_hit"))
    predicted = F.coalesce("pos" if kind == "pos" else clean_lemma(F.col("lemma")), F.lit(""))
    return r.groupBy(F.col(f"gold_{kind}").alias("gold"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def by_tag(rows: DataFrame) -> DataFrame:
    """(gold_pos, n, pos_correct, lemma_correct)."""
    return _hits(rows).groupBy("gold_pos").agg(F.count("*").alias("n"), F.count_if("pos_hit").alias("pos_correct"), F.count_if("lemma_hit").alias("lemma_correct"))


BANDS = ((1, "1"), (5, "2-5"), (50, "6-50"))


def by_frequency(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(band, n, pos_correct, lemma_correct) by how often a form occurs in a corpus (form, n)."""
    r = _hits(rows).join(frequencies.select("form", F.col("n").alias("freq")), "form", "left")
    band = F.lit("51+")
    for most, name in reversed(BANDS):
        band = F.when(F.coalesce("freq", F.lit(0)) <= most, name).otherwise(band)
    return r.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("pos_hit").alias("pos_correct"), F.count_if("lemma_hit").alias("lemma_correct"))


def attachment(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tokens, uas, las of rows (gold_head, gold_deprel, head, deprel), in all or by group."""
    head = F.coalesce(F.col("head") == F.col("gold_head"), F.lit(False))
    label = head & F.coalesce(F.col("deprel") == F.col("gold_deprel"), F.lit(False))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("tokens"), share(head).alias("uas"), share(label).alias("las"))


def decide(task: Column, confidence: Column, thresholds: dict[str, float]) -> Column:
    """struct(action, reason): accept from the task's threshold on, review below it; unavailable
    without a confidence or a threshold. A confidence outside [0, 1] is an error."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, v)]), task) if thresholds else F.lit(None).cast("double")
    bad = confidence.isNotNull() & ~confidence.between(0, 1)
    action = F.when(bad, F.raise_error("confidence outside [0, 1]").cast("string")).when(confidence.isNull() | limit.isNull(), "unavailable").when(confidence >= limit, "accept").otherwise("review")
    reason = F.when(confidence.isNull(), "no confidence").when(limit.isNull(), "no threshold")
    return F.struct(action.alias("action"), reason.alias("reason"))


def calibrate_logit(p: Column, slope: float, intercept: float) -> Column:
    """An affine map of a probability's logit, back as a probability; 0 and 1 stay."""
    t = slope * F.ln(p / F.nullif(1 - p, F.lit(0.0))) + intercept
    return F.when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(1 / (1 + F.exp(-t)))
