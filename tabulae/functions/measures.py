"""Association and uncertainty measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _term(observed: Column, expected: Column) -> Column:
    return F.when((observed > 0) & (expected > 0), observed * F.ln(observed / expected)).otherwise(F.lit(0.0))


def g2(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """Log-likelihood ratio, in nats, of counts a of n1 and b of n2."""
    a, b, n1, n2 = (c.cast("double") for c in (a, b, n1, n2))
    rate = F.try_divide(a + b, n1 + n2)
    return F.lit(2.0) * (_term(a, n1 * rate) + _term(b, n2 * rate))


def log_likelihood_2x2(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """G2 of a two-by-two table from its joint count, margins and total; 0 where a margin is
    empty or everything."""
    joint, left, right, total = (c.cast("double") for c in (joint, left, right, total))
    cells = [(joint, left, right), (left - joint, left, total - right), (right - joint, total - left, right), (total - left - right + joint, total - left, total - right)]
    value = F.lit(0.0)
    for o, r, c in cells:
        value = value + _term(o, F.try_divide(r * c, total))
    flat = (left <= 0) | (right <= 0) | (left >= total) | (right >= total)
    return F.when(flat, F.lit(0.0)).otherwise(F.lit(2.0) * value)


def chi_squared_2x2(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """Yates-corrected statistic; 0 for degenerate margins."""
    joint, left, right, total = (c.cast("double") for c in (joint, left, right, total))
    b, c, d = left - joint, right - joint, total - left - right + joint
    under = left * right * (total - left) * (total - right)
    gap = F.greatest(F.lit(0.0), F.abs(joint * d - b * c) - total / 2)
    return F.when(under <= 0, F.lit(0.0)).otherwise(F.try_divide(total * gap * gap, under))


def pmi(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """log2 of the joint count over what independence gives; null for empty counts."""
    joint, left, right, total = (c.cast("double") for c in (joint, left, right, total))
    return F.when((joint > 0) & (left > 0) & (right > 0), F.log2(F.try_divide(joint * total, left * right)))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson interval, clamped to [0, 1]; (0, 1) where n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    mid = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)
    some = n > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0)).alias("low"), F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(1.0)).alias("high"))


def mulberry32(seed: int, k: Column) -> Column:
    """Draw number k (from 0) of the seeded 32-bit generator, in [0, 1): the state moves by a
    constant, so every draw is a function of its number and draws run in parallel."""
    full = 0xFFFFFFFF

    def times(a: Column, b: Column) -> Column:
        low = a.bitwiseAND(F.lit(0xFFFF)) * b
        high = F.shiftright(a, 16) * b
        return (low.bitwiseAND(F.lit(full)) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(full))

    # the product of a draw number and the step is reduced before it can overflow
    step = 0x6D2B79F5
    n = k.cast("long") + 1
    moved = (F.lit(seed & full).cast("long") + F.pmod(F.pmod(n, F.lit(1 << 32)).bitwiseAND(F.lit(0xFFFF)) * step, F.lit(1 << 32)) + F.shiftleft((F.shiftright(n.bitwiseAND(F.lit(full)), 16) * step).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(full))
    t = times(moved.bitwiseXOR(F.shiftright(moved, 15)), moved.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(full)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32))


def fold(text: Column) -> Column:
    """Search fold: lower case, final sigma as sigma."""
    return F.translate(F.lower(text), "ς", "σ")
