"""Repairing the decimal scale of a number against the range it must lie in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 8


def rescaled(raw: Column, low: float, high: float, expected: Column | None = None, doubt: float = 8.0) -> Column:
    """``struct<value, method, ambiguous, exponent>``: ``raw`` times the power of ten that brings it into range.

    The nearest power that fits is taken; if an ``expected`` value is more than ``doubt`` times away from the outcome, the
    power that comes nearest to it is taken instead (round thousands first, then the lowest power) and marked ambiguous.
    """
    powers = F.array(*[F.lit(float(f"1e{k}")) for k in range(-STEPS, STEPS + 1)])
    at = lambda k: raw * F.element_at(powers, k + STEPS + 1)
    exponents = F.sequence(F.lit(-STEPS), F.lit(STEPS))
    usable = raw.isNotNull() & ~F.isnan(raw) & (raw > 0) & (raw < float("inf"))
    fits = F.filter(exponents, lambda k: at(k).between(low, high))
    greedy = (
        F.when(raw.between(low, high), F.lit(0))
        .when(raw > high, F.array_max(F.filter(fits, lambda k: k < 0)))
        .otherwise(F.array_min(F.filter(fits, lambda k: k > 0)))
    )
    none = F.struct(raw.alias("value"), F.lit("unresolved").alias("method"), F.lit(False).alias("ambiguous"), F.lit(0).alias("exponent"))
    plain = F.struct(at(greedy).alias("value"), F.when(greedy == 0, "unchanged").otherwise("price_only").alias("method"), F.lit(False).alias("ambiguous"), greedy.alias("exponent"))
    if expected is None:
        return F.when(~F.coalesce(usable, F.lit(False)) | greedy.isNull(), none).otherwise(plain)
    away = lambda k: F.abs(F.log10(at(k)) - F.log10(expected))
    rivals = F.filter(fits, lambda k: (k != greedy) & (away(k) < away(greedy)))
    round_ones = F.filter(rivals, lambda k: F.abs(at(k) / 1000 - F.round(at(k) / 1000)) < 1e-9)
    pool = F.when((F.size(rivals) > 1) & (F.size(round_ones) > 0), round_ones).otherwise(rivals)
    best = F.array_min(F.transform(pool, lambda k: F.struct(away(k).alias("d"), k.alias("k"))))["k"]
    switch = (expected > 0) & (away(greedy) > F.log10(F.lit(doubt))) & (F.size(rivals) > 0)
    chosen = F.struct(at(best).alias("value"), F.lit("component").alias("method"), F.lit(True).alias("ambiguous"), best.alias("exponent"))
    return F.when(~F.coalesce(usable, F.lit(False)) | greedy.isNull(), none).when(F.coalesce(switch, F.lit(False)), chosen).otherwise(plain)
