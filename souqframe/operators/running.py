"""Running sums over any number of rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], order: str, weight: str, out: str, bins: int = 16384, tie: list[str] | None = None) -> DataFrame:
    """Add ``out``: the weight of all rows of the same ``by`` group up to and with this row.

    ``order`` names a uniformly spread BIGINT (a hash), ``tie`` further columns that make the order
    total, so that a recomputed task gives the same sums. The order's range is cut into ``bins`` (a power of two) equal slices; slice totals (at most ``bins`` rows a
    group) are summed first and windows then stay within one slice, so no task holds a group.
    """
    binned = df.withColumn("_bin", F.shiftright(F.col(order), 65 - bins.bit_length()))
    totals = binned.groupBy(*by, "_bin").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bin").alias("_b__bin"), F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_before"))
    on = F.col("_bin") == F.col("_b__bin")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = binned.join(before, on).drop("_b__bin", *[f"_b_{c}" for c in by])
    inner = Window.partitionBy(*by, "_bin").orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(weight).over(inner)).drop("_bin", "_before")
