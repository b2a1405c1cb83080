"""Ranks, empirical distribution functions and quantile bins over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqframe.operators.running import running_sum


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def slice_of(df: DataFrame, value: str, slices: int = 256) -> Column:
    """The number of the slice a value lies in, between approximate quantiles of the column: found by halving, not one by one."""
    edges = sorted(set(df.approxQuantile(value, [i / slices for i in range(1, slices)], 0.25 / slices)))

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(value) <= F.lit(edges[mid]), halved(low, mid)).otherwise(halved(mid + 1, high))

    return halved(0, len(edges))


def cumulative_counts(df: DataFrame, by: list[str], value: str, slices: int = 256) -> DataFrame:
    """``by, value, n, upto, total``: rows at most as large as each distinct value.

    Distinct values are cut into ``slices`` ranges by approximate quantiles; totals per range are
    summed first, so windows stay within a range. The cut does not affect the result.
    """
    counts = value_counts(df, by, value)
    sliced = counts.withColumn("_slice", slice_of(counts, value, slices))
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("n").alias("_w"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = totals.select(*by, "_slice", F.coalesce(F.sum("_w").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_w").over(w).alias("total"))
    inner = Window.partitionBy(*by, "_slice").orderBy(value)
    return sliced.join(F.broadcast(before) if not by else before, [*by, "_slice"]).select(*by, value, "n", (F.col("_before") + F.sum("n").over(inner)).alias("upto"), "total")


def weighted_quantile(counts: DataFrame, by: list[str], value: str, n: str, q: float, out: str, slices: int = 64) -> DataFrame:
    """``by, out``: the least value up to which a share ``q`` of the weight ``n`` lies. ``counts`` has a row per distinct
    ``by, value``. Slices of the value range are added up first; only values of the slice that holds a group's answer are
    put in order, so no task sorts a group."""
    sliced = counts.withColumn("_slice", slice_of(counts, value, slices))
    totals = sliced.groupBy(*by, "_slice").agg(F.sum(n).alias("_w"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most ``slices`` rows a group
    upto = F.sum("_w").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    marked = totals.select(*by, "_slice", (upto - F.col("_w")).alias("_before"), upto.alias("_upto"), F.sum("_w").over(w).alias("_all"))
    holds = marked.where((F.col("_before") < F.col("_all") * q) & (F.col("_upto") >= F.col("_all") * q)).drop("_upto")
    inner = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = sliced.join(holds, [*by, "_slice"]).withColumn("_at", F.col("_before") + F.sum(n).over(inner)).where(F.col("_at") >= F.col("_all") * q)
    return near.groupBy(*by).agg(F.min(value).alias(out)) if by else near.agg(F.min(value).alias(out))


def hash_order(*parts: Column) -> Column:
    """A repeatable random order any engine can compute: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def hash_ranks(df: DataFrame, by: list[str], id_column: str, seed: int, out: str = "rank") -> DataFrame:
    """The position of each row of a group in hash order, from 1."""
    ordered = df.withColumn("_order", hash_order(F.col(id_column), F.lit(seed))).withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ordered, by, "_order", "_one", out, tie=[id_column]).drop("_order", "_one")


def quantile_bins(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """Bins with exact quantile edges, right-closed, the least value in the first; repeated edges merge."""
    grid = [i / bins for i in range(bins + 1)]
    edges = df.agg(F.percentile(value, F.array(*[F.lit(g) for g in grid])).alias("e")).select(F.array_distinct("e").alias("_edges"))
    inside = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(inside - 1, F.lit(0)))).drop("_edges")
