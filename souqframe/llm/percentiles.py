"""Percentiles per group by distributed multi-select over mergeable summaries.

A summary has ``grp..., value, n``: the count of each distinct value (exact), or of each logarithmic bin
if ``relative_error`` is given; summaries of days, files or partitions combine by adding up.
The selection then works on any number of summary rows: partitions propose the weighted median of
their candidates for each wanted rank, the weighted median of the proposals becomes the pivot, one
pass counts below / at / above it, ranges that cannot hold the rank are discarded, and this repeats
until every rank of every group is found.

The percentile q of n values is the value of rank ceil(q n), at least 1 (an element of the data, no interpolation).
Error: none without ``relative_error``; with it, at most that share of the true value.
Defined results: NULL and NaN values are left out; a group without values gives no row; a NULL group is a
group of its own; infinities are values, the smallest and largest; with ``relative_error`` values of either
sign are binned by magnitude and zero is exact. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souqframe.session import Workspace


def summarise(df: DataFrame, by: list[str], value: str, relative_error: float | None = None) -> DataFrame:
    """``by..., value, n``; summaries of separate inputs combine with :func:`merge`."""
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("value"))
    if relative_error is not None:
        step = math.log((1 + relative_error) / (1 - relative_error))
        # the representative of a bin is within relative_error of both of its ends
        size = F.exp(F.floor(F.log(F.abs("value")) / step) * step) * (1 + relative_error)
        finite = F.abs(F.col("value")) < F.lit(float("inf"))
        kept = kept.withColumn("value", F.when((F.col("value") == 0) | ~finite, F.col("value")).otherwise(F.signum("value") * size))
    return kept.groupBy(*by, "value").agg(F.count("*").alias("n"))


def merge(summaries: DataFrame, by: list[str]) -> DataFrame:
    return summaries.groupBy(*by, "value").agg(F.sum("n").alias("n"))


def _proposals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted median of each batch's candidates for each target, so no task holds more than a batch: the weighted median
    of batch medians has at least a quarter of the candidates on either side, whatever the batches."""
    for d in batches:
        if not len(d):
            continue
        d = d.sort_values(["target", "value"], kind="stable")
        target, n = d["target"].to_numpy(), d["n"].to_numpy()
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        ends = np.r_[starts[1:], len(d)]
        upto = np.cumsum(n)
        base = np.r_[0, upto][starts]
        total = upto[ends - 1] - base
        at = np.searchsorted(upto, base + (total + 1) // 2)
        yield pd.DataFrame({"target": target[starts], "value": d["value"].to_numpy()[at], "n": total})


def multi_select(summary: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """``by..., quantile, value, rank, n_values`` from a summary with distinct ``by, value``.

    Groups get integers first, so any type of group column and NULL groups work alike. Per round, what moves
    is one row per partition and target; candidates move only if there are too many targets to broadcast.
    """
    ws = Workspace(summary.sparkSession)
    totals = summary.groupBy(*by).agg(F.sum("n").alias("n_values"))
    groups = ws.stage(totals.withColumn("gid", F.monotonically_increasing_id()), "groups")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    data = ws.stage(summary.alias("s").join(groups.alias("g"), on).select("g.gid", "s.value", "s.n"), "values")
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(x)).alias("quantile")) for i, x in enumerate(quantiles)]))
    targets = groups.select("gid", "n_values", q.alias("q")).select("gid", "q.qi", "q.quantile", "n_values", F.greatest(F.ceil(F.col("q.quantile") * F.col("n_values")), F.lit(1)).cast("bigint").alias("rank"))
    active, wanted = ws.stage_counted(targets.select((F.col("gid") * len(quantiles) + F.col("qi")).alias("target"), "gid", "rank", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("rank").alias("rest")), "targets")
    found: list[DataFrame] = []
    rounds = 0
    while wanted:
        cand = data.join(active, "gid").where((F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))
        medians = cand.select("target", "value", "n").mapInPandas(_proposals, "target bigint, value double, n bigint")
        w = Window.partitionBy("target").orderBy("value")
        pivots = (
            medians.groupBy("target", "value").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
            .withColumn("all", F.sum("n").over(Window.partitionBy("target")))
            .where("upto * 2 >= all").groupBy("target").agg(F.min("value").alias("pivot"))
        )
        pivots = ws.stage(active.join(pivots, "target"), f"pivots{rounds}")
        inside = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi")))
        counted = data.join(pivots, "gid").where(inside).groupBy("target", "gid", "rank", "lo", "hi", "rest", "pivot").agg(
            F.sum(F.when(F.col("value") < F.col("pivot"), F.col("n")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("value") == F.col("pivot"), F.col("n")).otherwise(0)).alias("at"),
        )
        counted = ws.stage(counted, f"counts{rounds}")
        found.append(counted.where("rest > below AND rest <= below + at").select("target", F.col("pivot").alias("value")))
        following = counted.where("rest <= below OR rest > below + at").select(
            "target", "gid", "rank",
            F.when(F.col("rest") <= F.col("below"), F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(F.col("rest") <= F.col("below"), F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("rest") <= F.col("below"), F.col("rest")).otherwise(F.col("rest") - F.col("below") - F.col("at")).alias("rest"),
        )
        following, wanted = ws.stage_counted(following, f"targets{rounds}")
        ws.drop(active, pivots)
        active = following
        rounds += 1
    answers = found[0] if found else active.select("target", F.lit(None).cast("double").alias("value"))
    for f in found[1:]:
        answers = answers.unionByName(f)
    asked = targets.withColumn("target", F.col("gid") * len(quantiles) + F.col("qi"))
    return asked.join(answers, "target").join(groups.select("gid", *by), "gid").select(*by, "quantile", "value", "rank", "n_values")
