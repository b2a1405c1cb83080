"""Filling fixed-capacity containers: best fit decreasing, planned over the histogram of lengths.

Only the count of items of each length reaches the planner; there are at most ``capacity`` lengths, however
many documents. The plan is a list of slot ranges ("items of this length with these ranks go to these
containers, so many each"), and documents take their slots by a join on their rank within their
length. It equals item-by-item best fit decreasing.

A document longer than the capacity fills ``n // capacity`` containers of its own and its rest is an item like
any other; nothing else is split. Defined results: empty documents (0 tokens) are spread over the containers; NULL
sizes count as 0; an empty table gives an empty result; ids must be unique, a repeated id is packed as often
as it occurs.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.operators.running import running_sum
from souqframe.session import Workspace

PLAN = "pack_name string, length bigint, first_rank bigint, last_rank bigint, first_container bigint, each bigint"


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``length -> count`` (1..capacity) -> slot ranges (length, first rank, last rank, first container, items
    per container) and the number of containers. Ranks start at 1, containers at 0."""
    plan: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # residual capacity -> ranges (first container, containers)
    residuals: list[int] = []
    opened = 0

    def keep(residual: int, first: int, containers: int) -> None:
        if residual > 0 and containers > 0:
            if residual not in free:
                free[residual] = []
                insort(residuals, residual)
            free[residual].append((first, containers))

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        left, rank = histogram[length], 1
        while left > 0:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, containers = free[residual].pop()
                if not free[residual]:
                    del free[residual]
                    residuals.pop(at)
            else:
                residual, first = capacity, opened
                containers = -(-left // (capacity // length))
                opened += containers
            each = residual // length
            full = min(containers, left // each)
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each))
                rank, left = rank + full * each, left - full * each
                keep(residual - each * length, first, full)
                first, containers = first + full, containers - full
            if left and containers:  # fewer items left than one container takes
                plan.append((length, rank, rank + left - 1, first, left))
                keep(residual - left * length, first, 1)
                first, containers, left = first + 1, containers - 1, 0
            keep(residual, first, containers)
    return plan, opened


def pack(sizes: DataFrame, packs: dict[str, int], id_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """``pack_name, container_id, <id>, piece_no, piece_tokens`` for every pack size."""
    spark = sizes.sparkSession
    ws = Workspace(spark)
    size = F.greatest(F.coalesce(F.col(size_column).cast("bigint"), F.lit(0)), F.lit(0))
    base = sizes.select(F.col(id_column).alias("_id"), size.alias("_n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_name"), F.lit(int(c)).cast("bigint").alias("capacity")) for p, c in packs.items()]))
    items = base.select("_id", "_n", kinds.alias("k")).select("_id", "_n", "k.*")
    full = F.when(F.col("_n") > F.col("capacity"), F.floor(F.col("_n") / F.col("capacity"))).otherwise(0).cast("bigint")
    items = items.withColumn("_full", full).withColumn("length", F.col("_n") - F.col("_full") * F.col("capacity"))
    order = F.xxhash64("_id")
    ranked = running_sum(items.where("length > 0 OR _full = 0").withColumn("_order", order).withColumn("_one", F.lit(1).cast("bigint")), ["pack_name", "length"], "_order", "_one", "rank", tie=["_id"])
    ranked = ws.stage(ranked.select("pack_name", "_id", "length", "_full", "rank"), "ranked")
    counts: dict[str, dict[int, int]] = {p: {} for p in packs}
    for r in ranked.groupBy("pack_name", "length").agg(F.count("*").alias("n")).collect():
        counts[r.pack_name][r.length] = r.n
    rows, used = [], {}
    for p, c in packs.items():
        plan, used[p] = best_fit_plan(counts[p], int(c))
        rows += [(p, *r) for r in plan]
        if none := counts[p].get(0):
            rows.append((p, 0, 1, none, 0, -(-none // max(used[p], 1))))
    plan = spark.createDataFrame(rows, PLAN)
    placed = ranked.join(F.broadcast(plan), ["pack_name", "length"]).where(F.col("rank").between(F.col("first_rank"), F.col("last_rank"))).select(
        "pack_name",
        (F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))).cast("bigint").alias("container_id"),
        F.col("_id").alias(id_column),
        F.col("_full").alias("piece_no"),
        F.col("length").alias("piece_tokens"),
    )
    shift = F.coalesce(*[F.when(F.col("pack_name") == p, F.lit(n)) for p, n in used.items()]).cast("bigint")
    # whole containers of documents beyond the capacity come after the planned ones
    long = running_sum(items.where("_full > 0").withColumn("_order", order), ["pack_name"], "_order", "_full", "_upto", tie=["_id"])
    own = long.select("pack_name", "_id", "capacity", "_full", "_upto", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece_no")).select(
        "pack_name",
        (shift + F.col("_upto") - F.col("_full") + F.col("piece_no")).alias("container_id"),
        F.col("_id").alias(id_column),
        "piece_no",
        F.col("capacity").alias("piece_tokens"),
    )
    return placed.unionByName(own)


def fill_report(packed: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Per pack size: containers, tokens, unused share, and the least number of containers that could do."""
    per = packed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("piece_tokens").alias("tokens"))
    cap = F.coalesce(*[F.when(F.col("pack_name") == p, F.lit(c)) for p, c in packs.items()]).cast("bigint")
    return per.select("pack_name", cap.alias("capacity_tokens"), "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * cap)).alias("unused_share"), F.ceil(F.col("tokens") / cap).alias("least_containers"))
