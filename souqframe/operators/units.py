"""Quantities recorded in different units: exact penalised changepoint search in the log values of each source's history.

1. *Levels.* Where a source's values usually lie, and how widely, is read off its own history: median and quartile distance
   of the logarithms, from counts per hundredth of a decade. The source's usual unit is the one whose factor explains most
   of the gap between its level and that of all sources.
2. *Changepoints.* A history in order of time is explained by a sequence of segments, each at one of the source's possible
   levels: the usual one shifted by the logarithm of a known factor. A value costs its squared distance from its segment's
   level, in spreads, and each change of level costs ``penalty``; a segment's unit must be one in which its values are
   possible (``low`` to ``high`` after conversion). The segmentation of least total cost is found exactly by dynamic programming.
3. *Reversal.* The factor of a value's segment turns it into the common unit.

Neighbouring values that put all units into the same order of cost are one run: some best segmentation changes only between
runs, so the dynamic programme steps over runs, not rows, and stays exact.

Equal numbers of one source at one instant are counted as one observation before anything is sorted. Histories are sorted over
the cluster by (series, time, value) into ranges of about ``chunk_rows`` observations, wherever the cuts fall: one instant
may be cut apart, so no source, and no bulk load of one instant, is one task. The least
cost from any unit before a chunk to any unit at its end is a small matrix; these matrices chain exactly, so the
chunks together give the optimum of the whole history.

Defined results: NULL, zero and negative values must be left out beforehand; ties go to the unit listed first; an empty table
gives an empty result; repeated rows count once; a value impossible under every unit keeps the unit of its segment. Level and
spread of a source are drawn to those of its kind as if by ``few`` more values. Before and after a history its usual unit holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souqframe.operators.text_classes import small
from souqframe.session import Workspace

IMPOSSIBLE = 1e6
#: Histories are never taken to be narrower than this, in decades.
LEAST_SPREAD = 0.15


@dataclass(frozen=True)
class Units:
    """``factors``: what one unit is in the common one, the common unit (1.0) first. ``low, high``: what a converted
    value can be."""

    names: tuple[str, ...]
    factors: tuple[float, ...]
    low: float
    high: float

    def costs(self, value: np.ndarray, level: float, spread: float) -> np.ndarray:
        common = value[:, None] * np.array(self.factors)[None, :]
        z = (np.log10(common) - level) / spread
        tolerance = 1e-9 * self.high
        bad = (common < self.low - tolerance) | (common > self.high + tolerance)
        return np.where(bad, IMPOSSIBLE, np.minimum(z * z, IMPOSSIBLE / 100))

    def usual(self, level: Column, overall: Column) -> Column:
        """The position of the unit a history is mostly in: another than the common one only if its factor explains more
        than half of its own length of the gap to the level of all."""
        shifts = [float(np.log10(f)) for f in self.factors]
        gains = [F.struct((F.abs(level - overall) - F.abs(level + s - overall) - abs(s) / 2).alias("gain"), F.lit(-i).alias("unit")) for i, s in enumerate(shifts)]
        return -F.array_max(F.array(*gains))["unit"]


def runs(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of rows with the same order of units by cost start, and each run's summed costs."""
    i, j = np.triu_indices(costs.shape[1], 1)
    order = np.sign(costs[:, i] - costs[:, j]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, (order[1:] != order[:-1]).any(1)]) if len(costs) else np.zeros(0, int)
    return starts, np.add.reduceat(costs, starts, axis=0) if len(costs) else costs


def entering(k: int, penalty: float, usual: int) -> np.ndarray:
    """What a segment of each unit costs: ``penalty``, and nothing in the usual unit."""
    return np.where(np.arange(k) == usual, 0.0, penalty)


def transfer(costs: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """``T[i, j]``: least cost of the rows when unit i held before them and unit j holds at their end."""
    k = costs.shape[1]
    t = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    for c in runs(costs)[1]:
        t = np.minimum(t, t.min(1, keepdims=True) + enter) + c
    return t


def best_path(costs: np.ndarray, enter: np.ndarray, entry: int | None = None, leave: int | None = None) -> np.ndarray:
    """The unit of each row on the cheapest path with the given units before and at the end (None: the ends of the history)."""
    k = costs.shape[1]
    starts, sums = runs(costs)
    n = len(sums)
    units = np.arange(k)
    f = enter.astype(float) if entry is None else np.where(units == entry, 0.0, np.inf)
    back = np.empty((n, k), dtype=np.int8)
    for r in range(n):
        a = int(f.argmin())
        change = f[a] + enter
        stay = f <= change
        back[r] = np.where(stay, units, a)
        f = np.where(stay, f, change) + sums[r]
    out = np.empty(n, dtype=np.int8)
    at = int(f.argmin()) if leave is None else leave
    for r in range(n - 1, -1, -1):
        out[r] = at
        at = back[r, at]
    return np.repeat(out, np.diff(np.r_[starts, len(costs)]))


def levels(cells: DataFrame, units: dict[int, Units], few: int = 30) -> DataFrame:
    """``series, kind, level, spread, usual INT`` of each series with values whose unit is not told; ``level`` is in the common unit.

    ``cells``: ``series, kind, value, told INT`` (the unit's position, NULL if none is told). Counts per series and hundredth of
    a decade are all that is kept of the values.
    """
    factor = F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.array(*[F.lit(f) for f in u.factors]), F.col("told") + 1)) for k, u in units.items()])
    bin_ = F.floor(F.log10(F.col("value") * F.when(F.col("told").isNull(), F.lit(1.0)).otherwise(factor)) * 100).cast("int")
    counts = cells.groupBy("series", "kind", F.col("told").isNull().alias("bare"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    middle = lambda: F.percentile("bin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    overall = counts.groupBy("kind").agg(middle().alias("all"))
    own = counts.where("bare").groupBy("series", "kind").agg(middle().alias("own"), F.sum("n").alias("n"))
    width = lambda q: F.greatest(F.least(F.element_at(q, 2) - F.element_at(q, 1), F.element_at(q, 3) - F.element_at(q, 2)) / (0.6745 * 100), F.lit(LEAST_SPREAD))
    j = own.join(F.broadcast(overall), "kind").withColumns({"raw": F.element_at("own", 2) / 100 + 0.005, "usual_of_all": F.element_at("all", 2) / 100 + 0.005})
    j = j.withColumn("usual", F.coalesce(*[F.when(F.col("kind") == k, u.usual(F.col("raw"), F.col("usual_of_all"))) for k, u in units.items()]))
    shift = F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.array(*[F.lit(float(np.log10(f))) for f in u.factors]), F.col("usual") + 1)) for k, u in units.items()])
    mixed = lambda x, y: (F.col("n") * x + F.lit(few) * y) / (F.col("n") + F.lit(few))
    return j.select("series", "kind", mixed(F.col("raw") + shift, F.col("usual_of_all")).alias("level"), mixed(width("own"), width("all")).alias("spread"), F.col("usual").cast("int").alias("usual"))


def segment(cells: DataFrame, units: dict[int, Units], penalty: float = 24.0, chunk_rows: int = 200_000, few: int = 30) -> DataFrame:
    """``series STRING, kind INT, at BIGINT, value DOUBLE, told INT`` -> ``series, kind, at, value, unit INT, chunk INT, seg INT,
    island INT`` for every observation whose unit is not told: equal numbers of one source at one instant (a bulk load) are one.

    ``kind`` picks the units and is the same throughout a series. ``seg`` numbers the segments of a chunk, ``island`` its stretches
    of common and of other units. A cell that tells its unit shapes the levels only: an ad that names its unit says
    nothing about the bare numbers next to it.
    """
    ws = Workspace(cells.sparkSession)
    order = ["series", "at", "value"]
    plain, n = ws.stage_counted(cells.where("told IS NULL").groupBy(*order, "kind").agg(F.count("*").alias("cells")), "observations")
    known = ws.stage(levels(cells, units, few), "levels")
    ranged = plain.repartitionByRange(max(-(-n // chunk_rows), 1), *order)
    cut = ws.stage(ranged.withColumn("chunk", F.spark_partition_id()), "chunks").join(small(known.select("series", "level", "spread", "usual"), "series"), "series")
    assert max((len(u.names) for u in units.values()), default=1) < 127

    def ordered(d: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        d = d.sort_values(order[1:], kind="stable")
        return d, units[int(d["kind"].iloc[0])].costs(d["value"].to_numpy(), float(d["level"].iloc[0]), float(d["spread"].iloc[0]))

    def matrices(d: pd.DataFrame) -> pd.DataFrame:
        _, costs = ordered(d)
        enter = entering(costs.shape[1], penalty, int(d["usual"].iloc[0]))
        return pd.DataFrame({"series": [d["series"].iloc[0]], "chunk": [d["chunk"].iloc[0]], "usual": [d["usual"].iloc[0]], "t": [transfer(costs, enter).ravel().tolist()]})

    def chain(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("chunk")
        k = int(round(len(d["t"].iloc[0]) ** 0.5))
        f, came = entering(k, penalty, int(d["usual"].iloc[0])), []
        for t in d["t"]:
            step = f[:, None] + np.array(t).reshape(k, k)
            came.append(step.argmin(0))
            f = step.min(0)
        at, ends = int(f.argmin()), []
        for c in reversed(came):
            ends.append((int(c[at]), at))
            at = int(c[at])
        ends.reverse()
        befores, afters = [e for e, _ in ends], [x for _, x in ends]
        # the ends of the whole history stay free, at the cost the chain has counted
        return pd.DataFrame({"series": d["series"], "chunk": d["chunk"], "entry": [None, *befores[1:]], "leave": [*afters[:-1], None]})

    several = cut.groupBy("series").agg(F.min("chunk").alias("low"), F.max("chunk").alias("top")).where("top > low").select("series")
    several = ws.stage(several, "long-series")
    if several.isEmpty():
        bounded = cut.withColumn("entry", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int"))
    else:
        t = cut.join(several, "series", "left_semi").groupBy("series", "chunk").applyInPandas(matrices, "series string, chunk int, usual int, t array<double>")
        ends = ws.stage(t.groupBy("series").applyInPandas(chain, "series string, chunk int, entry int, leave int"), "ends")
        bounded = cut.join(ends, ["series", "chunk"], "left")

    def walk(d: pd.DataFrame) -> pd.DataFrame:
        d, costs = ordered(d)
        entry, leave = d["entry"].iloc[0], d["leave"].iloc[0]
        unit = best_path(costs, entering(costs.shape[1], penalty, int(d["usual"].iloc[0])), None if pd.isna(entry) else int(entry), None if pd.isna(leave) else int(leave))
        number = lambda x: np.cumsum(np.r_[0, x[1:] != x[:-1]])
        return d.assign(unit=unit, seg=number(unit), island=number(unit > 0))[["series", "kind", "at", "value", "cells", "unit", "chunk", "seg", "island"]]

    return bounded.groupBy("series", "chunk").applyInPandas(walk, "series string, kind int, at bigint, value double, cells bigint, unit int, chunk int, seg int, island int")


def stretches(told: DataFrame, number: str = "seg") -> DataFrame:
    """``series, kind, unit, from_at, to_at, cells`` of all segments (``seg``), or of all stretches of foreign units (``island``).

    Only the first and last stretch of each chunk meet in a window, to be joined with their neighbours across the cut.
    """
    same = "unit" if number == "seg" else "foreign"
    per = told.withColumn("foreign", (F.col("unit") > 0).cast("int")).groupBy("series", "kind", "chunk", F.col(number).alias("k"), F.col(same).alias("same")).agg(F.min("at").alias("from_at"), F.max("at").alias("to_at"), F.sum("cells").alias("cells"))
    per = Workspace(told.sparkSession).stage(per, "stretches")
    top = per.groupBy("series", "chunk").agg(F.max("k").alias("top"))
    marked = per.join(top, ["series", "chunk"])
    w = Window.partitionBy("series").orderBy("chunk", "k")
    goes_on = (F.col("k") == 0) & (F.lag("chunk").over(w) < F.col("chunk")) & (F.lag("same").over(w) == F.col("same"))
    edge = marked.where("k = 0 OR k = top").withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    edge = edge.withColumn("joint", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy("series", "kind", "same", "joint").agg(F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"), F.sum("cells").alias("cells")).drop("joint")
    inner = marked.where("k > 0 AND k < top").select(*joined.columns)
    return inner.unionByName(joined).withColumnRenamed("same", same)
