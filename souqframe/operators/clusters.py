"""Silhouettes, density clustering, consensus of labelings. The latter two refuse large tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.operators.outliers import _distances, _vectors, block_pairs


def silhouette(df: DataFrame, id_column: str, vector: str, label: str) -> float | None:
    """The mean Euclidean silhouette; NULL with fewer than two labels. Blocks of rows meet blocks of rows on the executors and
    leave one sum per row and label."""
    v = df.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("l"))
    sizes = v.groupBy("l").agg(F.count("*").alias("size"))
    if sizes.limit(2).count() < 2:
        return None

    def add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "own": [], "l": [], "s": []})
        names, at = np.unique(b["l"].to_numpy(dtype=str), return_inverse=True)
        sums = _distances(_vectors(a, "v"), _vectors(b, "v")) @ np.eye(len(names))[at]
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(names)), "own": np.repeat(a["l"].to_numpy(), len(names)), "l": np.tile(names, len(a)), "s": sums.ravel()})

    sums = block_pairs(v, v, add, f"id {v.schema['id'].dataType.simpleString()}, own string, l string, s double").groupBy("id", "own", "l").agg(F.sum("s").alias("s"))
    means = sums.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "l")
    own = F.col("own") == F.col("l")
    per = means.groupBy("id").agg(F.max(F.when(own, F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.max(F.when(own, F.col("size"))).alias("n"), F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"))
    value = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))).otherwise(0.0)
    return per.agg(F.avg(value).alias("s")).first().s


#: Density clustering and consensus are done on the driver and refuse more rows.
MAX_ROWS = 20_000


def _matrix(df: DataFrame, id_column: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(id_column, vector).where(F.col(vector).isNotNull()).limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    rows = rows.sort_values(id_column)
    return rows[id_column].to_numpy(), np.array(rows[vector].tolist(), dtype=float).reshape(len(rows), -1)


def dbscan(df: DataFrame, id_column: str, vector: str, eps: float, least: int) -> DataFrame:
    """``id, cluster``: -1 is noise; clusters are numbered by their smallest id; a border row goes to the core of smallest id."""
    ids, x = _matrix(df, id_column, vector)
    n = len(ids)
    near = [np.flatnonzero(row) for s in range(0, n, 2048) for row in _distances(x[s : s + 2048], x) <= eps]
    core = np.array([len(r) >= least for r in near], dtype=bool)
    out, found = np.full(n, -1), 0
    for i in range(n):
        if not core[i] or out[i] >= 0:
            continue
        out[i], stack = found, [i]
        while stack:
            for j in near[stack.pop()]:
                if core[j] and out[j] < 0:
                    out[j] = found
                    stack.append(int(j))
        found += 1
    for i in range(n):
        if not core[i]:
            cores = [j for j in near[i] if core[j]]
            out[i] = out[cores[0]] if cores else -1
    return df.sparkSession.createDataFrame(pd.DataFrame({id_column: ids, "cluster": out}))


def consensus(labels: DataFrame, id_column: str, runs: list[str], k: int) -> DataFrame:
    """``id, cluster``: average linkage on how often two rows share a label over the runs, cut at ``k`` clusters.

    Rows with the same labels in every run are one point from the start, so only distinct combinations pair up."""
    combos = labels.groupBy(*runs).agg(F.count("*").alias("n"), F.min(id_column).alias("_first")).orderBy("_first").limit(2001).toPandas()
    if len(combos) > 2000:
        raise ValueError("more than 2000 different combinations of labels")
    lab, w = combos[runs].to_numpy(), combos["n"].to_numpy(dtype=float)
    d = 1 - (lab[:, None, :] == lab[None, :, :]).mean(2)
    groups = {i: [i] for i in range(len(combos))}
    weight = dict(enumerate(w))
    np.fill_diagonal(d, np.inf)
    alive = list(range(len(combos)))
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = alive[min(i, j)], alive[max(i, j)]
        merged = (weight[a] * d[a] + weight[b] * d[b]) / (weight[a] + weight[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        weight[a] += weight[b]
        groups[a] += groups.pop(b)
        alive.remove(b)
    combos["cluster"] = -1
    for c, a in enumerate(sorted(groups, key=lambda g: combos["_first"].iloc[groups[g]].min())):
        combos.loc[groups[a], "cluster"] = c
    small = labels.sparkSession.createDataFrame(combos[[*runs, "cluster"]])
    return labels.join(F.broadcast(small), runs).select(id_column, "cluster")
