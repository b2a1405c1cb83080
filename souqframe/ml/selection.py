"""Choosing models, features and cluster numbers."""

from __future__ import annotations

from math import log1p

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souqframe.operators import clusters
from souqframe.session import Workspace


def grid_search(rows: DataFrame, features: list[str], label: str, penalties: list[float], mixes: list[float], folds: int = 3, seed: int = 17) -> list[tuple[float, float, float, bool]]:
    """``penalty, mix, rmse, best`` of every linear model of a grid, cross-validated."""
    model = LinearRegression(labelCol=label, featuresCol="features")
    grid = ParamGridBuilder().addGrid(model.regParam, penalties).addGrid(model.elasticNetParam, mixes).build()
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", label)
    cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=2)
    errors = cv.fit(data).avgMetrics
    low = min(errors)
    return [(float(p[model.regParam]), float(p[model.elasticNetParam]), float(e), bool(e == low)) for p, e in zip(grid, errors, strict=True)]


def backward_selection(rows: DataFrame, features: list[str], label: str, keep: int, part: str = "part") -> list[tuple[int, str, float]]:
    """``step, dropped, r2``: from all features down to ``keep``, each step drops the one whose loss costs the held-out share
    of explained variance least (``part`` = 0 is held out)."""
    left, out = list(features), []
    fit, held = rows.where(F.col(part) != 0), rows.where(F.col(part) == 0)

    def score(names: list[str]) -> float:
        v = VectorAssembler(inputCols=names, outputCol="features")
        model = LinearRegression(labelCol=label, featuresCol="features", regParam=0.001).fit(v.transform(fit))
        return model.evaluate(v.transform(held)).r2

    while len(left) > keep:
        r2, worst = max((score([f for f in left if f != g]), g) for g in left)
        left.remove(worst)
        out.append((len(out) + 1, worst, float(r2)))
    return out


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> float:
    """Agreement of two labelings of the same rows, from their contingency counts."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda n: n * (n - 1) / 2
    s = cells.agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("all")).first()
    one = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("s")).first().s
    x, y, every = one(a), one(b), two(s["all"])
    expected, most = x * y / max(every, 1), (x + y) / 2
    return 1.0 if most == expected else (s.both - expected) / (most - expected)


def _clustered(rows: DataFrame, id_column: str, vector: str, k: int, seed: int) -> DataFrame:
    data = rows.select(id_column, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(id_column, F.col("prediction").alias("cluster"))


def balanced_k(rows: DataFrame, id_column: str, vector: str, ks: list[int], seed: int = 17) -> list[tuple[int, float, float, float, bool]]:
    """``k, silhouette, imbalance, score, best``: the silhouette is divided by log(1 + largest / smallest cluster)."""
    found = []
    for k in ks:
        c = Workspace(rows.sparkSession).stage(rows.join(_clustered(rows, id_column, vector, k, seed), id_column), "clustered")
        sizes = [r["count"] for r in c.groupBy("cluster").count().collect()]
        s = clusters.silhouette(c, id_column, vector, "cluster") or 0.0
        found.append((k, s, max(sizes) / min(sizes), s / log1p(max(sizes) / min(sizes))))
    top = max((f[3] for f in found), default=0.0)
    return [(*f, bool(f[3] == top)) for f in found]


def stability(rows: DataFrame, id_column: str, vector: str, k: int, runs: int = 3, share: float = 0.8, seed: int = 17) -> list[tuple[int, float]]:
    """``run, agreement``: clusterings of random parts against that of all rows, on the rows they have in common."""
    whole = _clustered(rows, id_column, vector, k, seed).withColumnRenamed("cluster", "whole")
    out = []
    for r in range(runs):
        part = rows.where(F.pmod(F.xxhash64(F.lit(seed + r), id_column), F.lit(1000)) < int(share * 1000))
        out.append((r, adjusted_rand(_clustered(part, id_column, vector, k, seed + r).join(whole, id_column), "cluster", "whole")))
    return out
