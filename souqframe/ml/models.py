"""Model pipelines over prepared features: regressors on log price, clusterings, encoders."""

from __future__ import annotations

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predictions are held to the range of plausible values, on the log scale.
LOW, HIGH = 10_000.0, 1_000_000.0


def fold_rare(df: DataFrame, columns: list[str], at_least: int = 20, other: str = "OTHER") -> DataFrame:
    """Rare and missing levels become one; the frequent ones are joined back, never windowed."""
    for c in columns:
        often = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select(F.col(c).alias("_level"))
        df = df.join(often, F.col(c) == F.col("_level"), "left").withColumn(c, F.coalesce("_level", F.lit(other))).drop("_level")
    return df


def preparation(numbers: list[str], cats: list[str], scale: bool) -> list:
    """Missing indicators are columns of ``numbers`` the caller adds; medians fill, categories become one-hot."""
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_f" for c in numbers])]
    stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}_i" for c in cats], handleInvalid="keep", stringOrderType="frequencyDesc"))
    stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_h" for c in cats], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*[f"{c}_f" for c in numbers], *[f"{c}_h" for c in cats]], outputCol="raw_features" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=False))
    return stages


REGRESSORS = {
    "ridge": lambda: LinearRegression(labelCol="log_price", regParam=0.01, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(labelCol="log_price", regParam=0.001, elasticNetParam=1.0),
    "elastic": lambda: LinearRegression(labelCol="log_price", regParam=0.001, elasticNetParam=0.5),
    "forest": lambda: RandomForestRegressor(labelCol="log_price", numTrees=30, maxDepth=10, seed=17, minInstancesPerNode=5),
    "boosting": lambda: GBTRegressor(labelCol="log_price", maxIter=30, maxDepth=5, stepSize=0.1, seed=17),
}


def fit_regressor(train: DataFrame, kind: str, numbers: list[str], cats: list[str]):
    data = train.withColumn("log_price", F.log1p("price"))
    return Pipeline(stages=[*preparation(numbers, cats, kind in ("ridge", "lasso", "elastic")), REGRESSORS[kind]()]).fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    """``predicted`` on the original scale, inside the plausible range."""
    out = model.transform(df)
    clipped = F.greatest(F.least("prediction", F.log1p(F.lit(HIGH))), F.log1p(F.lit(LOW)))
    return out.withColumn("predicted", F.expm1(clipped))


CLUSTERINGS = {
    "kmeans": lambda k: KMeans(k=k, seed=17, featuresCol="features"),
    "bisecting": lambda k: BisectingKMeans(k=k, seed=17, featuresCol="features"),
    "gmm": lambda k: GaussianMixture(k=k, seed=17, featuresCol="features", maxIter=20),
}


def cluster(df: DataFrame, kind: str, k: int, components: int | None = None) -> DataFrame:
    """``features`` (vector) clustered, after a projection to ``components`` if given."""
    if components:
        df = PCA(k=components, inputCol="features", outputCol="projected").fit(df).transform(df).drop("features").withColumnRenamed("projected", "features")
    return CLUSTERINGS[kind](k).fit(df).transform(df)


class FrequencyEncoder(Transformer, HasInputCol, HasOutputCol):
    """The share of rows with the same value."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        c, o = self.getInputCol(), self.getOutputCol()
        n = df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        share = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_t")))).select("_v", (F.col("_n") / F.col("_t")).alias(o))
        return df.join(share, df[c].eqNullSafe(F.col("_v")), "left").drop("_v")


def target_encoding(df: DataFrame, column: str, target: str, out: str, smoothing: float = 10.0) -> DataFrame:
    """(sum + smoothing * overall mean) / (count + smoothing) per level."""
    per = df.where(F.col(target).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.sum(target).alias("_s"), F.count("*").alias("_n"))
    mean = df.agg(F.avg(target).alias("_m"))
    code = per.crossJoin(F.broadcast(mean)).select("_v", ((F.col("_s") + smoothing * F.col("_m")) / (F.col("_n") + smoothing)).alias(out))
    return df.join(code, df[column].eqNullSafe(F.col("_v")), "left").drop("_v")
