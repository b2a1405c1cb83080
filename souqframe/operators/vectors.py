"""Centroids and partition quality over array columns, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centroids are broadcast; more than this many are an error.
MAX_CENTROIDS = 10_000


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, centroid, n``: one sum per label and position, combined before the shuffle."""
    flat = df.where(F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x"))
    per = flat.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def _checked(c: DataFrame) -> DataFrame:
    if c.limit(MAX_CENTROIDS + 1).count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    return F.broadcast(c)


def nearest_centroid(df: DataFrame, id_column: str, vector: str, cents: DataFrame, label: str) -> DataFrame:
    """``id, label, distance``: all centroids travel as one broadcast row."""
    packed = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_all"))
    _checked(cents)
    each = F.transform("_all", lambda s: F.struct(squared_distance(F.col(vector), s["c"]).alias("d"), s["l"].alias("l")))
    best = F.array_min(each)
    return df.crossJoin(F.broadcast(packed)).select(id_column, best.alias("b")).select(id_column, F.col("b.l").alias(label), F.sqrt("b.d").alias("distance"))


def dispersion(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``davies_bouldin, calinski_harabasz`` of a labelling with at least two labels."""
    cents = centroids(df, label, vector)
    whole = centroids(df.withColumn("_all", F.lit(0)), "_all", vector).select(F.col("centroid").alias("whole"))
    j = df.join(_checked(cents.select(label, "centroid", "n")), label).select(label, "n", "centroid", squared_distance(F.col(vector), F.col("centroid")).alias("d2"))
    per = j.groupBy(label).agg(F.first("n").alias("n"), F.first("centroid").alias("c"), F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    packed = per.agg(F.collect_list(F.struct(label, "c", "s")).alias("_all"))
    worst = F.array_max(F.transform(F.filter("_all", lambda o: o[label] != F.col(label)), lambda o: (F.col("s") + o["s"]) / F.sqrt(squared_distance(F.col("c"), o["c"]))))
    out = per.crossJoin(F.broadcast(packed)).crossJoin(F.broadcast(whole)).select("n", "w", worst.alias("r"), (F.col("n") * squared_distance(F.col("c"), F.col("whole"))).alias("b"))
    k, n = F.count("*"), F.sum("n")
    return out.agg(F.avg("r").alias("davies_bouldin"), ((F.sum("b") / (k - 1)) / (F.sum("w") / (n - k))).alias("calinski_harabasz"))
