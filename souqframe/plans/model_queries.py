"""Contracts, encoders, models, clusterings and matching by similarity."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from souqframe.functions import fuzzy
from souqframe.functions.specs import cpu_key
from souqframe.ml import models
from souqframe.operators import contracts, vectors
from souqframe.operators.ranking import hash_order
from souqframe.plans.common import ADS, ads, r6
from souqframe.plans.split_queries import panel
from souqframe.session import Workspace, read_table

_A = f"WITH {ADS} "
NUMBERS, CATS = ["cpu_mark", "gpu_g3d_mark", "tdp", "cores", "screen", "SCREEN_RESOLUTION_ENC"], ["brand", "spec_Etat"]


def _rules():
    c = contracts
    return [c.in_range("price_corrected", 10_000, 1_000_000), c.required("price_corrected"), c.in_range("cores", 1, 128), c.in_range("SCREEN_SIZE_SNAPPED", 10, 20), c.in_range("SCREEN_RESOLUTION_ENC", 1, 9), c.required("brand"), c.one_of("spec_Etat", "MOYEN", "BON TAT", "JAMAIS UTILIS")]


def contract_violations(spark, sf):
    return contracts.check(ads(spark, sf), _rules())


def frequency_encoding(spark, sf):
    d = read_table(spark, sf, "listings").select("listing_id", "brand")
    return models.FrequencyEncoder("brand", "share").transform(d).select("listing_id", r6("share").alias("share"))


def target_encoding(spark, sf):
    d = ads(spark, sf).select("listing_id", "brand", "price")
    return models.target_encoding(d, "brand", "price", "code").groupBy("brand").agg(F.round(F.max("code"), 3).alias("code"))


def standard_scores(spark, sf):
    """Population standard scores of two marks, missing ones left out."""
    a = ads(spark, sf)
    s = a.agg(*[f(c).alias(f"{n}_{c}") for c in ("cpu_mark", "tdp") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return a.crossJoin(F.broadcast(s)).select("listing_id", *[r6((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in ("cpu_mark", "tdp")])


def robust_scores(spark, sf):
    a = ads(spark, sf)
    q = a.agg(F.percentile("cpu_mark", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return a.crossJoin(F.broadcast(q)).select("listing_id", r6((F.col("cpu_mark") - F.element_at("q", 2)) / (F.element_at("q", 3) - F.element_at("q", 1))).alias("cpu_mark"))


def ordered_quantiles(spark, sf):
    """Three interval ends put in order and widened to hold the point."""
    a = ads(spark, sf).where("price IS NOT NULL")
    e = F.sort_array(F.array(F.col("price") * (0.7 + F.col("listing_id") % 5 * 0.1), F.col("price") * 1.05, F.col("price") * (1.3 - F.col("listing_id") % 7 * 0.1)))
    return a.select("listing_id", F.round(F.least(F.element_at(e, 1), "price"), 4).alias("low"), F.round(F.element_at(e, 2), 4).alias("middle"), F.round(F.greatest(F.element_at(e, 3), "price"), 4).alias("high"))


def price_models(spark, sf):
    """Held-out metrics of each regressor on a hash split."""
    ws = Workspace(spark)
    a = models.fold_rare(ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price", *NUMBERS, *CATS).distinct(), CATS)
    d = ws.stage(a.withColumn("part", hash_order(F.col("listing_id"), F.lit(42)) % 5), "rows")
    out = None
    for kind in models.REGRESSORS:
        m = models.fit_regressor(d.where("part < 4"), kind, NUMBERS, CATS)
        r = models.predict(m, d.where("part = 4")).agg(*panel("price", "predicted")).withColumn("model", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return out


def price_contributions(spark, sf):
    """Per listing the three features that move a linear prediction most from the mean listing."""
    a = ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price", *NUMBERS).distinct()
    ws = Workspace(spark)
    d = ws.stage(a.na.fill(0.0, NUMBERS).withColumn("log_price", F.log1p("price")), "rows")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=NUMBERS, outputCol="features")
    m = LinearRegression(labelCol="log_price", regParam=0.01).fit(v.transform(d))
    means = d.agg(*[F.avg(c).alias(c) for c in NUMBERS]).first()
    parts = F.array(*[F.struct(((F.col(c) - F.lit(means[c])) * F.lit(float(w))).alias("by"), F.lit(c).alias("feature")) for c, w in zip(NUMBERS, m.coefficients, strict=True)])
    top = F.slice(F.array_sort(parts, lambda x, y: F.when(F.abs(x["by"]) > F.abs(y["by"]), -1).when(F.abs(x["by"]) < F.abs(y["by"]), 1).otherwise(0)), 1, 3)
    return d.select("listing_id", F.posexplode(top).alias("place", "p")).select("listing_id", "place", "p.feature", r6("p.by").alias("by"))


def _features(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


def _clustered(spark, sf, kind, components=None):
    return models.cluster(_features(spark, sf), kind, 10, components).select("vec_id", F.col("prediction").alias("cluster"))


def kmeans_clusters(spark, sf):
    return _clustered(spark, sf, "kmeans")


def bisecting_clusters(spark, sf):
    return _clustered(spark, sf, "bisecting")


def mixture_clusters(spark, sf):
    return models.cluster(_features(spark, sf), "gmm", 5, 4).select("vec_id", F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("probability"))


def label_centroids(spark, sf):
    c = vectors.centroids(read_table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.round(F.element_at("centroid", 1), 5).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 4).alias("sum"))


def nearest_centroid(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return vectors.nearest_centroid(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label").select("vec_id", "label", F.round("distance", 4).alias("distance"))


def partition_dispersion(spark, sf):
    return vectors.dispersion(read_table(spark, sf, "embeddings"), "label", "embedding").select(F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


def fuzzy_cpu_match(spark, sf):
    """Typed processors against the list by token-set similarity from 70."""
    t = read_table(spark, sf, "listings").where("CPU IS NOT NULL").select(cpu_key(F.col("CPU")).alias("typed")).distinct()
    r = read_table(spark, sf, "cpus").select(cpu_key(F.col("name")).alias("name")).distinct()
    return fuzzy.best_match(t, "typed", r, "name", 70.0)


QUERIES = {f.__name__: f for f in (contract_violations, frequency_encoding, target_encoding, standard_scores, robust_scores, ordered_quantiles, price_models, price_contributions, kmeans_clusters, bisecting_clusters, mixture_clusters, label_centroids, nearest_centroid, partition_dispersion, fuzzy_cpu_match)}
_CENT = "WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m, count(*) AS n FROM f GROUP BY 1, 2)"
_RULE_SQL = [("price_corrected", "between 10000 and 1e+06", "NOT price_corrected BETWEEN 10000 AND 1000000"), ("price_corrected", "present", "price_corrected IS NULL"), ("cores", "between 1 and 128", "NOT cores BETWEEN 1 AND 128"), ("SCREEN_SIZE_SNAPPED", "between 10 and 20", "NOT SCREEN_SIZE_SNAPPED BETWEEN 10 AND 20"), ("SCREEN_RESOLUTION_ENC", "between 1 and 9", "NOT SCREEN_RESOLUTION_ENC BETWEEN 1 AND 9"), ("brand", "present", "brand IS NULL"), ("spec_Etat", "one of MOYEN, BON TAT, JAMAIS UTILIS", "spec_Etat NOT IN ('MOYEN', 'BON TAT', 'JAMAIS UTILIS')")]
ORACLE = {
    "contract_violations": _A + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{n}' AS rule, count(*) FILTER ({b}) AS violations, count(*) AS rows FROM a" for c, n, b in _RULE_SQL),
    "frequency_encoding": "SELECT listing_id, round(count(*) OVER (PARTITION BY brand) / count(*) OVER (), 6) AS share FROM listings",
    "target_encoding": _A + ", m AS (SELECT avg(price) AS m FROM a) SELECT brand, round((sum(price) + 10 * any_value(m)) / (count(price) + 10), 3) AS code FROM a, m GROUP BY brand",
    "standard_scores": _A + " SELECT listing_id, round((cpu_mark - avg(cpu_mark) OVER ()) / stddev_pop(cpu_mark) OVER (), 6) AS cpu_mark, round((tdp - avg(tdp) OVER ()) / stddev_pop(tdp) OVER (), 6) AS tdp FROM a",
    "robust_scores": _A + ", q AS (SELECT quantile_cont(cpu_mark, 0.25) AS a1, quantile_cont(cpu_mark, 0.5) AS a2, quantile_cont(cpu_mark, 0.75) AS a3 FROM a) SELECT listing_id, round((cpu_mark - a2) / (a3 - a1), 6) AS cpu_mark FROM a, q",
    "ordered_quantiles": _A + ", s AS (SELECT listing_id, price, list_sort([price * (0.7 + listing_id % 5 * 0.1::DOUBLE), price * 1.05::DOUBLE, price * (1.3 - listing_id % 7 * 0.1::DOUBLE)]) AS e FROM a WHERE price IS NOT NULL) SELECT listing_id, round(least(e[1], price), 4) AS low, round(e[2], 4) AS middle, round(greatest(e[3], price), 4) AS high FROM s",
    "label_centroids": _CENT + " SELECT label, any_value(n) AS n, round(max(m) FILTER (p = 0), 5) AS first, round(sum(m), 4) AS sum FROM m GROUP BY 1",
    "nearest_centroid": _CENT + ", d AS (SELECT f.vec_id, m.label, sum(pow(f.x - m.m, 2)) AS d FROM f JOIN m USING (p) GROUP BY 1, 2) SELECT vec_id, arg_min(label, d) AS label, round(sqrt(min(d)), 4) AS distance FROM d GROUP BY 1",
    "partition_dispersion": _CENT + ", w AS (SELECT p, avg(x) AS m FROM f GROUP BY 1), v AS (SELECT f.vec_id, f.label, sum(pow(f.x - m.m, 2)) AS d2 FROM f JOIN m ON f.label = m.label AND f.p = m.p GROUP BY 1, 2), s AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM v GROUP BY 1), c AS (SELECT a.label AS i, b.label AS j, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM m a JOIN m b ON a.p = b.p AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT i, max((x.s + y.s) / d) AS r FROM c JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1), b AS (SELECT m.label, sum(pow(m.m - w.m, 2)) * any_value(m.n) AS b FROM m JOIN w USING (p) GROUP BY 1) SELECT round((SELECT avg(r) FROM r), 4) AS davies_bouldin, round(((SELECT sum(b) FROM b) / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(w) FROM s) / ((SELECT sum(n) FROM s) - (SELECT count(*) FROM s))), 4) AS calinski_harabasz",
}
