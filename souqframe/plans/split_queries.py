"""Samples and splits in a repeatable hash order, and metrics of predictions and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe.operators.ranking import hash_order, hash_ranks, quantile_bins
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import read_table

SEED = 42
_A = f"WITH {ADS} "
_P = ", p AS (SELECT DISTINCT listing_id, price, brand, spec_signature, posted FROM a WHERE price IS NOT NULL)"
_H = "CAST(('0x' || substr(md5(concat_ws('|', {}, 42)), 1, 15)) AS BIGINT)"


def _priced(spark, sf):
    return ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price", "brand", "spec_signature", "posted").distinct()


def stratified_split(spark, sf):
    """60/20/20 within ten bins of log price."""
    b = quantile_bins(_priced(spark, sf).withColumn("log_price", F.log1p("price")), "log_price", 10, "bin").select("listing_id", "bin")
    sizes = b.groupBy("bin").agg(F.count("*").alias("n"))
    r = hash_ranks(b, ["bin"], "listing_id", SEED).join(F.broadcast(sizes), "bin")
    return r.select("listing_id", F.when(F.col("rank") <= F.floor(F.col("n") * 0.6), "train").when(F.col("rank") <= F.floor(F.col("n") * 0.8), "val").otherwise("test").alias("split"))


def grouped_split_leak(spark, sf):
    """A split by signature: rows per part, and signatures that stand in two parts (none)."""
    x = _priced(spark, sf).where("spec_signature IS NOT NULL")
    u = hash_order(F.col("spec_signature"), F.lit(SEED)) / F.lit(float(1 << 60))
    part = F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")
    s = x.select("spec_signature", part.alias("split"))
    leaks = s.distinct().groupBy("spec_signature").agg(F.count("*").alias("k")).agg(F.sum((F.col("k") > 1).cast("bigint")).alias("leaking"))
    return s.groupBy("split").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(leaks))


def time_split(spark, sf):
    """Up to 2023 and undated: train with 15 % of it as validation; later: test."""
    x = _priced(spark, sf).select("listing_id", F.coalesce(F.year("posted") > 2023, F.lit(False)).alias("late"))
    val = hash_order(F.col("listing_id"), F.lit(SEED)) / F.lit(float(1 << 60)) < 0.15
    return x.groupBy(F.when(F.col("late"), "test").when(val, "val").otherwise("train").alias("split")).agg(F.count("*").alias("rows"))


def group_folds(spark, sf):
    """Five folds by signature, dealt in hash order."""
    g = _priced(spark, sf).where("spec_signature IS NOT NULL").groupBy("spec_signature").agg(F.count("*").alias("n"))
    r = hash_ranks(g.withColumn("_all", F.lit(0)), ["_all"], "spec_signature", SEED)
    return r.groupBy(((F.col("rank") - 1) % 5).cast("int").alias("fold")).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


def stratified_folds(spark, sf):
    b = quantile_bins(_priced(spark, sf), "price", 10, "bin").select("listing_id", "bin")
    r = hash_ranks(b, ["bin"], "listing_id", SEED)
    return r.groupBy("bin", ((F.col("rank") - 1) % 5).cast("int").alias("fold")).agg(F.count("*").alias("rows"))


def stratified_sample(spark, sf):
    """At most 30 listings of each price decile."""
    b = quantile_bins(_priced(spark, sf), "price", 10, "bin").select("listing_id", "bin")
    return hash_ranks(b, ["bin"], "listing_id", SEED).where("rank <= 30").select("listing_id", "bin")


def random_sample(spark, sf):
    x = _priced(spark, sf).select("listing_id", hash_order(F.col("listing_id"), F.lit(SEED)).alias("h"))
    return x.orderBy("h", "listing_id").limit(200).select("listing_id")


def subsamples(spark, sf):
    """Twenty 80 % subsamples without replacement: size and mean price of each."""
    x = _priced(spark, sf).select("listing_id", "price", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("replicate"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("listing_id").cast("string"), F.col("replicate").cast("string"))), 1, 15), 16, 10).cast("bigint") / F.lit(float(1 << 60))
    return x.where(u < 0.8).groupBy("replicate").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"))


# -- metrics: the prediction is the median of the listing's signature, else of all ----------------


def _predicted(spark, sf):
    x = _priced(spark, sf)
    per = x.where("spec_signature IS NOT NULL").groupBy("spec_signature").agg(F.median("price").alias("m"))
    whole = x.agg(F.median("price").alias("w"))
    return x.join(per, "spec_signature", "left").crossJoin(F.broadcast(whole)).select("listing_id", "brand", "price", F.coalesce("m", "w").alias("predicted"), F.col("w").alias("global_median"))


_PRED = _A + _P + ", s AS (SELECT spec_signature, median(price) AS m FROM p WHERE spec_signature IS NOT NULL GROUP BY 1), w AS (SELECT median(price) AS w FROM p), e AS (SELECT listing_id, brand, price, coalesce(m, w) AS predicted, w AS global_median FROM p LEFT JOIN s USING (spec_signature) CROSS JOIN w)"


def panel(actual, predicted):
    """The regression metrics as aggregate columns."""
    err = F.col(predicted) - F.col(actual)
    pct = F.abs(err) / F.col(actual)
    return [
        F.count("*").alias("n"), r6(1 - F.sum(err * err) / F.nullif(F.var_pop(actual) * F.count("*"), F.lit(0.0))).alias("r2"), F.round(F.avg(F.abs(err)), 3).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 3).alias("rmse"),
        r6(F.avg(pct) * 100).alias("mape"), r6(F.median(pct) * 100).alias("medape"), r6(F.avg((pct <= 0.1).cast("int")) * 100).alias("within_10"), r6(F.avg((pct <= 0.2).cast("int")) * 100).alias("within_20"),
    ]


def _panel_sql(p: str = "predicted") -> str:
    return f"count(*) AS n, round(1 - sum(pow({p} - price, 2)) / nullif(var_pop(price) * count(*), 0), 6) AS r2, round(avg(abs({p} - price)), 3) AS mae, round(sqrt(avg(pow({p} - price, 2))), 3) AS rmse, round(avg(abs({p} - price) / price) * 100, 6) AS mape, round(median(abs({p} - price) / price) * 100, 6) AS medape, round(avg(CAST(abs({p} - price) / price <= 0.1 AS INT)) * 100, 6) AS within_10, round(avg(CAST(abs({p} - price) / price <= 0.2 AS INT)) * 100, 6) AS within_20"


def regression_panel(spark, sf):
    return _predicted(spark, sf).agg(*panel("price", "predicted"))


def segment_report(spark, sf):
    """The panel per brand with at least 30 listings, worst first."""
    return _predicted(spark, sf).groupBy("brand").agg(*panel("price", "predicted")).where("n >= 30").orderBy(F.desc("medape"), "brand")


def baselines(spark, sf):
    e = _predicted(spark, sf)
    return e.agg(*panel("price", "global_median")).withColumn("model", F.lit("global median")).unionByName(e.agg(*panel("price", "predicted")).withColumn("model", F.lit("same configuration")))


def interval_coverage(spark, sf):
    """Share inside the 10-90 band of the listing's configuration, and the band's width."""
    x = _priced(spark, sf).where("spec_signature IS NOT NULL")
    q = x.groupBy("spec_signature").agg(F.percentile("price", F.lit(0.1)).alias("lo"), F.percentile("price", F.lit(0.9)).alias("hi"))
    j = x.join(q, "spec_signature")
    return j.agg(r6(F.avg(F.col("price").between(F.col("lo"), F.col("hi")).cast("int"))).alias("coverage"), F.round(F.median(F.col("hi") - F.col("lo")), 3).alias("width"))


def conformal_band(spark, sf):
    """A band around the prediction from the 90th percentile of relative residuals on a held-out fifth."""
    e = _predicted(spark, sf).withColumn("held", hash_order(F.col("listing_id"), F.lit(SEED)) % 5 == 0)
    q = e.where("held").agg(F.percentile(F.abs(F.col("price") / F.col("predicted") - 1), F.lit(0.9)).alias("q"))
    j = e.where("NOT held").crossJoin(F.broadcast(q))
    inside = F.abs(F.col("price") / F.col("predicted") - 1) <= F.col("q")
    return j.agg(F.count("*").alias("n"), r6(F.first("q")).alias("half_width"), r6(F.avg(inside.cast("int"))).alias("coverage"))


def decile_errors(spark, sf):
    e = quantile_bins(_predicted(spark, sf), "price", 10, "decile")
    return e.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("price"))), 3).alias("mae"), r6(F.median(F.abs(F.col("predicted") - F.col("price")) / F.col("price"))).alias("medape"))


def spread_ratio(spark, sf):
    """75th over 25th percentile of price per brand with more than three listings."""
    return _priced(spark, sf).groupBy("brand").agg(F.count("*").alias("n"), r6(F.percentile("price", F.lit(0.75)) / F.percentile("price", F.lit(0.25))).alias("ratio")).where("n > 3")


def precision_at_k(spark, sf):
    """Of the 100 listings furthest below their prediction, the share below 60 % of the global median."""
    e = _predicted(spark, sf).withColumn("discount", r6(1 - F.col("price") / F.col("predicted")))
    top = e.orderBy(F.desc("discount"), "listing_id").limit(100)
    return top.agg(r6(F.avg((F.col("price") < 0.6 * F.col("global_median")).cast("int"))).alias("precision_at_100"))


def _labels(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b"), (F.col("label") % 3).cast("int").alias("c"))


_L = "WITH l AS (SELECT vec_id, label AS a, CAST(vec_id % 7 AS INT) AS b, CAST(label % 3 AS INT) AS c FROM embeddings)"


def adjusted_rand(spark, sf):
    """Agreement of pairs of labelings, from their contingency tables."""
    l = _labels(spark, sf)
    out = None
    pairs = F.col("n") * (F.col("n") - 1) / 2
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        cells = l.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
        s = cells.agg(F.sum(pairs).alias("both"), F.sum("n").alias("all"))
        sx = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs).alias("px"))
        sy = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs).alias("py"))
        expected = F.col("px") * F.col("py") / (F.col("all") * (F.col("all") - 1) / 2)
        r = s.crossJoin(sx).crossJoin(sy).select(F.lit(f"{x}{y}").alias("pair"), r6((F.col("both") - expected) / F.nullif((F.col("px") + F.col("py")) / 2 - expected, F.lit(0.0))).alias("ari"))
        out = r if out is None else out.unionByName(r)
    return out


def _ari_sql(x: str, y: str) -> str:
    return f"SELECT '{x}{y}' AS pair, round((both_ - px * py / (n * (n - 1) / 2)) / nullif((px + py) / 2 - px * py / (n * (n - 1) / 2), 0), 6) AS ari FROM (SELECT sum(k * (k - 1) / 2) AS both_, sum(k) AS n FROM (SELECT count(*) AS k FROM l GROUP BY {x}, {y})), (SELECT sum(k * (k - 1) / 2) AS px FROM (SELECT count(*) AS k FROM l GROUP BY {x})), (SELECT sum(k * (k - 1) / 2) AS py FROM (SELECT count(*) AS k FROM l GROUP BY {y}))"


def partition_shape(spark, sf):
    s = _labels(spark, sf).groupBy("a").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), r6(F.max("n") / F.sum("n")).alias("largest_share"), r6(F.max("n") / F.min("n")).alias("size_ratio"))


def co_association(spark, sf):
    """Per label, how often its members share the other labelings: pairs are counted from group sizes, never listed."""
    l = _labels(spark, sf)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    per = lambda *k: l.groupBy("a", *k).agg(F.count("*").alias("n")).groupBy("a").agg(F.sum(pairs).alias("p_" + "_".join(("a", *k))))
    j = per().join(per("b"), "a").join(per("c"), "a")
    return j.select("a", r6((F.col("p_a_b") + F.col("p_a_c")) / (2 * F.col("p_a"))).alias("strength"))


QUERIES = {f.__name__: f for f in (stratified_split, grouped_split_leak, time_split, group_folds, stratified_folds, stratified_sample, random_sample, subsamples, regression_panel, segment_report, baselines, interval_coverage, conformal_band, decile_errors, spread_ratio, precision_at_k, adjusted_rand, partition_shape, co_association)}
_BIN = ", e AS (SELECT list_sort(list_distinct(quantile_cont({v}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM p), b AS (SELECT p.*, CAST(greatest(len(list_filter(e, lambda x: x < {v})) - 1, 0) AS INT) AS bin FROM p, e)"
_ID = _H.format("listing_id")
ORACLE = {
    "stratified_split": _A + _P.replace("SELECT DISTINCT", "SELECT DISTINCT ln(1 + price) AS lp,") + _BIN.format(v="lp") + f", r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_ID}, listing_id) AS rank, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT listing_id, CASE WHEN rank <= floor(n * 0.6) THEN 'train' WHEN rank <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r",
    "grouped_split_leak": _A + _P + f", u AS (SELECT {_H.format('spec_signature')} / 1152921504606846976.0::DOUBLE AS u FROM p WHERE spec_signature IS NOT NULL) SELECT CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS rows, 0 AS leaking FROM u GROUP BY 1",
    "time_split": _A + _P + f" SELECT CASE WHEN coalesce(year(posted) > 2023, false) THEN 'test' WHEN {_ID} / 1152921504606846976.0::DOUBLE < 0.15 THEN 'val' ELSE 'train' END AS split, count(*) AS rows FROM p GROUP BY 1",
    "group_folds": _A + _P + f", g AS (SELECT spec_signature, count(*) AS n FROM p WHERE spec_signature IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY {_H.format('spec_signature')}, spec_signature) AS rank FROM g) SELECT CAST((rank - 1) % 5 AS INT) AS fold, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups FROM r GROUP BY 1",
    "stratified_folds": _A + _P + _BIN.format(v="price") + f", r AS (SELECT bin, row_number() OVER (PARTITION BY bin ORDER BY {_ID}, listing_id) AS rank FROM b) SELECT bin, CAST((rank - 1) % 5 AS INT) AS fold, count(*) AS rows FROM r GROUP BY 1, 2",
    "stratified_sample": _A + _P + _BIN.format(v="price") + f" SELECT listing_id, bin FROM (SELECT listing_id, bin, row_number() OVER (PARTITION BY bin ORDER BY {_ID}, listing_id) AS rank FROM b) WHERE rank <= 30",
    "random_sample": _A + _P + f" SELECT listing_id FROM p ORDER BY {_ID}, listing_id LIMIT 200",
    "subsamples": _A + _P + ", x AS (SELECT price, listing_id, unnest(range(1, 21)) AS replicate FROM p) SELECT CAST(replicate AS INT) AS replicate, count(*) AS n, round(avg(price), 4) AS mean_price FROM x WHERE CAST(('0x' || substr(md5(concat_ws('|', listing_id, replicate)), 1, 15)) AS BIGINT) / 1152921504606846976.0::DOUBLE < 0.8 GROUP BY 1",
    "regression_panel": _PRED + f" SELECT {_panel_sql()} FROM e",
    "segment_report": _PRED + f" SELECT brand, {_panel_sql()} FROM e GROUP BY 1 HAVING count(*) >= 30",
    "baselines": _PRED + f" SELECT {_panel_sql('global_median')}, 'global median' AS model FROM e UNION ALL SELECT {_panel_sql()}, 'same configuration' FROM e",
    "interval_coverage": _A + _P + ", q AS (SELECT spec_signature, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.9) AS hi FROM p WHERE spec_signature IS NOT NULL GROUP BY 1) SELECT round(avg(CAST(price BETWEEN lo AND hi AS INT)), 6) AS coverage, round(median(hi - lo), 3) AS width FROM p JOIN q USING (spec_signature)",
    "conformal_band": _PRED + f", h AS (SELECT *, {_ID} % 5 = 0 AS held, abs(price / predicted - 1) AS r FROM e), q AS (SELECT quantile_cont(r, 0.9) AS q FROM h WHERE held) SELECT count(*) AS n, round(any_value(q), 6) AS half_width, round(avg(CAST(r <= q AS INT)), 6) AS coverage FROM h, q WHERE NOT held",
    "decile_errors": _PRED + ", d AS (SELECT list_sort(list_distinct(quantile_cont(price, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS d FROM e) SELECT CAST(greatest(len(list_filter(d, lambda x: x < price)) - 1, 0) AS INT) AS decile, count(*) AS n, round(avg(abs(predicted - price)), 3) AS mae, round(median(abs(predicted - price) / price), 6) AS medape FROM e, d GROUP BY 1",
    "spread_ratio": _A + _P + " SELECT brand, count(*) AS n, round(quantile_cont(price, 0.75) / quantile_cont(price, 0.25), 6) AS ratio FROM p GROUP BY 1 HAVING count(*) > 3",
    "precision_at_k": _PRED + ", t AS (SELECT * FROM e ORDER BY round(1 - price / predicted, 6) DESC, listing_id LIMIT 100) SELECT round(avg(CAST(price < 0.6 * global_median AS INT)), 6) AS precision_at_100 FROM t",
    "adjusted_rand": _L + " " + " UNION ALL ".join(_ari_sql(x, y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))),
    "partition_shape": _L + " SELECT count(*) AS clusters, round(max(n) / sum(n), 6) AS largest_share, round(max(n) / min(n), 6) AS size_ratio FROM (SELECT count(*) AS n FROM l GROUP BY a)",
    "co_association": _L + " SELECT x.a, round(avg((CAST(x.b = y.b AS INT) + CAST(x.c = y.c AS INT)) / 2), 6) AS strength FROM l x JOIN l y ON x.a = y.a AND x.vec_id < y.vec_id GROUP BY 1",
}
