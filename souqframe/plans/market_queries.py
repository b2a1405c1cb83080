"""Aggregates, pivots, windows, sorting and set operations over all listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souqframe.functions.specs import capacity_gb
from souqframe.operators.ranking import cumulative_counts, quantile_bins
from souqframe.plans.cleaning_queries import _SWAP, _capacity_sql
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import read_table

_A = f"WITH {ADS} "


def market_overview(spark, sf):
    return ads(spark, sf).agg(F.count("price").alias("listings"), r6(F.median("price")).alias("median"), F.round(F.avg("price"), 4).alias("mean"), F.round(F.stddev_samp("price"), 4).alias("sd"), F.countDistinct("brand").alias("brands"))


def market_by_city(spark, sf):
    """Median price per city with enough listings, most expensive first."""
    a = ads(spark, sf).where("price IS NOT NULL AND city_grouped IS NOT NULL")
    return a.groupBy("city_grouped").agg(F.count("*").alias("listings"), F.median("price").alias("median_price")).where("listings >= 5").orderBy(F.desc("median_price"), "city_grouped")


def price_by_year(spark, sf):
    return ads(spark, sf).where("price IS NOT NULL AND posted IS NOT NULL").groupBy(F.year("posted").alias("year")).agg(F.median("price").alias("median_price"), F.count("*").alias("listings"))


def price_by_memory(spark, sf):
    a = ads(spark, sf).where("price IS NOT NULL").groupBy(capacity_gb(F.col("RAM_SIZE")).alias("ram_gb")).agg(F.median("price").alias("median_price"), F.count("*").alias("listings"))
    return a.where("listings >= 50")


def brand_condition_pivot(spark, sf):
    """Median price by brand and condition for the five most frequent brands, in their order."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL")
    top = a.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(5)
    names = {"MOYEN": "moyen", "BON TAT": "bon", "JAMAIS UTILIS": "neuf"}
    p = a.join(F.broadcast(top), "brand").groupBy("brand", "n").pivot("spec_Etat", list(names)).agg(F.median("price"))
    return p.select("brand", "n", *[F.col(k).alias(v) for k, v in names.items()]).orderBy(F.desc("n"), "brand")


def config_spread(spark, sf):
    """How far prices of one configuration spread: max/min per signature, and the median of it per brand."""
    a = ads(spark, sf).where("price IS NOT NULL AND spec_signature IS NOT NULL AND brand IS NOT NULL")
    per = a.groupBy("brand", "spec_signature").agg(F.count("*").alias("n"), (F.max("price") / F.min("price")).alias("ratio")).where("n >= 5")
    return per.groupBy("brand").agg(r6(F.median("ratio")).alias("median_ratio"), F.count("*").alias("configurations"))


def cpu_catalog(spark, sf):
    """Per processor: count, medians, modes, and the median GPU mark of listings without a dedicated card."""
    a = ads(spark, sf).where("mapped_cpu_name IS NOT NULL")
    igpu = F.when(F.col("DEDICATED_GPU").isNull(), F.col("gpu_g3d_mark"))
    return a.groupBy("mapped_cpu_name").agg(F.count("*").alias("listings"), F.median("price").alias("median_price"), F.median("cpu_mark").alias("median_mark"), F.median("tdp").alias("median_tdp"), F.mode("brand", True).alias("usual_brand"), F.mode("SCREEN_RESOLUTION_STD", True).alias("usual_screen"), F.median(igpu).alias("integrated_mark"))


def gpu_catalog(spark, sf):
    return ads(spark, sf).where("gpu_name IS NOT NULL AND DEDICATED_GPU IS NOT NULL").groupBy("gpu_name").agg(F.count("*").alias("listings"), F.median("price").alias("median_price"), F.median("gpu_tdp").alias("median_tdp")).orderBy(F.desc("listings"), "gpu_name")


def value_frequencies(spark, sf):
    a = read_table(spark, sf, "listings").where("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("n"))
    return a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("all")))).select("brand", "n", r6(F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("n"), "brand")


def price_quantiles(spark, sf):
    q = F.percentile("price", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99)]))
    return ads(spark, sf).agg(q.alias("q")).select(*[F.round(F.element_at("q", i + 1), 4).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p99"))])


def quantile_bounds_filter(spark, sf):
    """Listings between the 1st and 99th percentile of price, counted per brand."""
    a = ads(spark, sf).where("price IS NOT NULL")
    b = a.agg(F.percentile("price", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return a.crossJoin(F.broadcast(b)).where(F.col("price").between(F.element_at("q", 1), F.element_at("q", 2))).groupBy("brand").agg(F.count("*").alias("n"))


_NULLABLE = ("created_at", "city", "spec_Etat", "brand", "model_name", "CPU", "DEDICATED_GPU", "RAM_SIZE", "SSD_SIZE", "HDD_SIZE", "RAM_TYPE", "mapped_cpu_name", "gpu_name", "spec_signature")


def null_report(spark, sf):
    a = read_table(spark, sf, "listings")
    one = a.agg(F.count("*").alias("all"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in _NULLABLE])
    return one.unpivot(["all"], list(_NULLABLE), "column_name", "nulls").select("column_name", "nulls", r6(F.col("nulls") * 100 / F.col("all")).alias("percent"))


_DESCRIBED = ("price", "cpu_mark", "tdp", "cores", "screen")


def data_card(spark, sf):
    """Null rate, distinct values, least, median and greatest of each numeric column."""
    a = ads(spark, sf)
    stats = {"null_rate": lambda c: F.avg(F.col(c).isNull().cast("int")), "distinct_values": lambda c: F.count_distinct(c).cast("double"), "least": F.min, "middle": F.median, "greatest": F.max}
    one = a.agg(*[r6(f(c)).alias(f"{c}__{n}") for c in _DESCRIBED for n, f in stats.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in stats]) for c in _DESCRIBED]))
    return one.select(rows.alias("r")).select("r.*")


def skew_kurtosis(spark, sf):
    """Bias-corrected skewness and excess kurtosis."""
    s = ads(spark, sf).agg(F.count("price").cast("double").alias("n"), F.skewness("price").alias("g1"), F.kurtosis("price").alias("g2"))
    n = F.col("n")
    return s.select(r6(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), r6((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


_CORRELATED = ("cpu_mark", "tdp", "cores", "gpu_g3d_mark", "screen", "SCREEN_RESOLUTION_ENC")


def correlation_with_price(spark, sf):
    one = ads(spark, sf).agg(*[r6(F.corr(c, "price")).alias(c) for c in _CORRELATED])
    return one.unpivot([], list(_CORRELATED), "feature", "r").orderBy(F.desc(F.abs("r")), "feature")


def correlation_matrix(spark, sf):
    pairs = [(a, b) for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1 :]]
    one = ads(spark, sf).agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.corr(a, b)).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("p")).select("p.*")


def crosstab_flags(spark, sf):
    a = ads(spark, sf).select((F.col("price") > 200_000).alias("dear"), (F.col("cpu_mark") > 30_000).alias("fast")).where("dear IS NOT NULL AND fast IS NOT NULL")
    return a.groupBy("dear").pivot("fast", [False, True]).count().select("dear", F.col("false").alias("slow_n"), F.col("true").alias("fast_n"))


def top_brands_text(spark, sf):
    """"A (n), B (m), C (k)" per city."""
    a = read_table(spark, sf, "listings").where("brand IS NOT NULL AND city_grouped IS NOT NULL").groupBy("city_grouped", "brand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("city_grouped").orderBy(F.desc("n"), "brand")
    top = a.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("city_grouped").agg(F.sort_array(F.collect_list(F.struct("r", F.concat("brand", F.lit(" ("), "n", F.lit(")")).alias("t")))).alias("l"))
    return top.select("city_grouped", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("brands"))


def conditional_means(spark, sf):
    mean = lambda low, high: F.round(F.avg(F.when((F.col("cpu_mark") >= low) & (F.col("cpu_mark") < high), F.col("price"))), 4)
    return ads(spark, sf).agg(mean(0, 10_000).alias("entry"), mean(10_000, 25_000).alias("middle"), mean(25_000, 1e9).alias("high"))


def variance_ranking(spark, sf):
    one = ads(spark, sf).agg(*[F.round(F.var_samp(c), 3).alias(c) for c in _CORRELATED])
    return one.unpivot([], list(_CORRELATED), "feature", "variance").orderBy(F.desc("variance"), "feature").limit(4)


def group_statistics(spark, sf):
    a = ads(spark, sf).where("price IS NOT NULL")
    return a.groupBy("spec_Etat").agg(F.round(F.avg("price"), 4).alias("mean"), F.median("price").alias("median"), F.min("price").alias("least"), F.max("price").alias("greatest"), F.round(F.stddev_samp("price"), 4).alias("sd"), F.count("*").alias("n"))


def exact_dedup(spark, sf):
    """Listings without repeated rows, per brand."""
    a = read_table(spark, sf, "listings").drop("scraped_at").dropDuplicates()
    return a.groupBy("brand").agg(F.count("*").alias("rows"))


_NEAR = ["created_at", "city", "brand", "model_name", "CPU", "price_text"]


def near_duplicate_groups(spark, sf):
    """Groups of equal keys (NULLs equal) where memory is given on some rows and missing on others."""
    g = ads(spark, sf).groupBy(*_NEAR).agg(F.count("*").alias("n"), F.count("RAM_SIZE").alias("given"))
    return g.where("n > 1 AND given > 0 AND given < n")


def near_duplicate_fill(spark, sf):
    """Memory completed from rows of the same keys; only completed rows."""
    a = ads(spark, sf)
    known = a.where("RAM_SIZE IS NOT NULL").groupBy(*_NEAR).agg(F.min("RAM_SIZE").alias("known"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in _NEAR]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.where("RAM_SIZE IS NULL").alias("l").join(known.alias("k"), cond).select("listing_id", F.col("known").alias("ram_size")).distinct()


def latest_per_model(spark, sf):
    """The latest posted listing of each model; ties by id."""
    a = ads(spark, sf).where("posted IS NOT NULL AND model_name IS NOT NULL").groupBy("model_name").agg(F.max_by(F.struct("listing_id", "price"), F.struct("posted", "listing_id")).alias("x"))
    return a.select("model_name", "x.listing_id", "x.price")


def bucket_shares(spark, sf):
    r = capacity_gb(F.col("RAM_SIZE"))
    return read_table(spark, sf, "listings").agg(r6(F.avg((r == 16).cast("int"))).alias("share_16"), r6(F.avg(r.isin(8, 16).cast("int"))).alias("share_8_16"))


def missing_by_group(spark, sf):
    a = ads(spark, sf)
    return a.groupBy("brand").agg(*[r6(F.avg(F.col(c).isNull().cast("int"))).alias(f"{c}_missing") for c in ("price", "screen", "cpu_mark")])


def pipeline_counters(spark, sf):
    from souqframe.functions.specs import cells_swapped, drive_pair

    a = read_table(spark, sf, "listings")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return a.agg(n(cells_swapped(F.col("RAM_SIZE"), F.col("SSD_SIZE"))).alias("swapped"), n(drive_pair(F.col("SSD_SIZE"))[1].isNotNull()).alias("split"), n(F.col("RAM_TYPE").isNull()).alias("type_missing"), F.count("*").alias("rows"))


def mode_fill(spark, sf):
    """Resolution missing on a listing: the mode of its model, else of all."""
    a = read_table(spark, sf, "listings").select("listing_id", "model_name", "SCREEN_RESOLUTION_STD")
    per = a.where("SCREEN_RESOLUTION_STD IS NOT NULL").groupBy("model_name").agg(F.mode("SCREEN_RESOLUTION_STD", True).alias("m"))
    whole = a.agg(F.mode("SCREEN_RESOLUTION_STD", True).alias("w"))
    return a.join(per, "model_name", "left").crossJoin(F.broadcast(whole)).select("listing_id", F.coalesce("SCREEN_RESOLUTION_STD", "m", "w").alias("resolution"), F.col("SCREEN_RESOLUTION_STD").isNull().alias("filled"))


def rare_levels(spark, sf):
    """Cities below 100 listings become OTHER. Counts are joined back, so no window holds a city."""
    a = read_table(spark, sf, "listings").select("listing_id", "city")
    often = a.where("city IS NOT NULL").groupBy("city").agg(F.count("*").alias("n")).where("n >= 100").select("city", F.col("city").alias("kept"))
    return a.join(often, "city", "left").groupBy(F.coalesce("kept", F.lit("OTHER")).alias("city_level")).agg(F.count("*").alias("n"))


def price_ecdf(spark, sf):
    """Share of listings at most as dear, for every distinct price."""
    c = cumulative_counts(ads(spark, sf), [], "price")
    return c.select("price", r6(F.col("upto") / F.col("total")).alias("cdf"), r6((F.col("upto") - F.col("n")) / F.nullif(F.col("total") - 1, F.lit(0))).alias("percent_rank"))


def price_deciles(spark, sf):
    a = quantile_bins(ads(spark, sf).where("price IS NOT NULL"), "price", 10, "decile")
    return a.groupBy("decile").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("greatest"))


def top_per_brand(spark, sf):
    """The three dearest listings of each brand (equal rows of an id once)."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL").select("brand", "listing_id", "price").distinct()
    w = Window.partitionBy("brand").orderBy(F.desc("price"), "listing_id")
    return a.withColumn("place", F.row_number().over(w)).where("place <= 3")


def cheapest_for_mark(spark, sf):
    """The 50 listings with the most processor mark per dinar."""
    a = ads(spark, sf).where("price IS NOT NULL AND cpu_mark IS NOT NULL").select("listing_id", "brand", r6(F.col("cpu_mark") / F.col("price")).alias("mark_per_dinar")).distinct()
    return a.orderBy(F.desc("mark_per_dinar"), "listing_id").limit(50)


def over_fetch(spark, sf):
    """Three times the wanted rows by one key, then a filter, then the wanted number."""
    a = ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price", "cores").distinct()
    return a.orderBy(F.desc("price"), "listing_id").limit(60).where("cores >= 8").orderBy(F.desc("price"), "listing_id").limit(20)


def ordered_labels(spark, sf):
    """A report in a fixed order of labels; labels nobody uses stay, empty."""
    order = spark.createDataFrame([(i, x) for i, x in enumerate(("HD", "HD+", "FHD", "WUXGA", "QHD", "QHD+", "3K", "4K", "5K"))], "ord int, tier string")
    n = read_table(spark, sf, "listings").groupBy(F.col("SCREEN_RESOLUTION_STD").alias("tier")).agg(F.count("*").alias("n"))
    return F.broadcast(order).join(n, "tier", "left").select("ord", "tier", "n").orderBy("ord")


def union_tagged(spark, sf):
    """Three tagged selections in one table."""
    a = ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price").distinct()
    low = a.orderBy("price", "listing_id").limit(20).withColumn("taken_from", F.lit("cheapest"))
    high = a.orderBy(F.desc("price"), "listing_id").limit(20).withColumn("taken_from", F.lit("dearest"))
    odd = a.where("price % 1000 <> 0").orderBy("listing_id").limit(20).withColumn("taken_from", F.lit("odd price"))
    return low.unionByName(high).unionByName(odd)


def set_operations(spark, sf):
    """Model names typed in the first and in the last year: in both, only in the first, only in the last."""
    a = ads(spark, sf).where("posted IS NOT NULL AND model_name IS NOT NULL")
    old, new = a.where(F.year("posted") <= 2021).select("model_name"), a.where(F.year("posted") >= 2025).select("model_name")
    tag = lambda d, t: d.withColumn("part", F.lit(t))
    return tag(old.intersect(new), "both").unionByName(tag(old.exceptAll(old.intersect(new)).distinct().subtract(new), "old")).unionByName(tag(new.subtract(old), "new")).groupBy("part").agg(F.count("*").alias("names"))


def binary_columns(spark, sf):
    """Which of some flag columns hold nothing but 0 and 1."""
    a = ads(spark, sf).select((F.col("DEDICATED_GPU").isNotNull()).cast("int").alias("dedicated"), (F.col("price") > 1e5).cast("int").alias("dear"), F.col("cores").cast("int").alias("cores"))
    one = a.agg(*[(F.max((~F.col(c).isin(0, 1)).cast("int")) == 0).alias(c) for c in a.columns])
    return one.unpivot([], ["dedicated", "dear", "cores"], "column_name", "is_binary")


def brand_price_growth(spark, sf):
    """Median price by brand and year with the change from the year before."""
    a = ads(spark, sf).where("price IS NOT NULL AND posted IS NOT NULL AND brand IS NOT NULL").groupBy("brand", F.year("posted").alias("year")).agg(F.median("price").alias("median_price"))
    w = Window.partitionBy("brand").orderBy("year")
    return a.withColumn("change", r6(F.col("median_price") / F.lag("median_price").over(w) - 1))


QUERIES = {
    f.__name__: f
    for f in (
        market_overview, market_by_city, price_by_year, price_by_memory, brand_condition_pivot, config_spread, cpu_catalog, gpu_catalog, value_frequencies, price_quantiles, quantile_bounds_filter, null_report,
        data_card, skew_kurtosis, correlation_with_price, correlation_matrix, crosstab_flags, top_brands_text, conditional_means, variance_ranking, group_statistics, exact_dedup, near_duplicate_groups, near_duplicate_fill,
        latest_per_model, bucket_shares, missing_by_group, pipeline_counters, mode_fill, rare_levels, price_ecdf, price_deciles, top_per_brand, cheapest_for_mark, over_fetch, ordered_labels, union_tagged, set_operations, binary_columns, brand_price_growth,
    )
}
_MODE = "(SELECT {v} FROM (SELECT {k}, {v}, count(*) AS n FROM a WHERE {v} IS NOT NULL GROUP BY ALL) m WHERE m.{k} = g.{k} ORDER BY n DESC, {v} LIMIT 1)"
ORACLE = {
    "market_overview": _A + "SELECT count(price) AS listings, round(median(price), 6) AS median, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS sd, count(DISTINCT brand) AS brands FROM a",
    "market_by_city": _A + "SELECT city_grouped, count(*) AS listings, median(price) AS median_price FROM a WHERE price IS NOT NULL AND city_grouped IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
    "price_by_year": _A + "SELECT CAST(year(posted) AS INT) AS year, median(price) AS median_price, count(*) AS listings FROM a WHERE price IS NOT NULL AND posted IS NOT NULL GROUP BY 1",
    "price_by_memory": _A + f"SELECT {_capacity_sql('RAM_SIZE', 15)} AS ram_gb, median(price) AS median_price, count(*) AS listings FROM a WHERE price IS NOT NULL GROUP BY 1 HAVING count(*) >= 50",
    "brand_condition_pivot": _A + ", t AS (SELECT brand, count(*) AS n FROM a WHERE price IS NOT NULL AND brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT brand, n, median(price) FILTER (spec_Etat = 'MOYEN') AS moyen, median(price) FILTER (spec_Etat = 'BON TAT') AS bon, median(price) FILTER (spec_Etat = 'JAMAIS UTILIS') AS neuf FROM a JOIN t USING (brand) WHERE price IS NOT NULL GROUP BY ALL",
    "config_spread": _A + ", p AS (SELECT brand, spec_signature, max(price) / min(price) AS ratio FROM a WHERE price IS NOT NULL AND spec_signature IS NOT NULL AND brand IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) SELECT brand, round(median(ratio), 6) AS median_ratio, count(*) AS configurations FROM p GROUP BY 1",
    "cpu_catalog": _A + ", g AS (SELECT mapped_cpu_name, count(*) AS listings, median(price) AS median_price, median(cpu_mark) AS median_mark, median(tdp) AS median_tdp, median(CASE WHEN DEDICATED_GPU IS NULL THEN gpu_g3d_mark END) AS integrated_mark FROM a WHERE mapped_cpu_name IS NOT NULL GROUP BY 1), m AS (SELECT mapped_cpu_name, brand, row_number() OVER (PARTITION BY mapped_cpu_name ORDER BY count(*) DESC, brand) AS r FROM a WHERE brand IS NOT NULL GROUP BY 1, 2), s AS (SELECT mapped_cpu_name, SCREEN_RESOLUTION_STD, row_number() OVER (PARTITION BY mapped_cpu_name ORDER BY count(*) DESC, SCREEN_RESOLUTION_STD) AS r FROM a WHERE SCREEN_RESOLUTION_STD IS NOT NULL GROUP BY 1, 2) SELECT g.*, m.brand AS usual_brand, s.SCREEN_RESOLUTION_STD AS usual_screen FROM g LEFT JOIN m ON m.mapped_cpu_name = g.mapped_cpu_name AND m.r = 1 LEFT JOIN s ON s.mapped_cpu_name = g.mapped_cpu_name AND s.r = 1",
    "gpu_catalog": _A + "SELECT gpu_name, count(*) AS listings, median(price) AS median_price, median(gpu_tdp) AS median_tdp FROM a WHERE gpu_name IS NOT NULL AND DEDICATED_GPU IS NOT NULL GROUP BY 1",
    "value_frequencies": "SELECT brand, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM listings WHERE brand IS NOT NULL GROUP BY 1",
    "price_quantiles": _A + "SELECT round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.9), 4) AS p90, round(quantile_cont(price, 0.99), 4) AS p99 FROM a",
    "quantile_bounds_filter": _A + ", q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM a) SELECT brand, count(*) AS n FROM a, q WHERE price BETWEEN lo AND hi GROUP BY 1",
    "null_report": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100 / count(*), 6) AS percent FROM listings" for c in _NULLABLE),
    "data_card": _A + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CAST({c} IS NULL AS INT)), 6) AS null_rate, CAST(count(DISTINCT {c}) AS DOUBLE) AS distinct_values, round(min({c}), 6) AS least, round(median({c}), 6) AS middle, round(max({c}), 6) AS greatest FROM a" for c in _DESCRIBED),
    "skew_kurtosis": _A + "SELECT round(skewness(price), 6) AS skewness, round(kurtosis(price), 6) AS kurtosis FROM a",
    "correlation_with_price": _A + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, price), 6) AS r FROM a" for c in _CORRELATED),
    "correlation_matrix": _A + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM a" for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1 :]),
    "crosstab_flags": _A + "SELECT price > 200000 AS dear, nullif(count(*) FILTER (NOT cpu_mark > 30000), 0) AS slow_n, nullif(count(*) FILTER (cpu_mark > 30000), 0) AS fast_n FROM a WHERE price IS NOT NULL AND cpu_mark IS NOT NULL GROUP BY 1",
    "top_brands_text": "WITH c AS (SELECT city_grouped, brand, count(*) AS n, row_number() OVER (PARTITION BY city_grouped ORDER BY count(*) DESC, brand) AS r FROM listings WHERE brand IS NOT NULL AND city_grouped IS NOT NULL GROUP BY 1, 2) SELECT city_grouped, string_agg(brand || ' (' || n || ')', ', ' ORDER BY r) AS brands FROM c WHERE r <= 3 GROUP BY 1",
    "conditional_means": _A + "SELECT round(avg(price) FILTER (cpu_mark >= 0 AND cpu_mark < 10000), 4) AS entry, round(avg(price) FILTER (cpu_mark >= 10000 AND cpu_mark < 25000), 4) AS middle, round(avg(price) FILTER (cpu_mark >= 25000), 4) AS high FROM a",
    "variance_ranking": _A + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 3) AS variance FROM a" for c in _CORRELATED) + ") ORDER BY variance DESC, feature LIMIT 4",
    "group_statistics": _A + "SELECT spec_Etat, round(avg(price), 4) AS mean, median(price) AS median, min(price) AS least, max(price) AS greatest, round(stddev_samp(price), 4) AS sd, count(*) AS n FROM a WHERE price IS NOT NULL GROUP BY 1",
    "exact_dedup": "SELECT brand, count(*) AS rows FROM (SELECT DISTINCT * EXCLUDE (scraped_at) FROM listings) GROUP BY 1",
    "near_duplicate_groups": _A + "SELECT created_at, city, brand, model_name, CPU, price_text, count(*) AS n, count(RAM_SIZE) AS given FROM a GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 1 AND count(RAM_SIZE) > 0 AND count(RAM_SIZE) < count(*)",
    "near_duplicate_fill": _A + ", k AS (SELECT created_at, city, brand, model_name, CPU, price_text, min(RAM_SIZE) AS known FROM a WHERE RAM_SIZE IS NOT NULL GROUP BY ALL) SELECT DISTINCT a.listing_id, k.known AS ram_size FROM a JOIN k ON a.RAM_SIZE IS NULL AND a.created_at IS NOT DISTINCT FROM k.created_at AND a.city IS NOT DISTINCT FROM k.city AND a.brand IS NOT DISTINCT FROM k.brand AND a.model_name IS NOT DISTINCT FROM k.model_name AND a.CPU IS NOT DISTINCT FROM k.CPU AND a.price_text IS NOT DISTINCT FROM k.price_text",
    "latest_per_model": _A + "SELECT model_name, listing_id, price FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY posted DESC, listing_id DESC) AS r FROM a WHERE posted IS NOT NULL AND model_name IS NOT NULL) WHERE r = 1",
    "bucket_shares": f"SELECT round(avg(CAST({_capacity_sql('RAM_SIZE', 15)} = 16 AS INT)), 6) AS share_16, round(avg(CAST({_capacity_sql('RAM_SIZE', 15)} IN (8, 16) AS INT)), 6) AS share_8_16 FROM listings",
    "missing_by_group": _A + "SELECT brand, round(avg(CAST(price IS NULL AS INT)), 6) AS price_missing, round(avg(CAST(screen IS NULL AS INT)), 6) AS screen_missing, round(avg(CAST(cpu_mark IS NULL AS INT)), 6) AS cpu_mark_missing FROM a GROUP BY 1",
    "pipeline_counters": f"SELECT count(*) FILTER ({_SWAP}) AS swapped, count(*) FILTER (len(string_split(SSD_SIZE, '+')) = 2) AS split, count(*) FILTER (RAM_TYPE IS NULL) AS type_missing, count(*) AS rows FROM listings",
    "mode_fill": "WITH m AS (SELECT model_name, SCREEN_RESOLUTION_STD AS m, row_number() OVER (PARTITION BY model_name ORDER BY count(*) DESC, SCREEN_RESOLUTION_STD) AS r FROM listings WHERE SCREEN_RESOLUTION_STD IS NOT NULL AND model_name IS NOT NULL GROUP BY 1, 2), w AS (SELECT SCREEN_RESOLUTION_STD AS w FROM listings WHERE SCREEN_RESOLUTION_STD IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT listing_id, coalesce(SCREEN_RESOLUTION_STD, m, w) AS resolution, SCREEN_RESOLUTION_STD IS NULL AS filled FROM listings LEFT JOIN m ON m.model_name = listings.model_name AND r = 1 CROSS JOIN w",
    "rare_levels": "WITH n AS (SELECT city, count(*) AS n FROM listings GROUP BY 1) SELECT CASE WHEN city IS NOT NULL AND n >= 100 THEN city ELSE 'OTHER' END AS city_level, sum(n)::BIGINT AS n FROM n GROUP BY 1",
    "price_ecdf": _A + ", c AS (SELECT price, count(*) AS n FROM a WHERE price IS NOT NULL GROUP BY 1), u AS (SELECT price, n, sum(n) OVER (ORDER BY price) AS upto, sum(n) OVER () AS total FROM c) SELECT price, round(upto / total, 6) AS cdf, round((upto - n) / nullif(total - 1, 0), 6) AS percent_rank FROM u",
    "price_deciles": _A + ", e AS (SELECT list_sort(list_distinct(quantile_cont(price, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM a) SELECT CAST(greatest(len(list_filter(e, lambda x: x < price)) - 1, 0) AS INT) AS decile, count(*) AS n, min(price) AS least, max(price) AS greatest FROM a, e WHERE price IS NOT NULL GROUP BY 1",
    "top_per_brand": _A + ", d AS (SELECT DISTINCT brand, listing_id, price FROM a WHERE price IS NOT NULL AND brand IS NOT NULL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, listing_id) AS place FROM d) WHERE place <= 3",
    "cheapest_for_mark": _A + "SELECT DISTINCT listing_id, brand, round(cpu_mark / price, 6) AS mark_per_dinar FROM a WHERE price IS NOT NULL AND cpu_mark IS NOT NULL ORDER BY mark_per_dinar DESC, listing_id LIMIT 50",
    "over_fetch": _A + ", d AS (SELECT DISTINCT listing_id, price, cores FROM a WHERE price IS NOT NULL ORDER BY price DESC, listing_id LIMIT 60) SELECT * FROM d WHERE cores >= 8 ORDER BY price DESC, listing_id LIMIT 20",
    "ordered_labels": "WITH o AS (SELECT unnest(range(9))::INT AS ord, unnest(['HD', 'HD+', 'FHD', 'WUXGA', 'QHD', 'QHD+', '3K', '4K', '5K']) AS tier), n AS (SELECT SCREEN_RESOLUTION_STD AS tier, count(*) AS n FROM listings GROUP BY 1) SELECT ord, tier, n FROM o LEFT JOIN n USING (tier)",
    "union_tagged": _A + ", d AS (SELECT DISTINCT listing_id, price FROM a WHERE price IS NOT NULL) SELECT * FROM (SELECT listing_id, price, 'cheapest' AS taken_from FROM d ORDER BY price, listing_id LIMIT 20) UNION ALL SELECT * FROM (SELECT listing_id, price, 'dearest' FROM d ORDER BY price DESC, listing_id LIMIT 20) UNION ALL SELECT * FROM (SELECT listing_id, price, 'odd price' FROM d WHERE price % 1000 <> 0 ORDER BY listing_id LIMIT 20)",
    "set_operations": _A + ", o AS (SELECT DISTINCT model_name FROM a WHERE model_name IS NOT NULL AND year(posted) <= 2021), n AS (SELECT DISTINCT model_name FROM a WHERE model_name IS NOT NULL AND year(posted) >= 2025) SELECT 'both' AS part, count(*) AS names FROM (FROM o INTERSECT FROM n) UNION ALL SELECT 'old', count(*) FROM (FROM o EXCEPT FROM n) UNION ALL SELECT 'new', count(*) FROM (FROM n EXCEPT FROM o)",
    "binary_columns": _A + "SELECT 'dedicated' AS column_name, true AS is_binary UNION ALL SELECT 'dear', true UNION ALL SELECT 'cores', coalesce(bool_and(CAST(cores AS INT) IN (0, 1)), true) FROM a",
    "brand_price_growth": _A + ", y AS (SELECT brand, CAST(year(posted) AS INT) AS year, median(price) AS median_price FROM a WHERE price IS NOT NULL AND posted IS NOT NULL AND brand IS NOT NULL GROUP BY 1, 2) SELECT *, round(median_price / lag(median_price) OVER (PARTITION BY brand ORDER BY year) - 1, 6) AS change FROM y",
}
