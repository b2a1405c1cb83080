"""Further cleaning, near-duplicate, clustering and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe.functions.specs import capacity_gb, labelled_bins
from souqframe.operators import clusters
from souqframe.operators.ranking import hash_order
from souqframe.operators.running import running_sum
from souqframe.operators.text_classes import small
from souqframe.plans.cleaning_queries import FAMILY_SQL, _capacity_sql, family_words, named_family
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import read_table

_A = f"WITH {ADS} "


def card_texts(spark, sf):
    """Series, number and variant of typed graphics cards, by the words of the card list."""
    ads = read_table(spark, sf, "listings").select("listing_id", "DEDICATED_GPU")
    series = small(named_family(ads, "DEDICATED_GPU", family_words(spark, sf, "gpus", "gpu_name")), "DEDICATED_GPU")
    last = F.lower(F.regexp_extract("gpu_name", r"\d ([A-Za-z]+)$", 1)).alias("token")
    variants = read_table(spark, sf, "gpus").select(last).where("token <> ''").distinct()
    token = F.explode(F.regexp_extract_all(F.lower("DEDICATED_GPU"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("token")
    variant = ads.select("DEDICATED_GPU").distinct().select("DEDICATED_GPU", token).join(small(variants, "token"), "token").groupBy("DEDICATED_GPU").agg(F.min("token").alias("variant"))
    number = F.nullif(F.regexp_extract("DEDICATED_GPU", r"(\d{3,5})", 1), F.lit("")).try_cast("bigint")
    return ads.join(series, "DEDICATED_GPU", "left").join(small(variant, "DEDICATED_GPU"), "DEDICATED_GPU", "left").select("listing_id", F.col("family").alias("series"), number.alias("number"), "variant")


def number_of_listings_key(spark, sf):
    """A running key 1..n over distinct listings in hash order, from sliced running sums."""
    x = read_table(spark, sf, "listings").select("listing_id").distinct().withColumn("_o", hash_order(F.col("listing_id"), F.lit(1))).withColumn("_one", F.lit(1).cast("bigint")).withColumn("_all", F.lit(0))
    return running_sum(x, ["_all"], "_o", "_one", "row_key", tie=["listing_id"]).select("listing_id", "row_key")


def misses_of_both_maps(spark, sf):
    """Processors of listings that neither the memory map nor the part list has."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*@.*$", ""))).alias("k")
    typed = read_table(spark, sf, "listings").where("CPU IS NOT NULL").select(key(F.col("CPU"))).distinct()
    a = typed.subtract(read_table(spark, sf, "cpu_ddr_map").where("cpu_name IS NOT NULL").select(key(F.col("cpu_name"))))
    b = typed.subtract(read_table(spark, sf, "cpus").select(key(F.col("name"))))
    return a.intersect(b)


def storage_kinds(spark, sf):
    ssd, hdd = capacity_gb(F.col("SSD_SIZE")), capacity_gb(F.col("HDD_SIZE"))
    kind = F.when((ssd > 0) & (hdd > 0), "both").when(ssd > 0, "ssd").when(hdd > 0, "hdd").otherwise("none")
    return read_table(spark, sf, "listings").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def mark_bins(spark, sf):
    a = ads(spark, sf)
    return a.groupBy(labelled_bins(F.col("cpu_mark"), [0, 10_000, 25_000, 45_000, 1e9], ["entry", "middle", "high", "top"]).alias("mark_bin")).agg(F.count("*").alias("n"), F.median("price").alias("median_price"))


def merged_near_duplicates(spark, sf):
    """Rows equal but for storage: the drives each leaves empty are taken from the others (one row per key)."""
    keys = ["created_at", "city", "brand", "model_name", "CPU", "price_text", "RAM_SIZE"]
    g = ads(spark, sf).groupBy(*keys).agg(F.count_distinct("listing_id").alias("listings"), F.max("SSD_SIZE").alias("ssd"), F.max("HDD_SIZE").alias("hdd"))
    return g.where("listings > 1").select("created_at", "model_name", "CPU", "city", "listings", "ssd", "hdd")


def market_document(spark, sf):
    """The parts of a market summary as JSON rows."""
    a = ads(spark, sf).where("price IS NOT NULL")
    city = a.where("city_grouped IS NOT NULL").groupBy("city_grouped").agg(F.count("*").alias("n"), F.median("price").alias("median")).orderBy(F.desc("n"), "city_grouped").limit(10)
    return city.select(F.to_json(F.struct(F.col("city_grouped").alias("city"), "n", F.col("median").cast("bigint").alias("median"))).alias("json"))


def label_template(spark, sf):
    """Listings to label by hand: dearest, cheapest and a hash sample, tagged, with an empty label."""
    a = ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price", "brand").distinct()
    take = lambda order, tag: a.orderBy(*order, "listing_id").limit(25).withColumn("sampled_from", F.lit(tag))
    return take([F.desc("price")], "dearest").unionByName(take(["price"], "cheapest")).unionByName(take([hash_order(F.col("listing_id"), F.lit(9))], "sample")).withColumn("label", F.lit(""))


def learning_sizes(spark, sf):
    """Rows and mean price of nested training fractions in hash order."""
    a = ads(spark, sf).where("price IS NOT NULL").select("listing_id", "price").distinct().withColumn("u", hash_order(F.col("listing_id"), F.lit(5)) / F.lit(float(1 << 60)))
    return a.select("price", "u", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 1.0)])).alias("fraction")).where("u < fraction").groupBy("fraction").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"))


def silhouette_of_labels(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return spark.createDataFrame([(round(clusters.silhouette(e, "vec_id", "embedding", "label"), 6),)], "silhouette double")


def density_clusters(spark, sf):
    return clusters.dbscan(read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 6.0, 5)


def consensus_clusters(spark, sf):
    """Ten clusters from three labelings of the vectors."""
    from souqframe.plans.split_queries import _labels

    return clusters.consensus(_labels(spark, sf), "vec_id", ["a", "b", "c"], 10)


def segment_names(spark, sf):
    """A name per brand from its medians."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL").groupBy("brand").agg(F.median("price").alias("p"), F.median("cpu_mark").alias("m"), F.count("*").alias("n"))
    name = F.concat(F.when(F.col("p") >= 120_000, "dear").when(F.col("p") >= 60_000, "middle").otherwise("cheap"), F.lit(" "), F.when(F.col("m") >= 30_000, "fast").otherwise("slow"))
    return a.select("brand", "n", name.alias("segment"))


QUERIES = {f.__name__: f for f in (card_texts, number_of_listings_key, misses_of_both_maps, storage_kinds, mark_bins, merged_near_duplicates, market_document, label_template, learning_sizes, silhouette_of_labels, density_clusters, consensus_clusters, segment_names)}
_H = "CAST(('0x' || substr(md5(concat_ws('|', listing_id, {})), 1, 15)) AS BIGINT)"
_KEY = r"lower(trim(regexp_replace({}, '\s*@.*$', '')))"
_D = ", d AS (SELECT DISTINCT listing_id, price, brand FROM a WHERE price IS NOT NULL)"
ORACLE = {
    "card_texts": "WITH " + FAMILY_SQL.format(name="gpu_name", table="gpus", text="DEDICATED_GPU") + r", va AS (SELECT DISTINCT lower(regexp_extract(gpu_name, '\d ([A-Za-z]+)$', 1)) AS token FROM gpus), vt AS (SELECT DEDICATED_GPU, min(token) AS variant FROM (SELECT DISTINCT DEDICATED_GPU, unnest(regexp_extract_all(lower(DEDICATED_GPU), '[\p{L}]+')) AS token FROM listings WHERE DEDICATED_GPU IS NOT NULL) JOIN va USING (token) WHERE token <> '' GROUP BY 1) SELECT listing_id, family AS series, try_cast(nullif(regexp_extract(DEDICATED_GPU, '(\d{3,5})', 1), '') AS BIGINT) AS number, variant FROM listings LEFT JOIN fam USING (DEDICATED_GPU) LEFT JOIN vt USING (DEDICATED_GPU)",
    "number_of_listings_key": f"SELECT listing_id, row_number() OVER (ORDER BY {_H.format(1)}, listing_id) AS row_key FROM (SELECT DISTINCT listing_id FROM listings)",
    "misses_of_both_maps": f"SELECT DISTINCT {_KEY.format('CPU')} AS k FROM listings WHERE CPU IS NOT NULL AND {_KEY.format('CPU')} NOT IN (SELECT {_KEY.format('cpu_name')} FROM cpu_ddr_map WHERE cpu_name IS NOT NULL) AND {_KEY.format('CPU')} NOT IN (SELECT {_KEY.format('name')} FROM cpus)",
    "storage_kinds": f"WITH s AS (SELECT {_capacity_sql('SSD_SIZE', 9)} AS s, {_capacity_sql('HDD_SIZE', 9)} AS h FROM listings) SELECT CASE WHEN s > 0 AND h > 0 THEN 'both' WHEN s > 0 THEN 'ssd' WHEN h > 0 THEN 'hdd' ELSE 'none' END AS kind, count(*) AS n FROM s GROUP BY 1",
    "mark_bins": _A + "SELECT CASE WHEN cpu_mark > 0 AND cpu_mark <= 10000 THEN 'entry' WHEN cpu_mark > 10000 AND cpu_mark <= 25000 THEN 'middle' WHEN cpu_mark > 25000 AND cpu_mark <= 45000 THEN 'high' WHEN cpu_mark > 45000 THEN 'top' END AS mark_bin, count(*) AS n, median(price) AS median_price FROM a GROUP BY 1",
    "merged_near_duplicates": _A + "SELECT created_at, model_name, CPU, city, count(DISTINCT listing_id) AS listings, max(SSD_SIZE) AS ssd, max(HDD_SIZE) AS hdd FROM a GROUP BY created_at, city, brand, model_name, CPU, price_text, RAM_SIZE HAVING count(DISTINCT listing_id) > 1",
    "market_document": _A + ", c AS (SELECT city_grouped AS city, count(*) AS n, CAST(trunc(median(price)) AS BIGINT) AS median FROM a WHERE price IS NOT NULL AND city_grouped IS NOT NULL GROUP BY 1 ORDER BY n DESC, city LIMIT 10) SELECT '{\"city\":\"' || city || '\",\"n\":' || n || ',\"median\":' || median || '}' AS json FROM c",
    "label_template": _A + _D + " " + " UNION ALL ".join(f"SELECT listing_id, price, brand, '{t}' AS sampled_from, '' AS label FROM (SELECT * FROM d ORDER BY {o}, listing_id LIMIT 25)" for o, t in (("price DESC", "dearest"), ("price", "cheapest"), (_H.format(9), "sample"))),
    "learning_sizes": _A + _D + f", f AS (SELECT price, {_H.format(5)} / 1152921504606846976.0::DOUBLE AS u, unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS fraction FROM d) SELECT fraction, count(*) AS n, round(avg(price), 4) AS mean_price FROM f WHERE u < fraction GROUP BY 1",
    "silhouette_of_labels": "WITH p AS (SELECT x.vec_id AS i, x.label AS l, y.label AS m, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id), g AS (SELECT i, l, m, avg(d) AS d FROM p GROUP BY 1, 2, 3), s AS (SELECT i, max(d) FILTER (l = m) AS a, min(d) FILTER (l <> m) AS b FROM g GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s",
    "segment_names": _A + "SELECT brand, count(*) AS n, CASE WHEN median(price) >= 120000 THEN 'dear' WHEN median(price) >= 60000 THEN 'middle' ELSE 'cheap' END || ' ' || CASE WHEN median(cpu_mark) >= 30000 THEN 'fast' ELSE 'slow' END AS segment FROM a WHERE price IS NOT NULL AND brand IS NOT NULL GROUP BY 1",
}
