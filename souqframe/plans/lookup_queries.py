"""Joins and lookups against the reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe.functions.specs import cpu_key
from souqframe.operators.text_classes import small
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import read_table

_A = f"WITH {ADS} "


def lookup_with_default(spark, sf):
    """Each listing's card price; 0 for no or an unlisted card."""
    prices = read_table(spark, sf, "gpu_prices").where("gpu_name IS NOT NULL").groupBy("gpu_name").agg(F.max("estimated_price").alias("card_price"))
    a = read_table(spark, sf, "listings").select("listing_id", "gpu_name")
    return a.join(small(prices, "gpu_name"), "gpu_name", "left").select("listing_id", F.coalesce("card_price", F.lit(0)).alias("card_price"))


def lookup_or_null(spark, sf):
    cpus = read_table(spark, sf, "cpus").select("name", F.col("cores").alias("listed_cores"), F.col("tdp").alias("listed_tdp"))
    a = read_table(spark, sf, "listings").select("listing_id", F.col("mapped_cpu_name").alias("name"))
    return a.join(small(cpus, "name"), "name", "left").select("listing_id", "listed_cores", "listed_tdp")


def memory_type_from_cpu(spark, sf):
    """A missing memory type is taken from the processor's entry (names compared without clock and case)."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*@.*$", "")))
    m = read_table(spark, sf, "cpu_ddr_map").where("cpu_name IS NOT NULL").groupBy(key(F.col("cpu_name")).alias("k")).agg(F.max("ddr_type").alias("mapped"))
    a = read_table(spark, sf, "listings").select("listing_id", "RAM_TYPE", key(F.col("mapped_cpu_name")).alias("k"))
    miss = F.coalesce(F.trim("RAM_TYPE"), F.lit("")) == ""
    j = a.join(small(m, "k", "mapped"), "k", "left")
    return j.select("listing_id", F.when(miss, F.col("mapped")).otherwise(F.col("RAM_TYPE")).alias("ram_type"), (miss & F.col("mapped").isNotNull()).alias("filled"))


def cpu_match_cascade(spark, sf):
    """Typed processors: entered correction, else the exact name, else nothing; each distinct text is resolved once."""
    names = read_table(spark, sf, "cpus").select(cpu_key(F.col("name")).alias("k"), F.col("name").alias("exact")).groupBy("k").agg(F.min("exact").alias("exact"))
    fix = read_table(spark, sf, "cpu_corrections").where("canonical_cpu_name IS NOT NULL AND normalized_query IS NOT NULL").groupBy(F.col("normalized_query").alias("k")).agg(F.min("canonical_cpu_name").alias("corrected"))
    typed = read_table(spark, sf, "listings").where("CPU IS NOT NULL").groupBy("CPU").agg(F.count("*").alias("listings")).withColumn("k", cpu_key(F.col("CPU")))
    j = typed.join(small(fix, "k", "corrected"), "k", "left").join(small(names, "k", "exact"), "k", "left")
    kind = F.when(F.col("corrected").isNotNull(), "correction").when(F.col("exact").isNotNull(), "exact").otherwise("none")
    return j.select("CPU", "listings", F.coalesce("corrected", "exact").alias("matched"), kind.alias("match_type"))


def longest_name_contained(spark, sf):
    """The longest card name that a typed text contains (theta join of distinct texts with a checked, small list)."""
    names = read_table(spark, sf, "gpus").where("gpu_name IS NOT NULL").select("gpu_name").distinct()
    texts = read_table(spark, sf, "listings").where("DEDICATED_GPU IS NOT NULL").select("DEDICATED_GPU").distinct()
    # every model number is in a card's name and in a text that contains the name: an equi-join first
    num = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)))).alias("number")
    j = texts.select("DEDICATED_GPU", num(F.col("DEDICATED_GPU"))).join(small(names.select("gpu_name", num(F.col("gpu_name"))), "gpu_name"), "number")
    hit = j.where(F.contains(F.lower("DEDICATED_GPU"), F.lower("gpu_name")))
    return hit.groupBy("DEDICATED_GPU").agg(F.max_by("gpu_name", F.struct(F.length("gpu_name"), F.col("gpu_name"))).alias("gpu_name"))


def used_parts(spark, sf):
    """Listed processors that some listing has, and how many have none (semi and anti join)."""
    cpus, a = read_table(spark, sf, "cpus").select("name"), read_table(spark, sf, "listings").select(F.col("mapped_cpu_name").alias("name")).distinct()
    used, idle = cpus.join(a, "name", "left_semi"), cpus.join(a, "name", "left_anti")
    return used.select("name", F.lit(True).alias("used")).unionByName(idle.select("name", F.lit(False).alias("used")))


def missing_key_worklist(spark, sf):
    """Processors of listings that the memory map lacks, sorted, with blank columns to fill in."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s*@.*$", "")))
    known = read_table(spark, sf, "cpu_ddr_map").select(key(F.col("cpu_name")).alias("k")).distinct()
    a = read_table(spark, sf, "listings").where("mapped_cpu_name IS NOT NULL").select(F.col("mapped_cpu_name").alias("cpu_name"), key(F.col("mapped_cpu_name")).alias("k")).distinct()
    return a.join(known, "k", "left_anti").select("cpu_name", F.lit("").alias("ddr_type"), F.lit("").alias("notes")).orderBy("cpu_name")


def similar_listings(spark, sf):
    """The 20 listings nearest to a wanted machine: scaled Euclidean distance, missing features count 0."""
    want = {"cpu_mark": 30_000.0, "gpu_g3d_mark": 20_000.0, "screen": 15.6, "price": 90_000.0}
    a = ads(spark, sf)
    sd = a.agg(*[F.stddev_pop(c).alias(f"sd_{c}") for c in want])
    d = sum(F.coalesce(F.pow((F.col(c) - F.lit(v)) / F.nullif(F.col(f"sd_{c}"), F.lit(0.0)), 2), F.lit(0.0)) for c, v in want.items())
    near = a.crossJoin(F.broadcast(sd)).select("listing_id", r6(F.sqrt(d)).alias("distance")).distinct()
    return near.orderBy("distance", "listing_id").limit(20)


def first_match_lookup(spark, sf):
    """One row per name of a table with repeated keys: the dearest entry."""
    return read_table(spark, sf, "gpu_prices").where("gpu_name IS NOT NULL").groupBy("gpu_name").agg(F.max("estimated_price").alias("estimated_price"), F.count("*").alias("entries"))


def enriched_request(spark, sf):
    """Requests completed from the part tables; given values win."""
    cpus = read_table(spark, sf, "cpus").select("name")
    req = cpus.withColumn("cores", F.when(F.length("name") % 2 == 0, F.lit(99)))
    full = read_table(spark, sf, "cpus").select("name", F.col("cores").alias("c2"), F.col("tdp"), F.col("gpu_name"))
    gpus = read_table(spark, sf, "gpus").select("gpu_name", F.col("tdp_w"))
    return req.join(small(full, "name"), "name", "left").join(small(gpus, "gpu_name"), "gpu_name", "left").select("name", F.coalesce("cores", "c2").alias("cores"), "tdp", "tdp_w")


def key_sync(spark, sf):
    """Two lists of card names compared: in both with equal price, changed, only here, only there."""
    a = read_table(spark, sf, "gpus").where("gpu_name IS NOT NULL").select("gpu_name", F.md5(F.coalesce(F.col("estimated_price").cast("string"), F.lit("-"))).alias("h1"))
    b = read_table(spark, sf, "gpu_prices").where("gpu_name IS NOT NULL").groupBy("gpu_name").agg(F.max("estimated_price").alias("p")).select("gpu_name", F.md5(F.coalesce(F.col("p").cast("string"), F.lit("-"))).alias("h2"))
    kind = F.when(F.col("h2").isNull(), "only here").when(F.col("h1").isNull(), "only there").when(F.col("h1") == F.col("h2"), "equal").otherwise("changed")
    return a.join(b, "gpu_name", "full").groupBy(kind.alias("outcome")).agg(F.count("*").alias("names"))


def co_located_events(spark, sf):
    """Each listing's documents: a join on the listing key with counts pre-aggregated on the larger side."""
    d = read_table(spark, sf, "documents").where("listing_id IS NOT NULL").groupBy("listing_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    a = read_table(spark, sf, "listings").select("listing_id", "brand").distinct()
    return a.join(d, "listing_id").groupBy("brand").agg(F.sum("documents").alias("documents"), F.sum("chars").alias("chars"))


def star_join_revenue(spark, sf):
    """Revenue per nation and part type over orders and lines: the small dimensions reach the fact table first."""
    t = lambda n: read_table(spark, sf, n)
    cust = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name", "p_type").agg(F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")), 2).cast("double").alias("revenue"), F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (lookup_with_default, lookup_or_null, memory_type_from_cpu, cpu_match_cascade, longest_name_contained, used_parts, missing_key_worklist, similar_listings, first_match_lookup, enriched_request, key_sync, co_located_events, star_join_revenue)}
_KEY = r"lower(trim(regexp_replace({}, '\s*@.*$', '')))"
_CPUKEY = r"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\s*@.*$', ''), 'intel|processor|core|cpu', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
ORACLE = {
    "lookup_with_default": "WITH p AS (SELECT gpu_name, max(estimated_price) AS p FROM gpu_prices WHERE gpu_name IS NOT NULL GROUP BY 1) SELECT listing_id, coalesce(p, 0) AS card_price FROM listings LEFT JOIN p USING (gpu_name)",
    "lookup_or_null": "SELECT listing_id, c.cores AS listed_cores, c.tdp AS listed_tdp FROM listings LEFT JOIN cpus c ON mapped_cpu_name = c.name",
    "memory_type_from_cpu": f"WITH m AS (SELECT {_KEY.format('cpu_name')} AS k, max(ddr_type) AS mapped FROM cpu_ddr_map WHERE cpu_name IS NOT NULL GROUP BY 1) SELECT listing_id, CASE WHEN coalesce(trim(RAM_TYPE), '') = '' THEN mapped ELSE RAM_TYPE END AS ram_type, coalesce(trim(RAM_TYPE), '') = '' AND mapped IS NOT NULL AS filled FROM listings LEFT JOIN m ON {_KEY.format('mapped_cpu_name')} = k",
    "cpu_match_cascade": f"WITH n AS (SELECT {_CPUKEY.format('name')} AS k, min(name) AS exact FROM cpus GROUP BY 1), f AS (SELECT normalized_query AS k, min(canonical_cpu_name) AS corrected FROM cpu_corrections WHERE canonical_cpu_name IS NOT NULL AND normalized_query IS NOT NULL GROUP BY 1), t AS (SELECT CPU, count(*) AS listings, {_CPUKEY.format('CPU')} AS k FROM listings WHERE CPU IS NOT NULL GROUP BY CPU) SELECT CPU, listings, coalesce(corrected, exact) AS matched, CASE WHEN corrected IS NOT NULL THEN 'correction' WHEN exact IS NOT NULL THEN 'exact' ELSE 'none' END AS match_type FROM t LEFT JOIN f USING (k) LEFT JOIN n USING (k)",
    "longest_name_contained": "WITH t AS (SELECT DISTINCT DEDICATED_GPU FROM listings WHERE DEDICATED_GPU IS NOT NULL) SELECT DEDICATED_GPU, gpu_name FROM (SELECT DEDICATED_GPU, gpu_name, row_number() OVER (PARTITION BY DEDICATED_GPU ORDER BY len(gpu_name) DESC, gpu_name DESC) AS r FROM t JOIN (SELECT DISTINCT gpu_name FROM gpus) g ON contains(lower(DEDICATED_GPU), lower(gpu_name))) WHERE r = 1",
    "used_parts": "SELECT name, name IN (SELECT mapped_cpu_name FROM listings WHERE mapped_cpu_name IS NOT NULL) AS used FROM cpus",
    "missing_key_worklist": f"SELECT DISTINCT mapped_cpu_name AS cpu_name, '' AS ddr_type, '' AS notes FROM listings WHERE mapped_cpu_name IS NOT NULL AND {_KEY.format('mapped_cpu_name')} NOT IN (SELECT {_KEY.format('cpu_name')} FROM cpu_ddr_map WHERE cpu_name IS NOT NULL)",
    "similar_listings": _A + ", s AS (SELECT stddev_pop(cpu_mark) AS s1, stddev_pop(gpu_g3d_mark) AS s2, stddev_pop(screen) AS s3, stddev_pop(price) AS s4 FROM a) SELECT DISTINCT listing_id, round(sqrt(coalesce(pow((cpu_mark - 30000) / s1, 2), 0) + coalesce(pow((gpu_g3d_mark - 20000) / s2, 2), 0) + coalesce(pow((screen - 15.6) / s3, 2), 0) + coalesce(pow((price - 90000) / s4, 2), 0)), 6) AS distance FROM a, s ORDER BY distance, listing_id LIMIT 20",
    "first_match_lookup": "SELECT gpu_name, max(estimated_price) AS estimated_price, count(*) AS entries FROM gpu_prices WHERE gpu_name IS NOT NULL GROUP BY 1",
    "enriched_request": "WITH r AS (SELECT name, CASE WHEN len(name) % 2 = 0 THEN 99 END AS cores FROM cpus) SELECT r.name, coalesce(r.cores, c.cores) AS cores, c.tdp, g.tdp_w FROM r LEFT JOIN cpus c ON r.name = c.name LEFT JOIN gpus g ON c.gpu_name = g.gpu_name",
    "key_sync": "WITH b AS (SELECT gpu_name, max(estimated_price) AS p FROM gpu_prices WHERE gpu_name IS NOT NULL GROUP BY 1), j AS (SELECT g.gpu_name AS a, b.gpu_name AS b, g.estimated_price AS x, b.p AS y FROM (SELECT * FROM gpus WHERE gpu_name IS NOT NULL) g FULL JOIN b ON g.gpu_name = b.gpu_name) SELECT CASE WHEN b IS NULL THEN 'only here' WHEN a IS NULL THEN 'only there' WHEN x IS NOT DISTINCT FROM y THEN 'equal' ELSE 'changed' END AS outcome, count(*) AS names FROM j GROUP BY 1",
    "co_located_events": "WITH d AS (SELECT listing_id, count(*) AS documents, sum(n_chars) AS chars FROM documents WHERE listing_id IS NOT NULL GROUP BY 1) SELECT brand, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT DISTINCT listing_id, brand FROM listings) l JOIN d USING (listing_id) GROUP BY 1",
    "star_join_revenue": "SELECT n_name, p_type, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6))), 2) AS DOUBLE) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
}
