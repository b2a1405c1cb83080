"""The composed feature matrix, part resolution, fills without fallback, selections and further reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from souqframe import constants as K
from souqframe.functions import specs as S
from souqframe.functions.listing import memory_type
from souqframe.ml import selection
from souqframe.operators import contracts
from souqframe.operators.ranking import hash_order, hash_ranks
from souqframe.operators.running import running_sum
from souqframe.operators.text_classes import small
from souqframe.plans.cleaning_queries import _RANK, FAMILY_SQL, _capacity_sql, _map_sql, family_words, named_family
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import Workspace, read_table
from souqframe.sources import writers

_A = f"WITH {ADS} "


# -- features ---------------------------------------------------------------------------------------

#: Plausible ends: memory outside becomes missing, a larger drive too, a missing drive counts 0 (fixed values).
MEMORY, LARGEST_DRIVE, USUAL_MONTH = (1.0, 128.0), 16_384.0, 6


def features(a):
    """One projection of the listings' raw columns: clamped capacities, ranks, dates, sums, ratios, logs and flags.

    Optional columns may be absent; what hangs on them is then NULL. Requests of one row take the same path."""
    have = set(a.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    ram = S.capacity_gb(col("RAM_SIZE"))
    drive = lambda c: F.coalesce(F.when(S.capacity_gb(col(c)) <= LARGEST_DRIVE, S.capacity_gb(col(c))), F.lit(0.0))
    posted = col("posted", "timestamp")
    base = a.select(
        col("listing_id", "bigint").alias("listing_id"), F.when(ram.between(*MEMORY), ram).alias("ram_gb"), drive("SSD_SIZE").alias("ssd_gb"), drive("HDD_SIZE").alias("hdd_gb"),
        col("screen", "double").alias("screen"), col("SCREEN_RESOLUTION_ENC", "double").alias("resolution_rank"), col("cpu_mark", "double").alias("cpu_mark"), F.coalesce(col("gpu_g3d_mark", "double"), F.lit(0.0)).alias("gpu_mark"),
        col("tdp", "double").alias("tdp"), col("cores", "double").alias("cores"), S.memory_rank(col("RAM_TYPE")).alias("memory_rank"), S.condition_rank(col("spec_Etat")).alias("condition_rank"),
        F.year(posted).alias("year"), F.coalesce(F.month(posted), F.lit(USUAL_MONTH)).alias("month"), col("brand").alias("brand"), col("price", "double").alias("price"),
        (col("DEDICATED_GPU").isNotNull()).cast("int").alias("has_card"),
    )
    c = F.col
    ratio = lambda x, y: x / F.nullif(y, F.lit(0.0))
    return base.withColumns({
        "storage_gb": c("ssd_gb") + c("hdd_gb"), "has_hdd": (c("hdd_gb") > 0).cast("int"), "is_dual_drive": ((c("hdd_gb") > 0) & (c("ssd_gb") > 0)).cast("int"),
        "marks": c("cpu_mark") + c("gpu_mark"), "mark_product": c("cpu_mark") * c("gpu_mark"), "log_price": F.log1p("price"), "log_cpu_mark": F.log1p("cpu_mark"), "log_storage": F.log1p(c("ssd_gb") + c("hdd_gb")),
        "mark_per_core": ratio(c("cpu_mark"), c("cores")), "mark_per_watt": ratio(c("cpu_mark"), c("tdp")), "gpu_share": ratio(c("gpu_mark"), c("cpu_mark") + c("gpu_mark")), "ram_squared": c("ram_gb") * c("ram_gb"), "ram_times_cores": c("ram_gb") * c("cores"),
        "month_sin": F.sin(c("month") * 2 * F.pi() / 12), "month_cos": F.cos(c("month") * 2 * F.pi() / 12),
    })


_DOUBLES = ("ram_gb", "ssd_gb", "hdd_gb", "screen", "resolution_rank", "cpu_mark", "gpu_mark", "tdp", "cores", "memory_rank", "condition_rank", "storage_gb", "marks", "mark_product", "log_price", "log_cpu_mark", "log_storage", "mark_per_core", "mark_per_watt", "gpu_share", "ram_squared", "ram_times_cores", "month_sin", "month_cos")
_INTS = ("year", "month", "has_card", "has_hdd", "is_dual_drive")
_BASE_SQL = _A + f""", b AS (SELECT listing_id, {_capacity_sql('RAM_SIZE', 12)} AS r0, {_capacity_sql('SSD_SIZE', 12)} AS s0, {_capacity_sql('HDD_SIZE', 12)} AS h0, screen, SCREEN_RESOLUTION_ENC AS resolution_rank, cpu_mark, coalesce(gpu_g3d_mark, 0) AS gpu_mark, tdp, cores, {_RANK} AS memory_rank, {_map_sql('upper(trim(spec_Etat))', K.CONDITION_RANK)} AS condition_rank, CAST(year(posted) AS INT) AS year, CAST(coalesce(month(posted), 6) AS INT) AS month, brand, price, CAST(DEDICATED_GPU IS NOT NULL AS INT) AS has_card FROM a),
f AS (SELECT * EXCLUDE (r0, s0, h0), CASE WHEN r0 BETWEEN 1 AND 128 THEN r0 END AS ram_gb, CASE WHEN s0 <= 16384 THEN s0 ELSE 0 END AS ssd_gb, CASE WHEN h0 <= 16384 THEN h0 ELSE 0 END AS hdd_gb FROM b),
x AS (SELECT *, ssd_gb + hdd_gb AS storage_gb, CAST(hdd_gb > 0 AS INT) AS has_hdd, CAST(hdd_gb > 0 AND ssd_gb > 0 AS INT) AS is_dual_drive, cpu_mark + gpu_mark AS marks, cpu_mark * gpu_mark AS mark_product, ln(1 + price) AS log_price, ln(1 + cpu_mark) AS log_cpu_mark, ln(1 + ssd_gb + hdd_gb) AS log_storage, cpu_mark / nullif(cores, 0) AS mark_per_core, cpu_mark / nullif(tdp, 0) AS mark_per_watt, gpu_mark / nullif(cpu_mark + gpu_mark, 0) AS gpu_share, ram_gb * ram_gb AS ram_squared, ram_gb * cores AS ram_times_cores, sin(month * 2 * pi() / 12) AS month_sin, cos(month * 2 * pi() / 12) AS month_cos FROM f)
SELECT listing_id, {', '.join(f'CAST(round({c}, 5) AS DOUBLE) AS {c}' for c in _DOUBLES)}, {', '.join(_INTS)}, brand FROM x"""


def _rounded(m):
    return m.select("listing_id", *[F.round(c, 5).alias(c) for c in _DOUBLES], *_INTS, "brand")


def feature_matrix(spark, sf):
    """The whole matrix, written as a table and read back."""
    path = f"{Workspace(spark).base}/features"
    writers.write_table(features(ads(spark, sf)), path)
    return _rounded(spark.read.parquet(path))


def request_features(spark, sf):
    """Requests that give a few fields only, every listed processor with 16 GB, through the same projection."""
    r = read_table(spark, sf, "cpus").select("name", F.lit("16GB").alias("RAM_SIZE"), F.lit("512GB+1TB").alias("SSD_SIZE"), F.regexp_replace("cpumark", ",", "").try_cast("double").alias("cpu_mark"), F.col("cores").cast("double").alias("cores"))
    f = features(r.withColumn("listing_id", F.xxhash64("name")))
    return f.join(r.select("name", F.xxhash64("name").alias("listing_id")), "listing_id").select("name", "ram_gb", "storage_gb", "month", r6("mark_per_core").alias("mark_per_core"), "screen", "has_card")


def clamped_share(spark, sf):
    """How many capacities the plausible ends take out."""
    a = read_table(spark, sf, "listings")
    ram, ssd = S.capacity_gb(F.col("RAM_SIZE")), S.capacity_gb(F.col("SSD_SIZE"))
    n = lambda c: F.sum(c.cast("bigint"))
    return a.agg(n(~ram.between(*MEMORY)).alias("memory_out"), n(ssd > LARGEST_DRIVE).alias("drive_out"), n(ssd == 0).alias("drive_zero"))


def first_numbers(spark, sf):
    """The first number of each capacity, NULL if there is none; 1 TB = 1024 GB."""
    def one(c):
        n = F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
        return F.round(n * F.when(F.upper(c).contains("TB"), 1024).otherwise(1), 4)
    return read_table(spark, sf, "listings").select("listing_id", *[one(F.col(c)).alias(c.lower()) for c in ("RAM_SIZE", "SSD_SIZE")])


def price_ratio_scale(spark, sf):
    """A price moved by powers of ten until it is within a factor of eight of its brand's median; zero and unknown stay."""
    a = ads(spark, sf).select("listing_id", "brand", F.col("price_corrected").alias("raw"), "price")
    m = a.where("price IS NOT NULL").groupBy("brand").agg(F.median("price").alias("expected"))
    j = a.join(F.broadcast(m), "brand", "left")
    ok = (F.col("raw") > 0) & (F.col("expected") > 0)
    ratio = F.log10(F.col("raw") / F.col("expected"))
    down, up = F.ceil(ratio - F.log10(F.lit(8.0)) + F.lit(1e-12)), F.ceil(-ratio - F.log10(F.lit(8.0)) + F.lit(1e-12))
    steps = F.when(ok, F.when(ratio >= F.log10(F.lit(8.0)), -F.greatest(down, F.lit(1))).when(ratio <= -F.log10(F.lit(8.0)), F.greatest(up, F.lit(1))).otherwise(0)).otherwise(0).cast("int")
    return j.select("listing_id", steps.alias("steps"), F.round(F.col("raw") * F.pow(F.lit(10.0), steps), 4).alias("value"))


# -- parts --------------------------------------------------------------------------------------------

_NAME = r"^(\S+) (\S+) ([0-9A-Za-z])[- ](\d+)([A-Za-z]+\d?)"


def part_names(spark, sf):
    """Maker, family, tier, number, suffix and generation of every listed processor."""
    g = lambda i: F.nullif(F.regexp_extract("name", _NAME, i), F.lit(""))
    n = g(4).try_cast("bigint")
    return read_table(spark, sf, "cpus").where("name IS NOT NULL").select("name", g(1).alias("maker"), g(2).alias("family"), g(3).alias("tier"), n.alias("number"), g(5).alias("suffix"), S.generation(n, 0, 99).alias("generation"))


def generic_processors(spark, sf):
    """Typed processors that name a family and perhaps a tier but no model: (family, tier, number of texts)."""
    t = read_table(spark, sf, "listings").where("CPU IS NOT NULL").groupBy("CPU").agg(F.count("*").alias("n"))
    t = t.where(F.regexp_extract("CPU", r"(\d{3,})", 1) == "")
    named = named_family(t, "CPU", family_words(spark, sf))
    tier = F.nullif(F.regexp_extract("CPU", r"(?:^|[^0-9.])(\d)(?:[^0-9.]|$)", 1), F.lit(""))
    return t.join(small(named, "CPU"), "CPU").groupBy("family", tier.alias("tier")).agg(F.sum("n").alias("listings"))


def common_processor(spark, sf):
    """For each family, tier and generation the processor most listings have, joined back to all parts of the kind."""
    p = part_names(spark, sf).where("number IS NOT NULL").select("name", "family", "tier", "generation")
    used = read_table(spark, sf, "listings").where("mapped_cpu_name IS NOT NULL").groupBy(F.col("mapped_cpu_name").alias("name")).agg(F.count("*").alias("n"))
    per = p.join(small(used, "name"), "name").groupBy("family", "tier", "generation").agg(F.min(F.struct((-F.col("n")).alias("n"), "name"))["name"].alias("common"))
    return p.join(small(per, "common"), ["family", "tier", "generation"], "left").select("name", "common")


#: Words that say nothing about a card (fixed values).
CARD_NOISE = ("carte", "graphique", "graphics", "gpu", "cg", "card", "go", "gb")


def plain_cards(spark, sf):
    """Distinct card texts without noise words, sizes and punctuation."""
    t = F.regexp_replace(F.lower("DEDICATED_GPU"), r"[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"\b\d{1,2} ?(gb|go|g)\b", " ")
    t = F.regexp_replace(t, r"\b(" + "|".join(CARD_NOISE) + r")\b", " ")
    return read_table(spark, sf, "listings").where("DEDICATED_GPU IS NOT NULL").select("DEDICATED_GPU").distinct().select("DEDICATED_GPU", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("plain"))


def card_cascade(spark, sf):
    """The card of a listing: the mapped one, else the one its processor's entry has, else none; with the step."""
    a = read_table(spark, sf, "listings").select("listing_id", "gpu_name", F.col("mapped_cpu_name").alias("name"))
    inferred = read_table(spark, sf, "cpus").where("name IS NOT NULL").select("name", F.col("gpu_name").alias("inferred"))
    j = a.join(small(inferred, "name"), "name", "left")
    step = F.when(F.col("gpu_name").isNotNull(), "mapped").when(F.col("inferred").isNotNull(), "from processor").otherwise("none")
    return j.select("listing_id", F.coalesce("gpu_name", "inferred").alias("card"), step.alias("step"))


# -- fills, groups --------------------------------------------------------------------------------------


def model_fill_only(spark, sf):
    """Resolution from the mode of the model alone: models without any stay empty."""
    a = read_table(spark, sf, "listings").select("listing_id", "model_name", "SCREEN_RESOLUTION_STD")
    per = a.where("SCREEN_RESOLUTION_STD IS NOT NULL").groupBy("model_name").agg(F.mode("SCREEN_RESOLUTION_STD", True).alias("m"))
    return a.join(per, "model_name", "left").select("listing_id", F.coalesce("SCREEN_RESOLUTION_STD", "m").alias("resolution"))


def screen_fill_by_processor(spark, sf):
    """A missing screen takes the most frequent of the processor, else what the model's name says."""
    a = ads(spark, sf).select("listing_id", "mapped_cpu_name", "model_name", "screen")
    per = a.where("screen IS NOT NULL AND mapped_cpu_name IS NOT NULL").groupBy("mapped_cpu_name").agg(F.mode("screen", True).alias("m"))
    said = F.regexp_extract("model_name", r"\b(1[0-9])\b", 1).try_cast("double")
    return a.join(small(per, "mapped_cpu_name"), "mapped_cpu_name", "left").select("listing_id", F.coalesce("screen", "m", said).alias("screen"), F.when(F.col("screen").isNotNull(), "own").when(F.col("m").isNotNull(), "processor").when(said.isNotNull(), "name").otherwise("none").alias("method"))


def mean_by_rank(spark, sf):
    """Mean price along an ordinal: condition and memory generation."""
    a = ads(spark, sf).where("price IS NOT NULL")
    one = lambda kind, c: a.groupBy(c.alias("rank")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 3).alias("mean_price")).where("rank IS NOT NULL").withColumn("kind", F.lit(kind))
    return one("condition", S.condition_rank(F.col("spec_Etat"))).unionByName(one("memory", S.memory_rank(F.col("RAM_TYPE"))))


def model_tiers(spark, sf):
    """Models in tiers by mean price, joined back to their listings and counted with their mean mark."""
    a = ads(spark, sf).where("price IS NOT NULL AND model_name IS NOT NULL").select("listing_id", "model_name", "price", "cpu_mark")
    t = a.groupBy("model_name").agg(F.avg("price").alias("p")).select("model_name", F.when(F.col("p") >= 120_000, "high").when(F.col("p") >= 60_000, "middle").otherwise("entry").alias("tier"))
    return a.join(t, "model_name").groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("model_name").alias("models"), F.round(F.avg("cpu_mark"), 3).alias("mean_mark"))


def aligned_columns(spark, sf):
    """Two tables of the same rows joined on their key: rows only in one, and values that differ."""
    a = read_table(spark, sf, "listings").select("listing_id", F.col("price_preview").alias("x")).distinct()
    b = ads(spark, sf).select("listing_id", F.col("price_preview").alias("y")).distinct()
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "listing_id", "full")
    far = F.abs(F.when(~F.isnan("x"), F.col("x")) - F.col("y")) > 1e-9
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    return j.agg(F.count("*").alias("rows"), n(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"), n(far).alias("different"))


def column_kinds(spark, sf):
    """Columns of the listings by kind of type."""
    kind = lambda t: "number" if t in ("bigint", "double", "int") else "time" if t.startswith("timestamp") else "text"
    return spark.createDataFrame([(c, kind(t)) for c, t in read_table(spark, sf, "listings").dtypes], "column_name string, kind string")


# -- selections -----------------------------------------------------------------------------------------


def other_brands(spark, sf):
    """Listings of none of the three largest brands (negated membership)."""
    a = read_table(spark, sf, "listings")
    top = [r.brand for r in a.where("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(3).collect()]
    return a.where(~F.col("brand").isin(*top)).groupBy("brand").agg(F.count("*").alias("n"))


def deals_below(spark, sf):
    """The thirty listings of one brand below a price, by mark per dinar."""
    a = ads(spark, sf).where("brand = 'DAILOU' AND price <= 90000 AND cpu_mark IS NOT NULL").select("listing_id", "price", r6(F.col("cpu_mark") / F.col("price")).alias("value")).distinct()
    return a.orderBy(F.desc("value"), "listing_id").limit(30)


def first_complete(spark, sf):
    """The first 18 listings by id that name brand and processor."""
    return read_table(spark, sf, "listings").where("brand IS NOT NULL AND CPU IS NOT NULL").select("listing_id", "brand", "CPU").distinct().orderBy("listing_id", "CPU").limit(18)


def random_split(spark, sf):
    """70 / 15 / 15 by rank in hash order."""
    x = read_table(spark, sf, "listings").select("listing_id").distinct().withColumn("_all", F.lit(0))
    n = x.count()
    r = hash_ranks(x, ["_all"], "listing_id", 42)
    return r.groupBy(F.when(F.col("rank") <= int(n * 0.7), "train").when(F.col("rank") <= int(n * 0.85), "val").otherwise("test").alias("split")).agg(F.count("*").alias("rows"), F.sum("listing_id").alias("ids"))


def row_order_split(spark, sf):
    """The first 80 % of ids train, the rest tests; ranks come from counts of id ranges."""
    x = read_table(spark, sf, "listings").select("listing_id").distinct()
    n, top = x.agg(F.count("*"), F.max("listing_id")).first()
    # ids spread over the order's whole range, so that slices stay small
    order = ((F.col("listing_id") / F.lit(float(max(top, 1))) - 0.5) * 1.8e19).cast("bigint")
    r = running_sum(x.withColumn("_all", F.lit(0)).withColumn("_o", order).withColumn("_one", F.lit(1).cast("bigint")), ["_all"], "_o", "_one", "rank", tie=["listing_id"])
    return r.groupBy(F.when(F.col("rank") <= int(n * 0.8), "train").otherwise("test").alias("split")).agg(F.count("*").alias("rows"), F.min("listing_id").alias("first"), F.max("listing_id").alias("last"))


def hand_labels(spark, sf):
    """A label file written, read back by its key and scored against a price flag."""
    a = ads(spark, sf).where("price IS NOT NULL").groupBy("listing_id").agg(F.max("price").alias("price"))
    labels = a.where(hash_order(F.col("listing_id"), F.lit(3)) % 50 == 0).select("listing_id", (F.col("listing_id") % 3 == 0).cast("int").alias("label"))
    path = f"{Workspace(spark).base}/labels"
    writers.write_table(labels, path, kind="csv")
    back = spark.read.schema("listing_id bigint, label int").option("header", True).csv(path)
    j = back.join(a, "listing_id").withColumn("flag", (F.col("price") > 150_000).cast("int"))
    n = lambda c: F.sum(c.cast("bigint"))
    return j.agg(F.count("*").alias("labelled"), n((F.col("flag") == 1) & (F.col("label") == 1)).alias("hits"), n(F.col("flag") == 1).alias("flagged"), n(F.col("label") == 1).alias("positives"))


# -- reports --------------------------------------------------------------------------------------------


def request_errors(spark, sf):
    """Every request (a listing's fields) with all rules it breaks."""
    c = contracts
    rules = [c.required("brand"), c.in_range("cores", 1, 32), c.in_range("screen", 11, 18), c.one_of("spec_Etat", "MOYEN", "BON TAT", "JAMAIS UTILIS"), c.in_range("tdp", 5, 150)]
    broken = F.array_compact(F.array(*[F.when(r.broken, F.lit(f"{r.column}: {r.name}")) for r in rules]))
    return ads(spark, sf).select("listing_id", F.array_join(F.array_sort(broken), "; ").alias("errors")).where("errors <> ''").distinct()


def segment_gain(spark, sf):
    """Per brand: median error in percent of the brand's own median against that of the overall one, and the gain."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL").select("listing_id", "brand", "price").distinct()
    own = a.groupBy("brand").agg(F.median("price").alias("own"))
    j = a.join(F.broadcast(own), "brand").crossJoin(F.broadcast(a.agg(F.median("price").alias("whole"))))
    err = lambda p: F.median(F.abs(F.col(p) - F.col("price")) / F.col("price")) * 100
    e = j.groupBy("brand").agg(F.count("*").alias("n"), err("own").alias("s"), err("whole").alias("g"))
    return e.select("brand", "n", r6("s").alias("specialist"), r6("g").alias("generalist"), r6(F.col("g") - F.col("s")).alias("gain")).orderBy(F.desc("gain"), "brand")


def half_band(spark, sf):
    """A 50 % band around each brand's median: point times exp(-+ factor times the clipped spread of logs)."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL").select("listing_id", "brand", "price").distinct()
    p = a.groupBy("brand").agg(F.median("price").alias("point"), F.stddev_pop(F.log("price")).alias("s")).withColumn("w", F.greatest(F.least("s", F.lit(0.25)), F.lit(0.05)))
    j = a.join(F.broadcast(p), "brand").withColumns({"low": F.col("point") * F.exp(-0.554 * F.col("w")), "high": F.col("point") * F.exp(1.21 * F.col("w"))})
    return j.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.max("low"), 3).alias("low"), F.round(F.max("high"), 3).alias("high"), r6(F.avg(F.col("price").between(F.col("low"), F.col("high")).cast("int"))).alias("inside"))


def oddity_checks(spark, sf):
    """Every priced listing's oddity in 0..1, from its distance to the brand's median on the log scale, with reasons."""
    a = ads(spark, sf).where("price IS NOT NULL AND brand IS NOT NULL").select("listing_id", "brand", "price", "cpu_mark").distinct()
    m = a.groupBy("brand").agg(F.median("price").alias("m"))
    s = a.join(F.broadcast(m), "brand").withColumn("raw", -F.abs(F.log(F.col("price") / F.col("m"))) / 4)
    score = F.greatest(F.least(1 - (F.col("raw") + 0.5) / 0.5, F.lit(1.0)), F.lit(0.0))
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("price") > 3 * F.col("m"), "dear"), F.when(F.col("price") < F.col("m") / 3, "cheap"), F.when(F.col("cpu_mark").isNull(), "no mark"))), ",")
    return s.select("listing_id", r6(score).alias("score"), reasons.alias("reasons"))


def service_catalog(spark, sf):
    """What a service would list: tables with rows, and distinct values of the fields it offers."""
    t = lambda n: read_table(spark, sf, n)
    rows = [t(n).agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), F.lit(n).alias("name"), "n") for n in ("listings", "cpus", "gpus")]
    values = [t("listings").agg(F.count_distinct(c).alias("n")).select(F.lit("values").alias("kind"), F.lit(c).alias("name"), "n") for c in ("brand", "city_grouped", "spec_Etat")]
    return reduce(lambda x, y: x.unionByName(y), [*rows, *values])


def memory_classes(spark, sf):
    """Listings per memory generation however written."""
    return read_table(spark, sf, "listings").groupBy(F.coalesce(memory_type(F.col("RAM_TYPE")), F.lit("UNKNOWN")).alias("memory")).agg(F.count("*").alias("n"))


def shared_values(spark, sf):
    """Words that a processor's typed and mapped name share (intersection of arrays)."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    a = read_table(spark, sf, "listings").where("CPU IS NOT NULL AND mapped_cpu_name IS NOT NULL").select("CPU", "mapped_cpu_name").distinct()
    return a.select("CPU", "mapped_cpu_name", F.array_join(F.array_sort(F.array_intersect(words("CPU"), words("mapped_cpu_name"))), " ").alias("shared"))


# -- model choice -----------------------------------------------------------------------------------------


def time_folds(spark, sf):
    """Expanding windows: each year is tested on all earlier ones."""
    a = ads(spark, sf).where("price IS NOT NULL AND posted IS NOT NULL").select("listing_id", "price", F.year("posted").alias("y")).distinct()
    per = a.groupBy("y").agg(F.count("*").alias("n"))
    years = F.broadcast(per.select(F.col("y").alias("test_year")))  # a row a year
    return per.join(years, F.col("y") <= F.col("test_year")).groupBy("test_year").agg(F.coalesce(F.sum(F.when(F.col("y") < F.col("test_year"), F.col("n"))), F.lit(0)).alias("train"), F.sum(F.when(F.col("y") == F.col("test_year"), F.col("n"))).alias("test")).where("train > 0")


_CHOICE = ["cpu_mark", "gpu_mark", "ram_gb", "ssd_gb", "screen", "resolution_rank"]


def _choice_rows(spark, sf):
    f = features(ads(spark, sf).where("price IS NOT NULL")).select("listing_id", "log_price", *_CHOICE).na.fill(0.0).distinct()
    return Workspace(spark).stage(f.withColumn("part", hash_order(F.col("listing_id"), F.lit(42)) % 5), "rows")


def model_grid(spark, sf):
    """A grid of linear models on log price, cross-validated, with the best marked."""
    return spark.createDataFrame(selection.grid_search(_choice_rows(spark, sf), _CHOICE, "log_price", [0.001, 0.1], [0.0, 1.0]), "penalty double, mix double, rmse double, best boolean")


def dropped_features(spark, sf):
    """Backward selection from six features to three."""
    return spark.createDataFrame(selection.backward_selection(_choice_rows(spark, sf), _CHOICE, "log_price", 3), "step int, dropped string, r2 double")


def balanced_clusters(spark, sf):
    """The number of clusters by silhouette and balance."""
    return spark.createDataFrame(selection.balanced_k(read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", [4, 8, 12]), "k int, silhouette double, imbalance double, score double, best boolean")


def cluster_stability(spark, sf):
    """Agreement of clusterings of random parts with that of all vectors."""
    return spark.createDataFrame(selection.stability(read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 8), "run int, agreement double")


QUERIES = {
    f.__name__: f
    for f in (feature_matrix, request_features, clamped_share, first_numbers, price_ratio_scale, part_names, generic_processors, common_processor, plain_cards, card_cascade, model_fill_only, screen_fill_by_processor, mean_by_rank, model_tiers, aligned_columns, column_kinds, other_brands, deals_below, first_complete, random_split, row_order_split, hand_labels, request_errors, segment_gain, half_band, oddity_checks, service_catalog, memory_classes, shared_values, time_folds, model_grid, dropped_features, balanced_clusters, cluster_stability)
}
_HASH = "CAST(('0x' || substr(md5(concat_ws('|', listing_id, {})), 1, 15)) AS BIGINT)"
_FIRST = r"round(try_cast(nullif(regexp_extract({c}, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) * CASE WHEN contains(upper({c}), 'TB') THEN 1024 ELSE 1 END, 4) AS {o}"
_PARTS = r"p AS (SELECT name, nullif(regexp_extract(name, '{n}', 1), '') AS maker, nullif(regexp_extract(name, '{n}', 2), '') AS family, nullif(regexp_extract(name, '{n}', 3), '') AS tier, try_cast(nullif(regexp_extract(name, '{n}', 4), '') AS BIGINT) AS number, nullif(regexp_extract(name, '{n}', 5), '') AS suffix FROM cpus WHERE name IS NOT NULL)".replace("{n}", _NAME)
_GENERATION = "CASE WHEN number IS NOT NULL THEN greatest(least(CAST(floor(number / 1000) AS INT), 99), 0) END AS generation"
_PRICED = ", d AS (SELECT DISTINCT listing_id, brand, price FROM a WHERE price IS NOT NULL AND brand IS NOT NULL)"
_MEMORY = r"nullif(regexp_extract(upper(regexp_replace(RAM_TYPE, '[^A-Za-z0-9]+', '', 'g')), '^((?:LP|G)?DDR\d[LX]?)', 1), '')"
ORACLE = {
    "feature_matrix": _BASE_SQL,
    "request_features": "SELECT name, 16.0::DOUBLE AS ram_gb, 1512.0::DOUBLE AS storage_gb, 6 AS month, round(try_cast(replace(cpumark, ',', '') AS DOUBLE) / nullif(cores, 0), 6) AS mark_per_core, NULL::DOUBLE AS screen, 0 AS has_card FROM cpus",
    "clamped_share": f"WITH c AS (SELECT {_capacity_sql('RAM_SIZE', 12)} AS r, {_capacity_sql('SSD_SIZE', 12)} AS s FROM listings) SELECT count(*) FILTER (NOT r BETWEEN 1 AND 128) AS memory_out, count(*) FILTER (s > 16384) AS drive_out, count(*) FILTER (s = 0) AS drive_zero FROM c",
    "first_numbers": f"SELECT listing_id, {_FIRST.format(c='RAM_SIZE', o='ram_size')}, {_FIRST.format(c='SSD_SIZE', o='ssd_size')} FROM listings",
    "price_ratio_scale": _A + ", m AS (SELECT brand, median(price) AS e FROM a WHERE price IS NOT NULL GROUP BY 1), j AS (SELECT listing_id, price_corrected AS raw, CASE WHEN price_corrected > 0 AND e > 0 THEN log10(price_corrected / e) END AS r FROM a LEFT JOIN m ON a.brand = m.brand), k AS (SELECT listing_id, raw, CAST(CASE WHEN r IS NULL THEN 0 WHEN r >= log10(8) THEN -greatest(ceil(r - log10(8) + 1e-12), 1) WHEN r <= -log10(8) THEN greatest(ceil(-r - log10(8) + 1e-12), 1) ELSE 0 END AS INT) AS steps FROM j) SELECT listing_id, steps, round(raw * pow(10.0, steps), 4) AS value FROM k",
    "part_names": f"WITH {_PARTS} SELECT *, {_GENERATION} FROM p",
    "generic_processors": "WITH " + FAMILY_SQL.format(name="name", table="cpus", text="CPU") + r" SELECT family, nullif(regexp_extract(CPU, '(?:^|[^0-9.])(\d)(?:[^0-9.]|$)', 1), '') AS tier, count(*) AS listings FROM listings JOIN fam USING (CPU) WHERE NOT regexp_matches(CPU, '\d{3,}') GROUP BY 1, 2",
    "common_processor": f"WITH {_PARTS}, q AS (SELECT name, family, tier, {_GENERATION} FROM p WHERE number IS NOT NULL), u AS (SELECT mapped_cpu_name AS name, count(*) AS n FROM listings GROUP BY 1), c AS (SELECT family, tier, generation, name AS common, row_number() OVER (PARTITION BY family, tier, generation ORDER BY n DESC, name) AS r FROM q JOIN u USING (name)) SELECT name, common FROM q LEFT JOIN (SELECT * FROM c WHERE r = 1) USING (family, tier, generation)",
    "plain_cards": r"SELECT DISTINCT DEDICATED_GPU, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(DEDICATED_GPU), '[^a-z0-9]+', ' ', 'g'), '\b\d{1,2} ?(gb|go|g)\b', ' ', 'g'), '\b(" + "|".join(CARD_NOISE) + r")\b', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM listings WHERE DEDICATED_GPU IS NOT NULL",
    "card_cascade": "SELECT listing_id, coalesce(l.gpu_name, c.gpu_name) AS card, CASE WHEN l.gpu_name IS NOT NULL THEN 'mapped' WHEN c.gpu_name IS NOT NULL THEN 'from processor' ELSE 'none' END AS step FROM listings l LEFT JOIN cpus c ON l.mapped_cpu_name = c.name",
    "model_fill_only": "WITH m AS (SELECT model_name, SCREEN_RESOLUTION_STD AS m, row_number() OVER (PARTITION BY model_name ORDER BY count(*) DESC, SCREEN_RESOLUTION_STD) AS r FROM listings WHERE SCREEN_RESOLUTION_STD IS NOT NULL AND model_name IS NOT NULL GROUP BY 1, 2) SELECT listing_id, coalesce(SCREEN_RESOLUTION_STD, m) AS resolution FROM listings LEFT JOIN m ON m.model_name = listings.model_name AND r = 1",
    "screen_fill_by_processor": _A + r", m AS (SELECT mapped_cpu_name, screen AS m, row_number() OVER (PARTITION BY mapped_cpu_name ORDER BY count(*) DESC, screen) AS r FROM a WHERE screen IS NOT NULL AND mapped_cpu_name IS NOT NULL GROUP BY 1, 2), j AS (SELECT listing_id, screen, m, try_cast(nullif(regexp_extract(model_name, '\b(1[0-9])\b', 1), '') AS DOUBLE) AS s FROM a LEFT JOIN m ON m.mapped_cpu_name = a.mapped_cpu_name AND r = 1) SELECT listing_id, coalesce(screen, m, s) AS screen, CASE WHEN screen IS NOT NULL THEN 'own' WHEN m IS NOT NULL THEN 'processor' WHEN s IS NOT NULL THEN 'name' ELSE 'none' END AS method FROM j",
    "mean_by_rank": _A + f", c AS (SELECT 'condition' AS kind, CAST({_map_sql('upper(trim(spec_Etat))', K.CONDITION_RANK)} AS DOUBLE) AS rank, price FROM a UNION ALL SELECT 'memory', CAST({_RANK} AS DOUBLE), price FROM a) SELECT kind, rank, count(*) AS n, round(avg(price), 3) AS mean_price FROM c WHERE price IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2",
    "model_tiers": _A + ", d AS (SELECT listing_id, model_name, price, cpu_mark FROM a WHERE price IS NOT NULL AND model_name IS NOT NULL), t AS (SELECT model_name, CASE WHEN avg(price) >= 120000 THEN 'high' WHEN avg(price) >= 60000 THEN 'middle' ELSE 'entry' END AS tier FROM d GROUP BY 1) SELECT tier, count(*) AS n, count(DISTINCT model_name) AS models, round(avg(cpu_mark), 3) AS mean_mark FROM d JOIN t USING (model_name) GROUP BY 1",
    "aligned_columns": "SELECT count(*) AS rows, 0 AS unmatched, 0 AS different FROM (SELECT DISTINCT listing_id, price_preview FROM listings)",
    "column_kinds": "SELECT column_name, CASE WHEN column_type IN ('BIGINT', 'DOUBLE', 'INTEGER') THEN 'number' WHEN starts_with(column_type, 'TIMESTAMP') THEN 'time' ELSE 'text' END AS kind FROM (DESCRIBE listings)",
    "other_brands": "SELECT brand, count(*) AS n FROM listings WHERE brand NOT IN (SELECT brand FROM listings WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 3) GROUP BY 1",
    "deals_below": _A + "SELECT DISTINCT listing_id, price, round(cpu_mark / price, 6) AS value FROM a WHERE brand = 'DAILOU' AND price <= 90000 AND cpu_mark IS NOT NULL ORDER BY value DESC, listing_id LIMIT 30",
    "first_complete": "SELECT DISTINCT listing_id, brand, CPU FROM listings WHERE brand IS NOT NULL AND CPU IS NOT NULL ORDER BY listing_id, CPU LIMIT 18",
    "random_split": f"WITH d AS (SELECT DISTINCT listing_id FROM listings), r AS (SELECT listing_id, row_number() OVER (ORDER BY {_HASH.format(42)}, listing_id) AS k, count(*) OVER () AS n FROM d) SELECT CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split, count(*) AS rows, CAST(sum(listing_id) AS BIGINT) AS ids FROM r GROUP BY 1",
    "row_order_split": "WITH d AS (SELECT DISTINCT listing_id FROM listings), r AS (SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS k, count(*) OVER () AS n FROM d) SELECT CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(listing_id) AS first, max(listing_id) AS last FROM r GROUP BY 1",
    "hand_labels": _A + f", p AS (SELECT listing_id, max(price) AS price FROM a WHERE price IS NOT NULL GROUP BY 1), l AS (SELECT listing_id, listing_id % 3 = 0 AS label, price > 150000 AS flag FROM p WHERE {_HASH.format(3)} % 50 = 0) SELECT count(*) AS labelled, count(*) FILTER (flag AND label) AS hits, count(*) FILTER (flag) AS flagged, count(*) FILTER (label) AS positives FROM l",
    "request_errors": _A + ", e AS (SELECT listing_id, array_to_string(list_sort(list_filter([CASE WHEN brand IS NULL THEN 'brand: present' END, CASE WHEN NOT cores BETWEEN 1 AND 32 THEN 'cores: between 1 and 32' END, CASE WHEN NOT screen BETWEEN 11 AND 18 THEN 'screen: between 11 and 18' END, CASE WHEN spec_Etat NOT IN ('MOYEN', 'BON TAT', 'JAMAIS UTILIS') THEN 'spec_Etat: one of MOYEN, BON TAT, JAMAIS UTILIS' END, CASE WHEN NOT tdp BETWEEN 5 AND 150 THEN 'tdp: between 5 and 150' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM a) SELECT DISTINCT listing_id, errors FROM e WHERE errors <> ''",
    "segment_gain": _A + _PRICED + ", o AS (SELECT brand, median(price) AS own FROM d GROUP BY 1), w AS (SELECT median(price) AS whole FROM d), e AS (SELECT brand, count(*) AS n, median(abs(own - price) / price) * 100 AS s, median(abs(whole - price) / price) * 100 AS g FROM d JOIN o USING (brand), w GROUP BY 1) SELECT brand, n, round(s, 6) AS specialist, round(g, 6) AS generalist, round(g - s, 6) AS gain FROM e",
    "half_band": _A + _PRICED + ", p AS (SELECT brand, median(price) AS point, greatest(least(stddev_pop(ln(price)), 0.25), 0.05) AS w FROM d GROUP BY 1), j AS (SELECT brand, price, point * exp(-0.554 * w) AS lo, point * exp(1.21 * w) AS hi FROM d JOIN p USING (brand)) SELECT brand, count(*) AS n, round(max(lo), 3) AS low, round(max(hi), 3) AS high, round(avg(CAST(price BETWEEN lo AND hi AS INT)), 6) AS inside FROM j GROUP BY 1",
    "oddity_checks": _A + ", d AS (SELECT DISTINCT listing_id, brand, price, cpu_mark FROM a WHERE price IS NOT NULL AND brand IS NOT NULL), m AS (SELECT brand, median(price) AS m FROM d GROUP BY 1) SELECT listing_id, round(greatest(least(1 - (-abs(ln(price / m)) / 4 + 0.5) / 0.5, 1.0), 0.0), 6) AS score, concat_ws(',', CASE WHEN price > 3 * m THEN 'dear' END, CASE WHEN price < m / 3 THEN 'cheap' END, CASE WHEN cpu_mark IS NULL THEN 'no mark' END) AS reasons FROM d JOIN m USING (brand)",
    "service_catalog": " UNION ALL ".join([f"SELECT 'rows' AS kind, '{t}' AS name, count(*) AS n FROM {t}" for t in ("listings", "cpus", "gpus")] + [f"SELECT 'values', '{c}', count(DISTINCT {c}) FROM listings" for c in ("brand", "city_grouped", "spec_Etat")]),
    "memory_classes": f"SELECT coalesce({_MEMORY}, 'UNKNOWN') AS memory, count(*) AS n FROM listings GROUP BY 1",
    "shared_values": "SELECT DISTINCT CPU, mapped_cpu_name, array_to_string(list_sort(list_intersect(regexp_extract_all(lower(CPU), '[a-z0-9]+'), regexp_extract_all(lower(mapped_cpu_name), '[a-z0-9]+'))), ' ') AS shared FROM listings WHERE CPU IS NOT NULL AND mapped_cpu_name IS NOT NULL",
    "time_folds": _A + ", d AS (SELECT DISTINCT listing_id, price, CAST(year(posted) AS INT) AS y FROM a WHERE price IS NOT NULL AND posted IS NOT NULL), p AS (SELECT y, count(*) AS n FROM d GROUP BY 1) SELECT y AS test_year, CAST(sum(n) OVER (ORDER BY y) - n AS BIGINT) AS train, n AS test FROM p QUALIFY train > 0",
}
