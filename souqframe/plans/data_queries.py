"""Queries of the general data operators (missing values, units)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souqframe.functions.capacity import dinar_unit, joke_price, quantities
from souqframe.functions.dates import instant
from souqframe.functions.listing import finite, memory_type, number, real_screen
from souqframe.operators import impute
from souqframe.operators.text_classes import small, text_classes
from souqframe.operators.units import Units, segment, stretches
from souqframe.session import Workspace, read_table


def with_model_class(ads: DataFrame, column: str, out: str) -> DataFrame:
    """Add the class of a typed name: equal up to case, spacing, punctuation and order of words."""
    ws = Workspace(ads.sparkSession)
    distinct = ads.select(F.lit(0).alias("field"), F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    names = ws.stage(text_classes(distinct, ws).select(F.col("value").alias(column), F.nullif("label", F.lit("")).alias(out)), "models")
    return ads.join(small(names, column, out), column, "left")


def _filled(spark: SparkSession, sf: str, hide: bool = False, **how) -> DataFrame:
    """Both fields of every listing; with ``hide`` a tenth of the known cells is first taken away."""
    ads = read_table(spark, sf, "listings").select("listing_id", "model_name", "brand", "SCREEN_SIZE_SNAPPED", "RAM_TYPE", "SCREEN_RESOLUTION_STD", "cpu_mark", "tdp", "gpu_g3d_mark", "price_corrected", "created_at")
    ads = with_model_class(ads, "model_name", "model_class")
    screen, memory = real_screen(F.col("SCREEN_SIZE_SNAPPED")), memory_type(F.col("RAM_TYPE"))
    if hide:
        screen, memory = F.when(~_hidden("SCREEN_SIZE_SNAPPED"), screen), F.when(~_hidden("RAM_TYPE"), memory)
    price = finite(F.col("price_corrected"))
    # what is to be filled takes no part: a record without it could only be put wrong by it
    numbers = {
        "cpu_mark": number(F.col("cpu_mark")),
        "tdp": finite(F.col("tdp")),
        "log_price": F.when(price > 0, F.log10(price)),
        "year": F.year(instant(F.col("created_at"))),
    }
    cats = {"resolution": F.col("SCREEN_RESOLUTION_STD"), "brand": F.col("brand")}
    targets = {"SCREEN_SIZE_SNAPPED": (screen, True), "RAM_TYPE": (memory, False)}
    return impute.fill(ads, "listing_id", targets, F.col("model_class"), F.col("brand"), numbers, cats, **how)


def _hidden(field: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(field), F.col("listing_id")), F.lit(10)) == 0


def p2_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Known cells hidden, filled again and compared, per field and step: share right, and the share right if one
    cluster held all listings (the plain median or mode of the model, then of the brand)."""
    ws = Workspace(spark)
    ads = read_table(spark, sf, "listings")
    known = lambda f, c: ads.where(_hidden(f) & c.isNotNull()).select("listing_id", F.lit(f).alias("field_name"), c.cast("string").alias("truth"))
    truth = known("SCREEN_SIZE_SNAPPED", real_screen(F.col("SCREEN_SIZE_SNAPPED"))).unionByName(known("RAM_TYPE", memory_type(F.col("RAM_TYPE")))).distinct()
    got = ws.stage(_filled(spark, sf, True).where("filled").select("listing_id", "field_name", "value", "method").distinct(), "filled")
    plain = ws.stage(_filled(spark, sf, True, k=1, passes=0).where("filled").select("listing_id", "field_name", F.col("value").alias("plain")).distinct(), "plain")
    j = truth.join(got, ["listing_id", "field_name"]).join(plain, ["listing_id", "field_name"])
    share = lambda c: F.round(F.avg((F.col(c) == F.col("truth")).cast("int")), 4)
    return j.groupBy("field_name", "method").agg(F.count("*").alias("cells"), share("value").alias("right"), share("plain").alias("plain_right"))


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counted over all cells: rows per field, real values changed, cells left without a value, cells not marked."""
    f = Workspace(spark).stage(_filled(spark, sf), "filled")
    ads = read_table(spark, sf, "listings")
    real = F.when(F.col("field_name") == "RAM_TYPE", F.col("memory")).otherwise(F.col("screen"))
    own = ads.select("listing_id", real_screen(F.col("SCREEN_SIZE_SNAPPED")).cast("string").alias("screen"), memory_type(F.col("RAM_TYPE")).alias("memory")).distinct()
    j = f.join(own, "listing_id").withColumn("real", real)
    per = f.groupBy("field_name").agg(F.count("*").alias("cells"))
    bad = j.groupBy("field_name").agg(F.count_if(~F.col("filled") & ~F.col("value").eqNullSafe(F.col("real"))).alias("changed"), F.count_if(F.col("value").isNull()).alias("empty"), F.count_if(F.col("filled") & F.col("method").isNull()).alias("unmarked"))
    return per.join(bad, "field_name")


def p2_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Both fields of every listing, filled where missing, with the step that filled them."""
    return _filled(spark, sf)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells that other listings of the same model fill."""
    return _filled(spark, sf).where(F.col("method").isin("group_cluster", "group")).select("listing_id", "field_name").distinct()


#: Fixed ranges of the data: gigabytes of memory and of drives, dinars.
MEMORY_RANGE, DRIVE_RANGE, PRICE_RANGE = (2.0, 128.0), (100.0, 4096.0), (10_000.0, 1_000_000.0)
#: Dinars in a euro and a dirham (parameters of the conversion).
EURO, DIRHAM = 241.0, 13.3
CAPACITIES = {"RAM_SIZE": 0, "SSD_SIZE": 1, "HDD_SIZE": 2}
PRICE = 3
_BINARY = (("gb", "mb", "kb", "tb"), (1.0, 1 / 1024, 1 / 1024**2, 1000.0))
_MONEY = (("dinar", "centime", "thousand", "million", "euro", "dirham"), (1.0, 0.01, 1e3, 1e4, EURO, DIRHAM))
KINDS = {0: Units(*_BINARY, *MEMORY_RANGE), 1: Units(*_BINARY, *DRIVE_RANGE), 2: Units(*_BINARY, *DRIVE_RANGE), 3: Units(*_MONEY, *PRICE_RANGE)}


def _cells(spark: SparkSession, sf: str, ws: Workspace) -> DataFrame:
    """``id, at, series, field, kind, raw, value, written``: one row per cell that holds a quantity.

    ``written`` is the unit the cell names, NULL where only the history can tell. ``kind`` is what the number describes: of two
    swapped cells each belongs to the history of the other.
    """
    ads = read_table(spark, sf, "listings").select("listing_id", "scraped_at", "created_at", "city_grouped", *CAPACITIES, "price", "price_preview", "price_corrected")
    # capacities repeat a few hundred spellings: each is read once
    for name in CAPACITIES:
        spelled = ads.select(name).where(F.col(name).isNotNull()).distinct().withColumn("q", quantities(F.col(name))).where(F.size("q") > 0)
        spelled = spelled.select(name, "q", F.array_distinct(F.transform("q", lambda x: x["unit"])).alias("units"))
        other = F.array_except("units", F.array(F.lit("gb"), F.lit("")))
        written = F.when(F.size(other) > 0, F.element_at(other, 1)).when(~F.array_contains("units", F.lit("")), "gb")
        n = F.element_at("q", 1)["n"]
        gb = F.when((F.size("q") == 1) & F.coalesce(written, F.lit("gb")).isin("gb"), n)
        read = F.struct(n.alias("n"), written.alias("written"), gb.alias("gb"))
        spelled = ws.stage(spelled.select(name, read.alias(f"{name}_q")), f"spelled-{name}")
        ads = ads.join(small(spelled, name), name, "left")
    ads = ads.withColumn("swapped", F.coalesce(F.col("RAM_SIZE_q.gb").between(120, DRIVE_RANGE[1]) & F.col("SSD_SIZE_q.gb").between(*MEMORY_RANGE), F.lit(False)))
    cells = []
    for name, field in CAPACITIES.items():
        kind = F.when(F.col("swapped"), F.lit(1 - field)).otherwise(F.lit(field)) if field < 2 else F.lit(field)
        cells.append(F.struct(F.lit(field).alias("field"), kind.alias("kind"), F.col(name).alias("raw"), F.col(f"{name}_q.n").alias("value"), F.col(f"{name}_q.written").alias("written")))
    ads = ads.withColumns({"unit": dinar_unit(F.col("price")), "p": finite(F.col("price_corrected")), "before": finite(F.col("price_preview"))})
    p, unit = F.col("p"), F.col("unit")
    turned = F.coalesce(F.abs(p / F.nullif("before", F.lit(0.0)) - 1) > 0.005, F.lit(False))
    foreign = unit.isNotNull() & (unit != "dinar")
    factor = F.coalesce(*[F.when(unit == n, F.lit(f)) for n, f in zip(*_MONEY, strict=True)])
    possible = (p * factor).between(0.95 * PRICE_RANGE[0], 1.05 * PRICE_RANGE[1])
    inside = p.between(*PRICE_RANGE)
    ads = ads.withColumn("money", F.when(foreign & ~turned & possible, unit).when(foreign & turned & inside, "dinar").when((unit == "dinar") & inside, "dinar"))
    keep = F.col("money").isNotNull() | inside | ~joke_price(p)
    cells.append(F.struct(F.lit(PRICE).alias("field"), F.lit(PRICE).alias("kind"), F.col("price").alias("raw"), F.when(keep & (p > 0), p).alias("value"), F.col("money").alias("written")))
    at = F.unix_seconds(F.coalesce(instant(F.col("created_at")), F.col("scraped_at")))
    long = ads.select(F.col("listing_id").alias("id"), F.coalesce(at, F.lit(0)).alias("at"), F.coalesce("city_grouped", F.lit("?")).alias("source"), F.explode(F.array(*cells)).alias("c"))
    return ws.stage(long.select("id", "at", "source", "c.*").where("value IS NOT NULL").withColumn("series", F.concat("kind", F.lit(":"), "source")).drop("source"), "cells")


def _named(unit: Column) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.array(*[F.lit(n) for n in u.names]), unit + 1)) for k, u in KINDS.items()])


def _told(cells: DataFrame) -> DataFrame:
    """The segmentation of all histories. A source is a city; its memory, drives and prices are histories of their own."""
    told = F.coalesce(*[F.when(F.col("kind") == k, F.array_position(F.array(*[F.lit(n) for n in u.names]), F.col("written")) - 1) for k, u in KINDS.items()])
    return segment(cells.select("series", "kind", "at", "value", told.cast("int").alias("told")), KINDS)


def _foreign(cells: DataFrame, ws: Workspace) -> DataFrame:
    """The observations that lie in a segment of another unit."""
    return small(ws.stage(_told(cells).where("unit > 0").select("series", "at", "value", "unit"), "foreign"), "series")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """``id, field, raw, value, unit, method`` for every cell that holds a quantity."""
    ws = Workspace(spark)
    cells = _cells(spark, sf, ws)
    written = cells.where("written IS NOT NULL").select("id", "field", "raw", "value", F.col("written").alias("unit"), F.lit("written").alias("method"))
    bare = cells.where("written IS NULL").join(_foreign(cells, ws), ["series", "at", "value"], "left")
    found = bare.select("id", "field", "raw", "value", _named(F.coalesce("unit", F.lit(0))).alias("unit"), F.lit("history").alias("method"))
    return written.unionByName(found)


def _field_name() -> Column:
    return F.coalesce(*[F.when(F.col("field") == k, F.lit(n)) for n, k in {**CAPACITIES, "price_corrected": PRICE}.items()]).alias("field_name")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells recorded in another unit than gigabytes or dinars: those whose segment is in one, and those that name one."""
    ws = Workspace(spark)
    cells = _cells(spark, sf, ws)
    history = cells.where("written IS NULL").join(_foreign(cells, ws), ["series", "at", "value"], "left_semi").select("id", "field")
    written = cells.where(~F.col("written").isin("gb", "dinar")).select("id", "field")
    return history.unionByName(written).select(F.col("id").alias("listing_id"), _field_name()).distinct()


def p5_common(spark: SparkSession, sf: str) -> DataFrame:
    """Every quantity in gigabytes or dinars, with the unit it was recorded in and how that is known.

    Several drives add up; of a choice ("256GB/512GB") the first counts.
    """
    u = _units(spark, sf)
    factor = F.coalesce(*[F.when(F.col("unit") == n, F.lit(f)) for names, fs in (_BINARY, _MONEY) for n, f in zip(names, fs, strict=True)])
    gb = lambda q: q["n"] * F.when(q["unit"] == "tb", 1000.0).when(q["unit"] == "mb", 1 / 1024).when(q["unit"] == "kb", 1 / 1024**2).otherwise(1.0)
    q = quantities(F.col("raw"))
    added = F.aggregate(q, F.lit(0.0), lambda a, x: a + gb(x))
    several = F.when(F.col("raw").contains("/"), gb(F.element_at(q, 1))).otherwise(added)
    value = F.when((F.col("field") != PRICE) & (F.col("method") == "written"), several).otherwise(F.col("value") * factor)
    return u.select(F.col("id").alias("listing_id"), _field_name(), "raw", "unit", "method", value.alias("common_value")).distinct()


def _stretches(spark: SparkSession, sf: str, number: str) -> DataFrame:
    s = stretches(Workspace(spark).stage(_told(_cells(spark, sf, Workspace(spark))), "told"), number)
    quantity = F.element_at(F.array(F.lit("memory"), F.lit("ssd"), F.lit("hdd"), F.lit("price")), F.col("kind") + 1)
    return s.select(F.element_at(F.split("series", ":", 2), 2).alias("source"), quantity.alias("quantity"), "kind", *[c for c in s.columns if c not in ("series", "kind")])


def p5_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Where a source's bare numbers leave its common unit: from, to, the unit and the factor that reverses it."""
    s = _stretches(spark, sf, "seg").where("unit > 0")
    factor = F.coalesce(*[F.when(F.col("kind") == k, F.element_at(F.array(*[F.lit(f) for f in u.factors]), F.col("unit") + 1)) for k, u in KINDS.items()])
    return s.select("source", "quantity", "from_at", "to_at", "cells", _named(F.col("unit")).alias("unit"), factor.alias("factor"))


def p5_foreign_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of a source's bare numbers in any other unit than the common one."""
    return _stretches(spark, sf, "island").where("foreign = 1").select("source", "quantity", "from_at", "to_at", "cells")


_CAPACITY_SQL = """SELECT DISTINCT listing_id, '{col}' AS field_name FROM l
WHERE regexp_matches(lower({col}), '[0-9] ?(tb|to|tera|تيرا|mb|mo|mégas|megas|kb|ko)')
 OR (regexp_full_match(trim({col}), '[0-9]+') AND try_cast(trim({col}) AS DOUBLE) > 0
  AND NOT try_cast(trim({col}) AS DOUBLE) BETWEEN {low} AND {high} AND NOT (swapped AND try_cast(trim({col}) AS DOUBLE) BETWEEN {wide_low} AND {wide_high}))"""

ORACLE = {
    "p2_found": r"""WITH l AS (SELECT listing_id, array_to_string(list_sort(string_split(regexp_replace(lower(model_name), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '')), '') AS m,
 CASE WHEN SCREEN_SIZE_SNAPPED BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS s,
 CASE WHEN regexp_matches(upper(regexp_replace(RAM_TYPE, '[^A-Za-z0-9]+', '', 'g')), '^(LP|G)?DDR[0-9]') THEN 1 ELSE 0 END AS r FROM listings WHERE model_name IS NOT NULL),
h AS (SELECT m, max(s) AS hs, max(r) AS hr FROM l GROUP BY m)
SELECT DISTINCT listing_id, 'SCREEN_SIZE_SNAPPED' AS field_name FROM l JOIN h USING (m) WHERE s = 0 AND hs = 1 AND m <> ''
UNION ALL SELECT DISTINCT listing_id, 'RAM_TYPE' AS field_name FROM l JOIN h USING (m) WHERE r = 0 AND hr = 1 AND m <> ''""",
    "p2_checks": "SELECT unnest(['SCREEN_SIZE_SNAPPED', 'RAM_TYPE']) AS field_name, count(*) AS cells, 0 AS changed, 0 AS empty, 0 AS unmarked FROM listings",
    "p5_found": r"""WITH g AS (SELECT *, try_cast(replace(regexp_extract(lower(RAM_SIZE), '^(?:ram )?([0-9]+(?:,[0-9])?) ?(g|gb|go|gigas|جيغا)?$', 1), ',', '.') AS DOUBLE) AS rg,
 try_cast(replace(regexp_extract(lower(SSD_SIZE), '^(?:ssd )?([0-9]+(?:,[0-9])?) ?(g|gb|go|gigas|giga|جيغا)?$', 1), ',', '.') AS DOUBLE) AS sg FROM listings),
l AS (SELECT *, coalesce(rg BETWEEN 120 AND 4096 AND sg BETWEEN 2 AND 128, false) AS swapped FROM g)
"""
    + " UNION ALL ".join(
        _CAPACITY_SQL.format(col=c, low=low, high=high, wide_low=a, wide_high=b)
        for c, low, high, a, b in (("RAM_SIZE", 2, 128, 100, 4096), ("SSD_SIZE", 100, 4096, 2, 128), ("HDD_SIZE", 100, 4096, 0, 0))
    )
    + """ UNION ALL SELECT DISTINCT listing_id, 'price_corrected' FROM l WHERE price_corrected IS NOT NULL AND NOT isnan(price_corrected) AND
 CASE WHEN regexp_matches(lower(price), 'centime|cts|سنتيم|million|مليون|[0-9]m$|mille|الف|k$|€|eur|mad|dirham|dh') THEN abs(price_corrected / price_preview - 1) < 0.005
 ELSE NOT price_corrected BETWEEN 10000 AND 1000000 AND price_corrected <> 1 AND NOT (price_corrected = floor(price_corrected) AND price_corrected >= 100
  AND (replace(CAST(CAST(price_corrected AS BIGINT) AS VARCHAR), CAST(CAST(price_corrected AS BIGINT) AS VARCHAR)[1], '') = '' OR starts_with('123456789', CAST(CAST(price_corrected AS BIGINT) AS VARCHAR)))) END""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_filled, p2_accuracy, p2_checks, p5_found, p5_common, p5_segments, p5_foreign_stretches)}
