"""Cleaning of typed specifications: one query per operator, over all listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe import constants as K
from souqframe.functions import specs as S
from souqframe.functions.scale import rescaled
from souqframe.operators.text_classes import small
from souqframe.plans.common import ADS, ads, r6
from souqframe.session import read_table


def _map_sql(expr: str, table: dict, text: bool = False) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def capacity_to_gb(spark, sf):
    a = read_table(spark, sf, "listings")
    return a.select("listing_id", *[r6(S.capacity_gb(F.col(c))).alias(o) for c, o in (("RAM_SIZE", "ram_gb"), ("SSD_SIZE", "ssd_gb"), ("HDD_SIZE", "hdd_gb"))])


_PART = """(CASE WHEN contains(f, 'TB') THEN n * 1000 WHEN contains(f, 'MB') THEN n / 1024 ELSE n END)"""


def _capacity_sql(c: str, digits: int = 6) -> str:
    first = "string_split_regex(p, '[/|,]')[1]"
    chosen = f"CASE WHEN len(regexp_extract_all({first}, 'GB|TB')) > 1 AND contains(trim({first}), ' ') THEN string_split_regex(trim({first}), '\\s+')[1] ELSE {first} END"
    num = f"coalesce(try_cast(nullif(regexp_extract({chosen}, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0)"
    return f"round(coalesce(list_sum(list_transform(string_split(upper(trim({c})), '+'), lambda p: CASE WHEN contains({chosen}, 'TB') THEN {num} * 1000 WHEN contains({chosen}, 'MB') THEN {num} / 1024 ELSE {num} END)), 0), {digits})"


def capacity_binary(spark, sf):
    a = read_table(spark, sf, "listings")
    return a.select("listing_id", *[r6(S.capacity_gb_binary(F.col(c))).alias(o) for c, o in (("RAM_SIZE", "ram_gb"), ("SSD_SIZE", "ssd_gb"))])


def _binary_sql(c: str) -> str:
    n = "coalesce(try_cast(regexp_replace(p, '[^0-9.]', '', 'g') AS DOUBLE), 0)"
    return f"round(coalesce(list_sum(list_transform(string_split(upper({c}), '+'), lambda p: CASE WHEN contains(p, 'TB') THEN {n} * 1024 WHEN contains(p, 'MB') THEN {n} / 1024 ELSE {n} END)), 0), 6)"


def ram_ssd_swap(spark, sf):
    a = read_table(spark, sf, "listings")
    swap = S.cells_swapped(F.col("RAM_SIZE"), F.col("SSD_SIZE"))
    return a.select("listing_id", swap.alias("swapped"), F.when(swap, F.col("SSD_SIZE")).otherwise(F.col("RAM_SIZE")).alias("ram_size"), F.when(swap, F.col("RAM_SIZE")).otherwise(F.col("SSD_SIZE")).alias("ssd_size"))


_MEM = "coalesce(replace(replace(upper(trim({c})), 'GB', ''), ' ', '') IN (" + ", ".join(f"'{x}'" for x in K.MEMORY_SIZES) + "), false)"
_STO = "coalesce(contains(upper(trim({c})), '+') OR contains(upper(trim({c})), 'TB') OR floor(try_cast(replace(replace(upper(trim({c})), 'GB', ''), ' ', '') AS DOUBLE)) >= 256, false)"
_SWAP = f"((coalesce(trim(RAM_SIZE), '') = '' AND {_MEM.format(c='SSD_SIZE')}) OR ({_STO.format(c='RAM_SIZE')} AND {_MEM.format(c='SSD_SIZE')}) OR ({_STO.format(c='RAM_SIZE')} AND NOT {_MEM.format(c='RAM_SIZE')} AND coalesce(trim(SSD_SIZE), '') = ''))"


def drive_pairs(spark, sf):
    first, second = S.drive_pair(F.col("SSD_SIZE"))
    return read_table(spark, sf, "listings").select("listing_id", first.alias("first_drive"), second.alias("second_drive"))


def storage_labels(spark, sf):
    return read_table(spark, sf, "listings").select("listing_id", S.storage_label(F.col("HDD_SIZE")).alias("hdd"))


_FIRST = "upper(CASE WHEN contains(trim(HDD_SIZE), ' ') AND len(list_filter(string_split_regex(trim(HDD_SIZE), '\\s+'), lambda p: regexp_matches(upper(p), 'GB|TB'))) > 0 THEN list_filter(string_split_regex(trim(HDD_SIZE), '\\s+'), lambda p: regexp_matches(upper(p), 'GB|TB'))[1] ELSE trim(HDD_SIZE) END)"


def memory_ranks(spark, sf):
    return read_table(spark, sf, "listings").select("listing_id", S.memory_rank(F.col("RAM_TYPE")).alias("ram_type_rank"))


_RT = "replace(upper(trim(RAM_TYPE)), ' ', '')"
_RANK = "coalesce(" + _map_sql(_RT, K.RAM_TYPE_ORDINAL) + ", CASE " + " ".join(f"WHEN contains({_RT}, '{n}') THEN {K.RAM_TYPE_ORDINAL[n]}" for n in sorted(K.RAM_TYPE_ORDINAL, key=lambda n: (-len(n), n))) + " END)"


def screen_snap(spark, sf):
    size = S.screen_size(F.when(~F.isnan("SCREEN_SIZE_SNAPPED"), F.col("SCREEN_SIZE_SNAPPED")))
    return read_table(spark, sf, "listings").select("listing_id", size.alias("screen"), S.snapped_screen(size).alias("snapped"))


_OPTIONS = "[" + ", ".join(f"{{'d': round(abs(s - {x}), 2), 's': {x}::DOUBLE}}" for x in K.SCREEN_SIZES) + "]"


def resolution_tiers(spark, sf):
    a = read_table(spark, sf, "listings")
    tier = S.resolution_tier(F.col("SCREEN_RESOLUTION_STD"))
    size = F.when(F.col("SCREEN_SIZE_SNAPPED").between(10, 20), F.col("SCREEN_SIZE_SNAPPED"))
    return a.select("listing_id", tier.alias("tier"), S.resolution_rank(tier).alias("tier_rank"), S.pixels(tier).cast("bigint").alias("pixels"), r6(S.pixels_per_inch(tier, size)).alias("ppi"))


_TIER = "CASE " + " ".join(f"WHEN r IN ({', '.join(repr(s) for s in spelled)}) THEN '{t}'" for t, spelled in K.RESOLUTION_SPELLINGS.items()) + " END"


def condition_ranks(spark, sf):
    c = F.col("spec_Etat")
    return read_table(spark, sf, "listings").select("listing_id", S.condition_rank(c).alias("condition_rank"), c.isNull().cast("int").alias("condition_missing"))


def family_words(spark, sf, table: str = "cpus", name: str = "name"):
    """``token, maker, family``: the words a part list names its families by, the second of each name, lower case."""
    w = F.split(F.trim(F.regexp_replace(name, r"\s*@.*$", "")), " ")
    return read_table(spark, sf, table).where(F.col(name).isNotNull()).select(F.lower(w[1]).alias("token"), w[0].alias("maker"), F.concat_ws(" ", w[0], w[1]).alias("family")).distinct()


def named_family(texts, column: str, words):
    """Distinct texts with the maker and family whose word they contain; the first by name if there are several."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("token")
    hits = texts.where(F.col(column).isNotNull()).select(column).distinct().select(column, token).join(small(words, "token", "family"), "token")
    return hits.groupBy(column).agg(F.min(F.struct("family", "maker")).alias("f")).select(column, "f.family", "f.maker")


def cpu_texts(spark, sf):
    """What a typed processor says: family and maker by the words of the part list, number and generation."""
    ads, c = read_table(spark, sf, "listings").select("listing_id", "CPU"), F.col("CPU")
    n = S.model_number(c)
    named = named_family(ads, "CPU", family_words(spark, sf))
    return ads.join(small(named, "CPU"), "CPU", "left").select("listing_id", S.cpu_key(c).alias("cpu_key"), F.coalesce("maker", F.lit("OTHER")).alias("maker"), F.coalesce("family", F.lit("UNKNOWN")).alias("family"), n["number"].alias("model_number"), S.generation(n["number"]).alias("generation"))


FAMILY_SQL = r"""v AS (SELECT DISTINCT lower(w[2]) AS token, w[1] AS maker, w[1] || ' ' || w[2] AS family FROM (SELECT string_split(trim(regexp_replace({name}, '\s*@.*$', '')), ' ') AS w FROM {table} WHERE {name} IS NOT NULL)),
fam AS (SELECT {text}, min(family) AS family, arg_min(maker, family) AS maker FROM (SELECT DISTINCT {text}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}]+')) AS token FROM listings WHERE {text} IS NOT NULL) JOIN v USING (token) GROUP BY 1)"""
_MODEL = r"try_cast(nullif(regexp_extract(upper(regexp_replace(CPU, '\s*@.*$', '')), '(\d{3,5})([A-Z]{0,2}\d?)\b', 1), '') AS BIGINT)"


def numeric_marks(spark, sf):
    return ads(spark, sf).select("listing_id", "cpu_mark", "gpu_g3d_mark", "gpu_g2d_mark")


def use_flags(spark, sf):
    a = ads(spark, sf)
    y, m = F.year("posted"), F.month("posted")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    dedicated = F.col("DEDICATED_GPU").isNotNull()
    return a.select(
        "listing_id",
        flag(dedicated).alias("has_dedicated_gpu"),
        flag(dedicated & (F.coalesce("gpu_tdp", F.lit(0.0)) > 45)).alias("is_gaming"),
        flag((F.coalesce("screen", F.lit(99.0)) <= 14) & (F.coalesce("tdp", F.lit(99.0)) <= 15) & ~dedicated).alias("is_ultrabook"),
        flag(m.isin(9, 10)).alias("is_back_to_school"),
        flag(S.lookup(y, K.RAMADAN_MONTH) == m).alias("is_ramadan"),
    )


def ratios(spark, sf):
    a = ads(spark, sf)
    ssd, ram, hdd = S.capacity_gb(F.col("SSD_SIZE")), S.capacity_gb(F.col("RAM_SIZE")), S.capacity_gb(F.col("HDD_SIZE"))
    zero = F.lit(0.0)
    return a.select(
        "listing_id",
        r6(F.col("gpu_g3d_mark") / F.nullif("cpu_mark", zero)).alias("gpu_to_cpu"),
        r6(ssd / F.nullif(ram, zero)).alias("storage_per_ram"),
        r6(ssd + hdd).alias("total_storage"),
        (F.coalesce("tdp", zero) + F.coalesce("gpu_tdp", zero)).alias("total_tdp"),
    )


def date_parts(spark, sf):
    m = F.month("posted")
    return ads(spark, sf).select(
        "listing_id", F.year("posted").alias("year"), m.alias("month"), ((F.year("posted") - 2018) * 12 + m).alias("month_index"),
        r6(F.sin(2 * 3.141592653589793 * m / 12)).alias("month_sin"), r6(F.cos(2 * 3.141592653589793 * m / 12)).alias("month_cos"), F.unix_seconds("posted").alias("posted_s"),
    )


def performance_tiers(spark, sf):
    return ads(spark, sf).select("listing_id", S.performance_tier(F.col("cpu_mark"), F.col("gpu_g3d_mark")).alias("tier"))


def joke_numbers(spark, sf):
    a = ads(spark, sf)
    return a.select("listing_id", "price_corrected", S.joke_number(F.col("price_corrected")).alias("is_joke"))


_DIGITS = "CAST(CAST(abs(price_corrected) AS BIGINT) AS VARCHAR)"


def decimal_scale(spark, sf):
    fixed = rescaled(F.col("price_corrected"), 10_000.0, 1_000_000.0)
    return ads(spark, sf).select("listing_id", r6(fixed["value"]).alias("value"), fixed["method"].alias("method"), fixed["exponent"].alias("exponent"))


_P10 = "[" + ", ".join(f"1e{k}" for k in range(-8, 9)) + "]"


def signatures(spark, sf):
    a = ads(spark, sf)
    num = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    return a.select("listing_id", F.concat_ws("|", num(F.col("cpu_mark").cast("bigint")), num(F.col("gpu_g3d_mark").cast("bigint")), num(F.col("screen")), num(F.col("SCREEN_RESOLUTION_ENC"))).alias("signature"))


def search_models(spark, sf):
    a = read_table(spark, sf, "listings")
    return a.where(S.search_all(F.col("model_name"), "lekiwing-z15")).select("listing_id", "model_name")


def price_bins(spark, sf):
    a = ads(spark, sf)
    label = S.labelled_bins(F.col("price"), [0, 30_000, 60_000, 100_000, 200_000, 1_000_000], ["low", "fair", "middle", "high", "top"])
    return a.groupBy(label.alias("price_bin")).agg(F.count("*").alias("listings"))


def clock_suffix(spark, sf):
    return read_table(spark, sf, "cpus").select("name", F.regexp_replace("name", r"\s*@.*$", "").alias("model"))


def log_round_trip(spark, sf):
    a = ads(spark, sf).where("price IS NOT NULL")
    log = F.log1p("price")
    back = F.expm1(F.greatest(F.least(log, F.lit(13.815511557963774)), F.lit(9.210440366976517)))
    return a.select("listing_id", r6(log).alias("log_price"), F.round(back, 3).alias("back"))


def content_hashes(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256).alias("sha256"))


_A = f"WITH {ADS} "
QUERIES = {f.__name__: f for f in (capacity_to_gb, capacity_binary, ram_ssd_swap, drive_pairs, storage_labels, memory_ranks, screen_snap, resolution_tiers, condition_ranks, cpu_texts, numeric_marks, use_flags, ratios, date_parts, performance_tiers, joke_numbers, decimal_scale, signatures, search_models, price_bins, clock_suffix, log_round_trip, content_hashes)}
ORACLE = {
    "capacity_to_gb": f"SELECT listing_id, {_capacity_sql('RAM_SIZE')} AS ram_gb, {_capacity_sql('SSD_SIZE')} AS ssd_gb, {_capacity_sql('HDD_SIZE')} AS hdd_gb FROM listings",
    "capacity_binary": f"SELECT listing_id, {_binary_sql('RAM_SIZE')} AS ram_gb, {_binary_sql('SSD_SIZE')} AS ssd_gb FROM listings",
    "ram_ssd_swap": f"SELECT listing_id, {_SWAP} AS swapped, CASE WHEN {_SWAP} THEN SSD_SIZE ELSE RAM_SIZE END AS ram_size, CASE WHEN {_SWAP} THEN RAM_SIZE ELSE SSD_SIZE END AS ssd_size FROM listings",
    "drive_pairs": "SELECT listing_id, CASE WHEN len(string_split(SSD_SIZE, '+')) = 2 THEN trim(string_split(SSD_SIZE, '+')[1]) ELSE SSD_SIZE END AS first_drive, CASE WHEN len(string_split(SSD_SIZE, '+')) = 2 THEN trim(string_split(SSD_SIZE, '+')[2]) END AS second_drive FROM listings",
    "storage_labels": f"WITH f AS (SELECT listing_id, HDD_SIZE AS h, {_FIRST} AS first FROM listings) SELECT listing_id, CASE WHEN nullif(h, '') IS NULL THEN h WHEN contains(first, 'TB') THEN coalesce(CAST(CAST(floor(try_cast(replace(first, 'TB', '') AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR) || 'GB', first) WHEN contains(first, 'GB') THEN first ELSE coalesce(CAST(CAST(floor(try_cast(first AS DOUBLE)) AS BIGINT) AS VARCHAR) || 'GB', trim(h)) END AS hdd FROM f",
    "memory_ranks": f"SELECT listing_id, CAST({_RANK} AS DOUBLE) AS ram_type_rank FROM listings",
    "screen_snap": f"WITH s AS (SELECT listing_id, CASE WHEN SCREEN_SIZE_SNAPPED BETWEEN 10 AND 20 THEN SCREEN_SIZE_SNAPPED END AS s FROM listings) SELECT listing_id, s AS screen, CASE WHEN s IS NOT NULL THEN CASE WHEN list_min({_OPTIONS}).d <= 0.3 THEN list_min({_OPTIONS}).s ELSE s END END AS snapped FROM s",
    "resolution_tiers": f"WITH l AS (SELECT listing_id, regexp_replace(lower(trim(SCREEN_RESOLUTION_STD)), '\\s+', '', 'g') AS r, CASE WHEN SCREEN_SIZE_SNAPPED BETWEEN 10 AND 20 THEN SCREEN_SIZE_SNAPPED END AS s FROM listings), t AS (SELECT listing_id, s, {_TIER} AS tier FROM l) SELECT listing_id, tier, {_map_sql('tier', K.RESOLUTION_RANK)} AS tier_rank, CAST({_map_sql('tier', {t: w * h for t, (w, h) in K.RESOLUTION_PIXELS.items()})} AS BIGINT) AS pixels, round({_map_sql('tier', {t: (w * w + h * h) ** 0.5 for t, (w, h) in K.RESOLUTION_PIXELS.items()})} / s, 6) AS ppi FROM t",
    "condition_ranks": f"SELECT listing_id, CAST({_map_sql('upper(trim(spec_Etat))', K.CONDITION_RANK)} AS DOUBLE) AS condition_rank, CAST(spec_Etat IS NULL AS INT) AS condition_missing FROM listings",
    "cpu_texts": "WITH " + FAMILY_SQL.format(name="name", table="cpus", text="CPU") + rf" SELECT listing_id, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower(CPU), '\s*@.*$', ''), 'intel|processor|core|cpu', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '') AS cpu_key, coalesce(maker, 'OTHER') AS maker, coalesce(family, 'UNKNOWN') AS family, {_MODEL} AS model_number, CASE WHEN {_MODEL} IS NOT NULL THEN greatest(least(CAST(floor({_MODEL} / 1000) AS INT), 14), 1) END AS generation FROM listings LEFT JOIN fam USING (CPU)",
    "numeric_marks": _A + "SELECT listing_id, cpu_mark, gpu_g3d_mark, gpu_g2d_mark FROM a",
    "use_flags": _A + "SELECT listing_id, CAST(DEDICATED_GPU IS NOT NULL AS INT) AS has_dedicated_gpu, CAST(DEDICATED_GPU IS NOT NULL AND coalesce(gpu_tdp, 0) > 45 AS INT) AS is_gaming, CAST(coalesce(screen, 99) <= 14 AND coalesce(tdp, 99) <= 15 AND DEDICATED_GPU IS NULL AS INT) AS is_ultrabook, CAST(coalesce(month(posted) IN (9, 10), false) AS INT) AS is_back_to_school, CAST(coalesce(" + _map_sql("year(posted)", K.RAMADAN_MONTH) + " = month(posted), false) AS INT) AS is_ramadan FROM a",
    "ratios": _A + f"SELECT listing_id, round(gpu_g3d_mark / nullif(cpu_mark, 0), 6) AS gpu_to_cpu, round({_capacity_sql('SSD_SIZE', 15)} / nullif({_capacity_sql('RAM_SIZE', 15)}, 0), 6) AS storage_per_ram, round({_capacity_sql('SSD_SIZE')} + {_capacity_sql('HDD_SIZE')}, 6) AS total_storage, coalesce(tdp, 0) + coalesce(gpu_tdp, 0) AS total_tdp FROM a",
    "date_parts": _A + "SELECT listing_id, CAST(year(posted) AS INT) AS year, CAST(month(posted) AS INT) AS month, CAST((year(posted) - 2018) * 12 + month(posted) AS INT) AS month_index, round(sin(2 * pi() * month(posted) / 12), 6) AS month_sin, round(cos(2 * pi() * month(posted) / 12), 6) AS month_cos, CAST(epoch(posted) AS BIGINT) AS posted_s FROM a",
    "performance_tiers": _A + "SELECT listing_id, CASE WHEN cpu_mark >= 25000 OR coalesce(gpu_g3d_mark, 0) >= 18000 THEN 3 WHEN cpu_mark BETWEEN 10000 AND 25000 AND coalesce(gpu_g3d_mark, 0) BETWEEN 4000 AND 18000 THEN 2 WHEN cpu_mark < 10000 AND coalesce(gpu_g3d_mark, 0) < 4000 THEN 1 ELSE 0 END AS tier FROM a",
    "joke_numbers": _A + f"SELECT listing_id, price_corrected, coalesce((len({_DIGITS}) >= 3 AND replace({_DIGITS}, {_DIGITS}[1], '') = '') OR {_DIGITS} IN ({', '.join(repr(str(x)) for x in K.JOKE_NUMBERS)}), false) AS is_joke FROM (SELECT * REPLACE (price_corrected AS price_corrected), CAST(trunc(abs(price_corrected)) AS BIGINT) AS w FROM a)".replace("CAST(CAST(abs(price_corrected) AS BIGINT) AS VARCHAR)", "CAST(w AS VARCHAR)"),
    "decimal_scale": _A + f", e AS (SELECT listing_id, price_corrected AS v, list_filter(range(-8, 9), lambda k: price_corrected * ({_P10})[k + 9] BETWEEN 10000 AND 1000000) AS f FROM a), g AS (SELECT listing_id, v, CASE WHEN v BETWEEN 10000 AND 1000000 THEN 0 WHEN v > 1000000 THEN list_max(list_filter(f, lambda k: k < 0)) WHEN v > 0 THEN list_min(list_filter(f, lambda k: k > 0)) END AS k FROM e) SELECT listing_id, round(CASE WHEN k IS NULL THEN v ELSE v * ({_P10})[k + 9] END, 6) AS value, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 0 THEN 'unchanged' ELSE 'price_only' END AS method, CAST(coalesce(k, 0) AS INT) AS exponent FROM g",
    "signatures": _A + "SELECT listing_id, concat_ws('|', coalesce(CAST(CAST(cpu_mark AS BIGINT) AS VARCHAR), 'NA'), coalesce(CAST(CAST(gpu_g3d_mark AS BIGINT) AS VARCHAR), 'NA'), coalesce(CAST(screen AS VARCHAR), 'NA'), coalesce(CAST(SCREEN_RESOLUTION_ENC AS VARCHAR), 'NA')) AS signature FROM a",
    "search_models": "SELECT listing_id, model_name FROM listings WHERE contains(replace(lower(model_name), '-', ' '), 'lekiwing') AND contains(replace(lower(model_name), '-', ' '), 'z15')",
    "price_bins": _A + "SELECT CASE WHEN price > 0 AND price <= 30000 THEN 'low' WHEN price > 30000 AND price <= 60000 THEN 'fair' WHEN price > 60000 AND price <= 100000 THEN 'middle' WHEN price > 100000 AND price <= 200000 THEN 'high' WHEN price > 200000 AND price <= 1000000 THEN 'top' END AS price_bin, count(*) AS listings FROM a GROUP BY 1",
    "clock_suffix": r"SELECT name, regexp_replace(name, '\s*@.*$', '') AS model FROM cpus",
    "log_round_trip": _A + "SELECT listing_id, round(ln(1 + price), 6) AS log_price, round(exp(greatest(least(ln(1 + price), 13.815511557963774), 9.210440366976517)) - 1, 3) AS back FROM a WHERE price IS NOT NULL",
    "content_hashes": "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM documents",
}
