"""Shared inputs of the listing queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souqframe.functions.dates import instant
from souqframe.functions.listing import finite, number
from souqframe.session import read_table


def ads(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with missing numbers as NULL, numeric marks, ``price`` in its plausible range and the posting time."""
    a = read_table(spark, sf, "listings")
    clean = {c: finite(F.col(c)) for c in ("SCREEN_SIZE_SNAPPED", "SCREEN_RESOLUTION_ENC", "cores", "tdp", "gpu_tdp", "price_preview", "price_corrected")}
    marks = {c: number(F.col(c)) for c in ("cpu_mark", "gpu_g3d_mark", "gpu_g2d_mark")}
    a = a.withColumns({**clean, **marks})
    price = F.when(F.col("price_corrected").between(10_000, 1_000_000), F.col("price_corrected"))
    screen = F.when(F.col("SCREEN_SIZE_SNAPPED").between(10, 20), F.col("SCREEN_SIZE_SNAPPED"))
    return a.withColumns({"price": price, "price_text": F.col("price"), "screen": screen, "posted": instant(F.col("created_at"))})


_NUM = "CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"
_MARK = "try_cast(replace({c}, ',', '') AS DOUBLE) AS {c}"
POSTED = r"try_strptime(regexp_replace(upper(trim(created_at)), '(\+00:00|\.000Z|Z)$', ''), ['%Y %m %dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%H:%M:%S %Y.%m.%d', '%d/%m/%Y %H:%M:%S', '%Y%m%dT%H%M%S'])"
ADS = (
    "a AS (SELECT * REPLACE ("
    + ", ".join(_NUM.format(c=c) for c in ("SCREEN_SIZE_SNAPPED", "SCREEN_RESOLUTION_ENC", "cores", "tdp", "gpu_tdp", "price_preview", "price_corrected"))
    + ", "
    + ", ".join(_MARK.format(c=c) for c in ("cpu_mark", "gpu_g3d_mark", "gpu_g2d_mark"))
    + ", CASE WHEN price_corrected BETWEEN 10000 AND 1000000 THEN price_corrected END AS price), price AS price_text,"
    + " CASE WHEN SCREEN_SIZE_SNAPPED BETWEEN 10 AND 20 THEN SCREEN_SIZE_SNAPPED END AS screen, "
    + POSTED
    + " AS posted FROM listings)"
)


def r6(c):
    return F.round(c, 6)
