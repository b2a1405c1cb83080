"""Sources: every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

import copy
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, drop: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with header; columns in ``drop`` are left out."""
    return spark.read.schema(schema).option("header", True).csv(path).drop(*drop)


def read_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType, bad: str = "bad_line") -> DataFrame:
    """Lines that do not fit the schema come with NULLs and their text in ``bad``. Columns that nobody selects are not read, so not checked."""
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    return spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)


def read_tagged(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files of a pattern as one table with ``file_name``."""
    return spark.read.schema(schema).option("header", True).csv(pattern).withColumn("file_name", F.col("_metadata.file_name"))


def read_json_rows(spark: SparkSession, texts: list[str], schema: T.StructType) -> DataFrame:
    """Requests given as JSON texts."""
    src = spark.createDataFrame([(t,) for t in texts], "text string")
    return src.select(F.from_json("text", schema).alias("r")).select("r.*")


def key_value_map(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``key, value`` of a reference table; blank values and keys are skipped, of repeated keys the greatest value stays."""
    kv = df.select(key.alias("key"), F.nullif(F.trim(value.cast("string")), F.lit("")).alias("value"))
    return kv.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on top, dictionaries within dictionaries likewise."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_settings(defaults: dict, variable: str = "SOUQFRAME_SETTINGS") -> dict:
    """Defaults, overlaid by the JSON file a variable names."""
    path = os.environ.get(variable)
    if not path:
        return copy.deepcopy(defaults)
    with open(path, encoding="utf-8") as f:
        return merged(defaults, json.load(f))
