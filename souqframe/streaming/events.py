"""Structured Streaming over the event table: windows, sessions, duplicates, custom state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from souqframe.session import Workspace


def event_stream(spark: SparkSession, sf: str, watermark: str = "10 minutes") -> DataFrame:
    """The events as a stream of files, late ones dropped beyond the watermark."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _folder(sf: str) -> str:
    # a stream reads folders: single-file tables are matched by a pattern
    return f"{sf}/events*.parquet"


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is, into a table of the shared folder, and read it back.

    In update mode the last row of each of ``keys`` counts."""
    spark = stream.sparkSession
    base = f"{Workspace(spark).base}/stream-{uuid.uuid4().hex[:8]}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    got = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    last = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def tumbling_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_counts(stream: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_deliveries(stream: DataFrame, key: str = "event_id") -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([key])


def running_totals(stream: DataFrame) -> DataFrame:
    """Per user the number and sum of events so far, kept as custom state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    kind = stream.schema["user_id"].dataType.simpleString()
    return stream.groupBy("user_id").applyInPandasWithState(update, f"user_id {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
