"""Round trips through sources and sinks, and streams over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from souqframe.plans.common import ADS, ads
from souqframe.session import Workspace, read_table
from souqframe.sources import readers, writers
from souqframe.streaming import events


def csv_round_trip(spark, sf):
    src = read_table(spark, sf, "cpus")
    path = f"{Workspace(spark).base}/cpus-csv"
    writers.write_table(src, path, kind="csv")
    return readers.read_csv(spark, path, src.schema)


def csv_with_bad_lines(spark, sf):
    """A column read as the wrong type: its lines arrive marked instead of failing."""
    src = read_table(spark, sf, "gpus").select("gpu_name", "g3d_mark")
    path = f"{Workspace(spark).base}/gpus-csv"
    writers.write_table(src, path, kind="csv")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("gpu_name", T.StringType()), T.StructField("g3d_mark", T.LongType())])
    bad = readers.read_csv_tolerant(spark, path, schema)
    return bad.select("gpu_name", "g3d_mark", F.col("bad_line").isNotNull().alias("is_bad"))


def tagged_files(spark, sf):
    src = read_table(spark, sf, "gpu_prices")
    base = f"{Workspace(spark).base}/tagged"
    for part in ("low", "high"):
        writers.write_table(src.where(F.col("estimated_price") < 100_000 if part == "low" else F.col("estimated_price") >= 100_000).coalesce(1), f"{base}/part={part}", kind="csv")
    both = readers.read_tagged(spark, f"{base}/part=*/*.csv", src.schema)
    return both.groupBy(F.col("file_name").isNotNull().alias("tagged")).agg(F.count("*").alias("n"))


def json_requests(spark, sf):
    """Every part as one JSON text a line, written and read back with its schema."""
    src = read_table(spark, sf, "cpus")
    path = f"{Workspace(spark).base}/requests"
    src.select(F.to_json(F.struct(*src.columns)).alias("value")).write.mode("overwrite").text(path)
    return spark.read.schema(src.schema).json(path)


def key_value_maps(spark, sf):
    m = read_table(spark, sf, "cpu_ddr_map")
    return readers.key_value_map(m, F.regexp_replace("cpu_name", r"\s*@.*$", ""), F.col("ddr_type"))


def partitioned_table(spark, sf):
    """Listings written by year; one year read back prunes the other folders."""
    a = ads(spark, sf).where("posted IS NOT NULL").select("listing_id", "price", F.year("posted").alias("listing_year"))
    path = f"{Workspace(spark).base}/by-year"
    writers.write_table(a, path, ["listing_year"])
    return spark.read.parquet(path).where("listing_year = 2024").select("listing_id", "price", F.col("listing_year").cast("int").alias("listing_year"))


def extended_map(spark, sf):
    known = read_table(spark, sf, "gpu_prices").where("gpu_name IS NOT NULL").groupBy("gpu_name").agg(F.max("estimated_price").alias("estimated_price"))
    new = read_table(spark, sf, "gpus").where("gpu_name IS NOT NULL").select("gpu_name", "estimated_price")
    return writers.extend_map(known, new, "gpu_name")


def stream_windows(spark, sf):
    """Hourly counts per type from the stream, once all is read."""
    return events.run_available(events.tumbling_counts(events.event_stream(spark, sf)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf):
    return events.run_available(events.sliding_counts(events.event_stream(spark, sf)), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_sessions(spark, sf):
    return events.run_available(events.session_counts(events.event_stream(spark, sf)), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_distinct(spark, sf):
    return events.run_available(events.first_deliveries(events.event_stream(spark, sf)).select("event_id", "event_type"))


def stream_totals(spark, sf):
    return events.run_available(events.running_totals(events.event_stream(spark, sf)), "update", ["user_id"]).select("user_id", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (csv_round_trip, csv_with_bad_lines, tagged_files, json_requests, key_value_maps, partitioned_table, extended_map, stream_windows, stream_sliding, stream_sessions, stream_distinct, stream_totals)}
_A = f"WITH {ADS} "
ORACLE = {
    "csv_round_trip": "SELECT * FROM cpus",
    "csv_with_bad_lines": "SELECT gpu_name, CASE WHEN NOT contains(g3d_mark, ',') THEN CAST(replace(g3d_mark, ',', '') AS BIGINT) END AS g3d_mark, coalesce(contains(g3d_mark, ','), false) AS is_bad FROM gpus",
    "tagged_files": "SELECT true AS tagged, count(*) AS n FROM gpu_prices WHERE estimated_price IS NOT NULL",
    "json_requests": "SELECT * FROM cpus",
    "key_value_maps": r"SELECT regexp_replace(cpu_name, '\s*@.*$', '') AS key, max(trim(ddr_type)) AS value FROM cpu_ddr_map WHERE cpu_name IS NOT NULL AND nullif(trim(ddr_type), '') IS NOT NULL GROUP BY 1",
    "partitioned_table": _A + "SELECT listing_id, price, 2024 AS listing_year FROM a WHERE year(posted) = 2024",
    "extended_map": "WITH k AS (SELECT gpu_name, max(estimated_price) AS estimated_price FROM gpu_prices WHERE gpu_name IS NOT NULL GROUP BY 1) FROM k UNION ALL SELECT gpu_name, estimated_price FROM gpus WHERE gpu_name IS NOT NULL AND gpu_name NOT IN (SELECT gpu_name FROM k)",
    "stream_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    "stream_distinct": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_totals": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
}
