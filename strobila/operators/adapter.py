"""The driver's tables seen as media: events are the samples of one track for each user, 16 files of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ticks of the adapter's tracks in a second.
TIMESCALE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def track_window() -> Window:
    return Window.partitionBy("file", "track_id").orderBy("sample_index")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, track_id, sample_index, dts, duration, size, cts_delta, description_index, is_sync, event_id, kind)."""
    ev = table(spark, sf_dir, "events")
    kinds = ev.select(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # one row
    order = Window.partitionBy("track_id").orderBy("dts", "event_id")
    rows = ev.select(
        F.concat(F.lit("f"), F.col("user_id") % 16).alias("file"),
        F.col("user_id").alias("track_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("dts"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        ((F.col("event_id") % 3) * 1000).alias("cts_delta"),
        F.col("event_id"),
        F.col("event_type").alias("kind"),
    )
    return (
        rows.crossJoin(F.broadcast(kinds))
        .withColumn("description_index", F.array_position("kinds", F.col("kind")).cast("long"))
        .drop("kinds")
        .withColumn("sample_index", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("duration", F.coalesce(F.lead("dts").over(order) - F.col("dts"), F.lit(0)).cast("long"))
        .withColumn("is_sync", (F.col("sample_index") == 0) | (F.col("kind") == "signup"))
    )


#: The same samples in SQL, as the CTE ``s``.
SAMPLES_SQL = """
WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS d FROM (SELECT DISTINCT event_type FROM events)),
ev AS (
  SELECT 'f' || CAST(user_id % 16 AS VARCHAR) AS file, user_id AS track_id, epoch_us(ts) AS dts,
         CAST(round(value * 100) AS BIGINT) AS size, (event_id % 3) * 1000 AS cts_delta, event_id, e.event_type AS kind, d AS description_index
  FROM events e JOIN kinds k ON e.event_type = k.event_type),
s AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY dts, event_id) - 1 AS sample_index,
         coalesce(lead(dts) OVER (PARTITION BY track_id ORDER BY dts, event_id) - dts, 0) AS duration,
         (row_number() OVER (PARTITION BY track_id ORDER BY dts, event_id) = 1 OR kind = 'signup') AS is_sync
  FROM ev)
"""
