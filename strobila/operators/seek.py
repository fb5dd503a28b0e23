"""As-of lookups: time to sample, nearest sync sample, time to fragment, regular sync intervals, closest sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strobila.operators.runs import TRACK


def seek_asof(probes: DataFrame, samples: DataFrame, by: list[str], time: str = "dts", carry: tuple[str, ...] = ("sample_index", "dts")) -> DataFrame:
    """Each probe (by, probe_id, time) with the last sample at or before its time; nulls before the first sample.

    One sort of the union by key and time and a running last value: no range join, so a key's cost is that of its rows.
    """
    row = F.struct(*[F.col(c) for c in carry])
    left = samples.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_probe"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), row.alias("_row"))
    right = probes.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_probe"), "probe_id", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_t", "_probe")
    out = left.unionByName(right).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter("_probe = 1")
    return out.select(*by, "probe_id", F.col("_t").alias("probe_time"), *[F.col(f"_row.{c}").alias(f"found_{c}") for c in carry])


def nearest_sync(df: DataFrame, inclusive: bool = False, keys: list[str] = TRACK) -> DataFrame:
    """``sync_before`` and ``sync_after``: indexes of the nearest sync samples.

    Before: strictly, or with ``inclusive`` the sample itself counts; 0 if there is none. After: the sample itself
    counts; the number of samples if there is none.
    """
    w = Window.partitionBy(*keys).orderBy("sample_index")
    mark = F.when(F.col("is_sync"), F.col("sample_index"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    count = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumns({"sync_before": F.coalesce(before, F.lit(0)).cast("long"), "sync_after": F.coalesce(after, count).cast("long")})


def sync_interval(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, interval): the least k of which every multiple below the sample count is a sync sample; 0 for none.

    A candidate is itself a sync sample, and k sync samples at multiples of k must be there, so each candidate is counted
    by the multiples that it has among the sync samples.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_n", F.count("*").over(w)).filter("is_sync").select(*keys, "_n", "sample_index")
    multiples = rows.filter("sample_index > 0").select(*keys, "_n", F.col("sample_index").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("sample_index"))).alias("sample_index"))
    hit = multiples.join(rows.select(*keys, "sample_index"), [*keys, "sample_index"], "left_semi")
    good = hit.groupBy(*keys, "k", "_n").agg(F.count("*").alias("hits")).filter(F.col("hits") == F.floor((F.col("_n") - 1) / F.col("k")) + 1)
    least = good.groupBy(*keys).agg(F.min("k").alias("interval"))
    return df.select(*keys).distinct().join(least, keys, "left").select(*keys, F.coalesce("interval", F.lit(0)).cast("long").alias("interval"))


def closest_sync(df: DataFrame, step: int, keys: list[str] = TRACK) -> DataFrame:
    """(keys, segment_index, target, sample_index): for every multiple of ``step`` ticks up to the track's end the sync
    sample whose dts is closest, the earliest on ties."""
    span = df.groupBy(*keys).agg(F.min("dts").alias("_first"), F.max("dts").alias("_last"))
    targets = span.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / step).cast("long"))).alias("segment_index"), "_first")
    targets = targets.withColumn("target", F.col("_first") + F.col("segment_index") * step)
    sync = df.filter("is_sync")
    # The closest is the last at or before the target or the first after it.
    t = targets.select(*keys, F.col("target").alias("_t"), F.lit(1).alias("_probe"), "segment_index", F.lit(None).cast("long").alias("sample_index"))
    s = sync.select(*keys, F.col("dts").alias("_t"), F.lit(0).alias("_probe"), F.lit(None).cast("long").alias("segment_index"), "sample_index")
    both = t.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("_t", "_probe", "sample_index")
    # Of several sync samples of one time before the target the earliest counts.
    first_of_time = F.min("sample_index").over(Window.partitionBy(*keys, "_t"))
    both = both.withColumn("_same", first_of_time)
    mark = F.when(F.col("_probe") == 0, F.struct(F.col("_t").alias("dts"), F.col("_same").alias("sample_index")))
    out = both.withColumn("_b", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_probe = 1")
    near = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b.dts") <= F.col("_a.dts") - F.col("_t")), F.col("_b.sample_index")).otherwise(F.col("_a.sample_index"))
    return out.select(*keys, "segment_index", F.col("_t").alias("target"), near.alias("sample_index"))


def seek_fragment(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """(file, probe_id, moof_offset): for a probe time the last index entry at or before it in every track of the file,
    of which the least fragment offset holds samples for all tracks. Entries: (file, track_id, time, moof_offset)."""
    tracks = entries.select("file", "track_id").distinct()
    per_track = probes.join(tracks, "file").withColumnRenamed("time", "dts")
    e = entries.withColumnRenamed("time", "dts")
    found = seek_asof(per_track, e, ["file", "track_id"], carry=("moof_offset",))
    return found.groupBy("file", "probe_id").agg(F.min("found_moof_offset").alias("moof_offset"))


def regular(value: Column) -> Column:
    return F.min(value) == F.max(value)
