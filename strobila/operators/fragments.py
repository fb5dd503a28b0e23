"""Samples of fragments: defaults by cascade, decode times that continue across fragments, offsets in a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strobila.operators.runs import TRACK

#: Fixed values of the track run's and fragment header's flag bits.
TRUN_DATA_OFFSET, TRUN_FIRST_FLAGS, TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_CTS = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
TFHD_BASE_OFFSET, TFHD_DESCRIPTION, TFHD_DURATION, TFHD_SIZE, TFHD_FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
#: The bit of sample flags that marks a sample as not sync.
NOT_SYNC = 0x10000


def continue_times(df: DataFrame, keys: list[str] = TRACK, base: str = "base_dts", name: str = "decode_time") -> DataFrame:
    """``name``: a sample's base time where its fragment gives one, else the time at which the sample before it ends."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    era = df.withColumn("_era", F.count(base).over(w))
    own = Window.partitionBy(*keys, "_era")
    since = F.sum("duration").over(own.orderBy("sample_index").rowsBetween(Window.unboundedPreceding, -1))
    return era.withColumn(name, (F.coalesce(F.max(base).over(own), F.lit(0)) + F.coalesce(since, F.lit(0))).cast("long")).drop("_era")


def fragment_samples(entries: DataFrame, traf: DataFrame, trex: DataFrame) -> DataFrame:
    """Samples (file, track_id, sample_index, moof_offset, offset, size, duration, dts, cts_delta, description_index,
    is_sync) of track runs.

    ``entries``: file, moof_offset, traf_index, trun_index, entry_index, duration, size, flags, cts (null where the run
    has none), data_offset, first_flags. ``traf``: a row for each fragment of a track with its defaults, base offset,
    base time and payload_offset, where the media data after it begins. ``trex``: a track's defaults. A value is the
    entry's own, else the fragment's, else the track's, else 0. A run begins at the base offset, which is the fragment's
    own place unless given, plus its data offset; where that comes to the fragment's place, the run follows the one
    before it, the first one the beginning of the media data.
    """
    if "payload_offset" not in traf.columns:
        traf = traf.withColumn("payload_offset", F.lit(None).cast("long"))
    renamed = trex.select("file", "track_id", *[F.col(c).alias(f"{c}_x") for c in ("default_description_index", "default_duration", "default_size", "default_flags")])
    t = traf.join(renamed, ["file", "track_id"], "left")
    rows = entries.join(t, ["file", "moof_offset", "traf_index"])
    zero = F.lit(0).cast("long")
    flags = F.coalesce(F.when(F.col("entry_index") == 0, F.col("first_flags")), F.col("flags"), F.col("default_flags"), F.col("default_flags_x"), zero)
    rows = rows.select(
        "file", "track_id", "moof_offset", "traf_index", "trun_index", "entry_index", "base_dts", "base_data_offset", "data_offset", "payload_offset",
        F.coalesce("duration", "default_duration", "default_duration_x", zero).alias("duration"),
        F.coalesce("size", "default_size", "default_size_x", zero).alias("size"),
        F.coalesce("cts", zero).alias("cts_delta"),
        F.coalesce("description_index", "default_description_index_x", zero).alias("description_index"),
        (flags.bitwiseAND(F.lit(NOT_SYNC)) == 0).alias("is_sync"),
    )
    frag = Window.partitionBy("file", "moof_offset", "traf_index").orderBy("trun_index", "entry_index")
    track = Window.partitionBy("file", "track_id").orderBy("moof_offset", "traf_index", "trun_index", "entry_index")
    rows = rows.withColumn("_start", F.coalesce("base_data_offset", "moof_offset") + F.coalesce("data_offset", zero))
    anchor = (F.col("entry_index") == 0) & (F.col("_start") != F.col("moof_offset"))
    rows = rows.withColumn("_era", F.sum(anchor.cast("int")).over(frag))
    era = Window.partitionBy("file", "moof_offset", "traf_index", "_era").orderBy("trun_index", "entry_index")
    begin = F.when(F.col("_era") == 0, F.coalesce("payload_offset", "moof_offset")).otherwise(F.first("_start").over(era))
    inside = F.coalesce(F.sum("size").over(era.rowsBetween(Window.unboundedPreceding, -1)), zero)
    rows = rows.withColumns({"offset": (begin + inside).cast("long"), "sample_index": (F.row_number().over(track) - 1).cast("long")})
    first = (F.col("entry_index") == 0) & (F.col("trun_index") == F.min("trun_index").over(Window.partitionBy("file", "moof_offset", "traf_index")))
    rows = rows.withColumn("_base", F.when(first, F.col("base_dts")))
    return continue_times(rows, base="_base", name="dts").select("file", "track_id", "sample_index", "moof_offset", "offset", "size", "duration", "dts", "cts_delta", "description_index", "is_sync")
