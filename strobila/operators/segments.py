"""Segmentation and roll-ups: fixed and threshold segments, tracks, adaptation sets, bandwidth, manifests' inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strobila.functions.scalars import bitrate, duration_ms, frame_rate
from strobila.operators.runs import TRACK


def media_scan(df: DataFrame, timescale: int, keys: list[str] = TRACK) -> DataFrame:
    """(keys, sample_count, total_size, total_duration, millis, bitrate) of every track."""
    g = df.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.sum("size").alias("total_size"), F.sum("duration").alias("total_duration"))
    g = g.withColumn("millis", duration_ms(F.col("total_duration"), F.lit(timescale)))
    return g.withColumn("bitrate", bitrate(F.col("total_size"), F.col("millis")))


def rates(df: DataFrame, timescale: int, keys: list[str] = TRACK) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.sum("duration").alias("total_duration"))
    return g.withColumn("frame_rate", frame_rate(F.col("sample_count"), F.col("total_duration"), F.lit(timescale)))


def fixed_segments(df: DataFrame, ticks: int, keys: list[str] = TRACK) -> DataFrame:
    """``segment_index``: whole multiples of ``ticks`` since the track's first sample."""
    first = F.min("dts").over(Window.partitionBy(*keys))
    return df.withColumn("segment_index", F.floor((F.col("dts") - first) / ticks).cast("long"))


def roll_up_segments(df: DataFrame, timescale: int, keys: list[str] = TRACK) -> DataFrame:
    """(keys, segment_index, sample_count, size, duration, bitrate): a segment's bytes, ticks and whole bits a second."""
    g = df.groupBy(*keys, "segment_index").agg(F.count("*").alias("sample_count"), F.sum("size").alias("size"), F.sum("duration").alias("duration"))
    rate = F.when(F.col("duration") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("size") * 8 * timescale / F.col("duration")).cast("long"))
    return g.withColumn("bitrate", rate)


def roll_up_tracks(segments: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, segment_count, mean_duration, max_bitrate): the mean leaves out the last two segments where there are more
    than two, the maximum the last where there is more than one, since the last ones are often short."""
    w = Window.partitionBy(*keys)
    rows = segments.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("segment_index"))})
    for_mean = (F.col("_n") <= 2) | (F.col("_k") <= F.col("_n") - 2)
    for_max = (F.col("_n") <= 1) | (F.col("_k") <= F.col("_n") - 1)
    g = rows.groupBy(*keys).agg(F.count("*").alias("segment_count"), F.sum(F.when(for_mean, F.col("duration"))).alias("_sum"), F.count(F.when(for_mean, 1)).alias("_of"), F.max(F.when(for_max, F.col("bitrate"))).alias("max_bitrate"))
    return g.select(*keys, "segment_count", (F.col("_sum").cast("double") / F.col("_of")).alias("mean_duration"), "max_bitrate")


def sync_durations(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, sample_index, dts, sync_duration): from each sync sample to the next, or to the track's end."""
    end = F.max(F.col("dts") + F.col("duration")).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy("sample_index")
    rows = df.withColumn("_end", end).filter("is_sync")
    return rows.select(*keys, "sample_index", "dts", (F.coalesce(F.lead("dts").over(w), F.col("_end")) - F.col("dts")).alias("sync_duration"))


def first_sync_of_fragment(df: DataFrame, every: bool = False, keys: list[str] = TRACK) -> DataFrame:
    """Sync samples that begin their segment; with ``every`` the first sync sample of each segment wherever it is."""
    w = Window.partitionBy(*keys, "segment_index").orderBy("sample_index")
    if every:
        return df.filter("is_sync").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1 and is_sync").drop("_k")


def display_order(df: DataFrame, display: str = "cts_delta", keys: list[str] = TRACK) -> DataFrame:
    """``gop`` (running count of sync samples), ``display_rank`` in it and ``reorder`` (decoding less display place)."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    rows = df.withColumn("gop", F.sum(F.col("is_sync").cast("long")).over(w))
    own = Window.partitionBy(*keys, "gop")
    rows = rows.withColumn("_place", F.row_number().over(own.orderBy("sample_index")))
    rows = rows.withColumn("display_rank", F.row_number().over(own.orderBy(display, "sample_index")).cast("long"))
    return rows.withColumn("reorder", (F.col("_place") - F.col("display_rank")).cast("long")).drop("_place")


def alike_flags(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, same_duration, same_size, all_sync, only_first_sync): which defaults a fragment header can carry."""
    first = F.min("sample_index").over(Window.partitionBy(*keys))
    only = F.min(F.when(F.col("sample_index") == F.col("_first"), F.col("is_sync")).otherwise(~F.col("is_sync")).cast("int")) == 1
    same = lambda c: F.min(c) == F.max(c)
    return df.withColumn("_first", first).groupBy(*keys).agg(same("duration").alias("same_duration"), same("size").alias("same_size"), (F.min(F.col("is_sync").cast("int")) == 1).alias("all_sync"), only.alias("only_first_sync"))


def simplify_sets(sets: DataFrame, parts: list[str]) -> DataFrame:
    """``name``: the parts of a set's key joined, without the last where the others alone are unique."""
    head = parts[:-1]
    n = F.count("*").over(Window.partitionBy(*head))
    return sets.withColumn("name", F.when(n == 1, F.concat_ws("/", *head)).otherwise(F.concat_ws("/", *parts)))


def unique_names(df: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the name, or where an earlier row of the group has it already, the name with ``-1``, ``-2`` and so
    on, the first that no earlier row has.

    Only in groups that hold a name of the form of another one's successor does it matter what was given before; these
    few are walked, all others are numbered by a window.
    """
    w = Window.partitionBy(*group)
    stem = F.regexp_replace(F.col(name), r"-\d+$", "")
    like = F.coalesce((stem != F.col(name)) & F.array_contains(F.collect_set(name).over(w), stem), F.lit(False))
    rows = df.withColumn("_like", like).withColumn("_walk", F.max("_like").over(w)).drop("_like")
    k = F.row_number().over(Window.partitionBy(*group, name).orderBy(*order))
    plain = rows.filter("not _walk").withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), (k - 1).cast("string"))))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, last, out = pdf.sort_values(order), set(), {}, []
        for n in pdf[name]:
            own = n
            while own in taken:
                last[n] = last.get(n, 0) + 1
                own = f"{n}-{last[n]}"
            taken.add(own)
            out.append(own)
        return pdf.drop(columns="_walk").assign(unique_name=out)

    walked = rows.filter("_walk").groupBy(*group).applyInPandas(walk, plain.drop("_walk").schema)
    return plain.drop("_walk").unionByName(walked)


def override_durations(segments: DataFrame, entries: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Durations of ``segments`` (…, segment_index, moof_offset, duration) from index entries where two neighbours point
    at the segment and at the one after it; entries: (keys, entry_index, time, moof_offset)."""
    w = Window.partitionBy(*keys).orderBy("entry_index")
    steps = entries.withColumns({"_next": F.lead("moof_offset").over(w), "_gap": F.lead("time").over(w) - F.col("time")}).filter("_next is not null").select(*keys, "moof_offset", "_next", "_gap")
    own = segments.withColumn("_after", F.lead("moof_offset").over(Window.partitionBy(*keys).orderBy("segment_index")))
    out = own.join(steps, [*keys, "moof_offset"], "left")
    return out.withColumn("duration", F.when(F.col("_next") == F.col("_after"), F.col("_gap")).otherwise(F.col("duration"))).drop("_after", "_next", "_gap")


def threshold_segments(df: DataFrame, duration: int, slack: int = 0, keys: list[str] = TRACK) -> DataFrame:
    """``segment_index`` by cutting at the first sync sample that is ``duration - slack`` past the last cut.

    Where the next cut falls depends on the last one, so the sync samples of a track are walked, from cut to cut by
    bisection; all samples then count the cuts up to them. Drift accumulates, unlike on a fixed grid.
    """
    step = max(0, duration - slack)
    first = F.min("sample_index").over(Window.partitionBy(*keys))
    marks = df.withColumn("_first", F.col("sample_index") == first).filter("is_sync or _first").select(*keys, "sample_index", "dts")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_index", ignore_index=True)
        dts = pdf["dts"].to_numpy()
        reached = np.maximum.accumulate(dts)
        cuts, at = [0], 0
        while (at := max(at + 1, int(np.searchsorted(reached, dts[at] + step)))) < len(dts):
            if dts[at] >= dts[cuts[-1]] + step:
                cuts.append(at)
            else:  # before the greatest time so far
                later = np.flatnonzero(dts[at:] >= dts[cuts[-1]] + step)
                if not len(later):
                    break
                at += int(later[0])
                cuts.append(at)
        return pdf.loc[cuts, [*keys, "sample_index"]].assign(_cut=1)

    schema = StructType([*marks.select(*keys, "sample_index").schema.fields, StructField("_cut", LongType())])
    cuts = marks.groupBy(*keys).applyInPandas(walk, schema)
    w = Window.partitionBy(*keys).orderBy("sample_index")
    out = df.join(cuts, [*keys, "sample_index"], "left")
    return out.withColumn("segment_index", (F.sum(F.coalesce("_cut", F.lit(0))).over(w) - 1).cast("long")).drop("_cut")


def grid_segments(df: DataFrame, duration: int, keys: list[str] = TRACK) -> DataFrame:
    """``segment_index`` by absolute multiples of ``duration``, each snapped to the sync sample closest to it."""
    from strobila.operators.seek import closest_sync

    cuts = closest_sync(df, duration, keys).select(*keys, "sample_index").distinct().withColumn("_cut", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("sample_index")
    out = df.join(cuts, [*keys, "sample_index"], "left")
    return out.withColumn("segment_index", F.greatest(F.sum(F.coalesce("_cut", F.lit(0))).over(w) - 1, F.lit(0)).cast("long")).drop("_cut")


def bandwidth(segments: DataFrame, buffer_seconds: float, keys: list[str] = TRACK) -> DataFrame:
    """(keys, bandwidth): bits a second at which a buffer of ``buffer_seconds`` does not run dry, cut to a whole number.

    Starts are taken in order. From a start on, the bytes taken are held against a buffer filled at the rate that holds
    so far and what is delivered at that rate; at the first overrun after some time has passed the rate becomes what the
    bytes beyond the buffer need, and the next start follows. Segments: (keys, segment_index, size, seconds).
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment_index")
        size, seconds = pdf["size"].to_numpy(float), pdf["seconds"].to_numpy(float)
        taken, passed = np.r_[0.0, np.cumsum(size)], np.r_[0.0, np.cumsum(seconds)]
        rate, start = 0.0, 0
        while start < len(size):
            # Bytes taken less bytes delivered; a start from which the most of that ahead fits has no overrun.
            left, room = taken - passed * rate / 8, buffer_seconds * rate / 8
            ahead = np.maximum.accumulate(left[:0:-1])[::-1]
            near = np.flatnonzero(ahead[start:] > left[start:-1] + room - 1e-6 * (1 + np.abs(left[start:-1]) + room))
            if not len(near):
                break
            start += int(near[0])
            own, time = np.cumsum(size[start:]), np.cumsum(seconds[start:])
            over = np.flatnonzero((own > room + time * rate / 8) & (time != 0))
            if len(over):
                rate = 8 * (own[over[0]] - room) / time[over[0]]
            start += 1
        return pdf.iloc[:1][keys].assign(bandwidth=int(rate))

    return segments.select(*keys, "segment_index", "size", "seconds").groupBy(*keys).applyInPandas(walk, StructType([*segments.select(*keys).schema.fields, StructField("bandwidth", LongType())]))


def drop_similar_rates(df: DataFrame, group: list[str], order: str = "ordinal", rate: str = "bandwidth", within: float = 0.1) -> DataFrame:
    """Rows of a group in order, without those whose rate differs from one already kept by less than a share of that."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, take = pdf.sort_values(order), [], []
        for r in pdf[rate]:
            alike = any(k and abs((k - r) / k) < within for k in kept)
            take.append(not alike)
            if not alike:
                kept.append(r)
        return pdf[take]

    return df.groupBy(*group).applyInPandas(walk, df.schema)


def plan_fragments(df: DataFrame, duration: int, timescale: int, anchor: DataFrame) -> DataFrame:
    """(file, track_id, fragment_index, first_sample, sample_count): every track of a file cut where its anchor is.

    ``anchor`` (file, track_id) names the track whose sync samples decide; the others are cut at the first sample at or
    after the anchor's cut, in their common clock.
    """
    own = df.join(anchor, ["file", "track_id"], "left_semi")
    cuts = grid_segments(own, duration * timescale).groupBy("file", "segment_index").agg(F.min("dts").alias("dts"))
    rows = df.select("file", "track_id", "sample_index", "dts")
    marks = cuts.select("file", F.col("dts").alias("_t"), F.lit(0).alias("_kind"), F.col("segment_index"), F.lit(None).cast("long").alias("track_id"), F.lit(None).cast("long").alias("sample_index"))
    body = rows.select("file", F.col("dts").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("segment_index"), "track_id", "sample_index")
    w = Window.partitionBy("file").orderBy("_t", "_kind")
    out = marks.unionByName(body).withColumn("fragment_index", F.coalesce(F.last("segment_index", ignorenulls=True).over(w), F.lit(0)).cast("long")).filter("_kind = 1")
    return out.groupBy("file", "track_id", "fragment_index").agg(F.min("sample_index").alias("first_sample"), F.count("*").alias("sample_count"))


