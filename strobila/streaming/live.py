"""Live operators: samples that arrive are cut into segments with state, or counted in event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENTS = "file string, track_id long, segment_index long, first_sample long, sample_count long, size long, duration long"
_STATE = "segment_index long, started long, first_sample long, sample_count long, size long, ended long"


def samples_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sample rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def threshold_segments(samples: DataFrame, duration: int, slack: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Segments of every track as they close: at the first sync sample that is ``duration - slack`` past the last cut.

    The state of a track is its open segment's sums. Samples of a track arrive in decoding order across batches and are
    put in order within one. An open segment stays open until a later sync sample closes it, or, with ``idle_ms``, until
    no sample of its track has come for so many milliseconds: it is then the track's last one.
    """
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            index, started, first, count, size, ended = state.get
            state.remove()
            if count:
                yield pd.DataFrame([(*key, index, first, count, size, ended - started)], columns=names)
            return
        index, started, first, count, size, ended = state.get if state.exists else (0, -1, 0, 0, 0, 0)
        rows = pd.concat(list(pdfs)).sort_values("sample_index")
        out = []
        for r in rows.itertuples(index=False):
            if started < 0:
                started, first = r.dts, r.sample_index
            elif r.is_sync and r.dts - started >= duration - slack:
                out.append((*key, index, first, count, size, r.dts - started))
                index, started, first, count, size = index + 1, r.dts, r.sample_index, 0, 0
            count, size, ended = count + 1, size + r.size, r.dts + r.duration
        state.update(tuple(int(x) for x in (index, started, first, count, size, ended)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    out = samples.groupBy("file", "track_id").applyInPandasWithState(step, SEGMENTS, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    # A projection that computes: a partitioned sink cannot sort the stateful operator's own rows.
    return out.withColumn("segment_index", F.coalesce("segment_index", F.lit(0).cast("long")))


def windowed_rates(samples: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bytes and samples of every track in event-time windows; what comes later than ``late`` is left out."""
    w = samples.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "file", "track_id")
    return w.agg(F.count("*").alias("samples"), F.sum("size").alias("size")).select("file", "track_id", F.col("w.start").alias("start"), "samples", "size")


def write_segments(segments: DataFrame, path: str, checkpoint: str):
    """Closed segments appended below ``path``, by track; exactly once by the sink's log."""
    return segments.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("track_id").outputMode("append")
