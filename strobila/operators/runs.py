"""Run-length encoding and decoding, running sums and chunk layout of samples, all by windows over a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["file", "track_id"]


def _ordered(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def run_ids(df: DataFrame, value: Column, keys: list[str] = TRACK, order: str = "sample_index", name: str = "run") -> DataFrame:
    """``name``: 0-based number of the run of equal values that a row is in."""
    w = _ordered(keys, order)
    first = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_turn", first).withColumn(name, F.sum("_turn").over(w).cast("long")).drop("_turn")


def encode_runs(df: DataFrame, value: str, keys: list[str] = TRACK, order: str = "sample_index") -> DataFrame:
    """(keys, entry_index, sample_count, value): one row for each run of equal values."""
    rows = run_ids(df.select(*keys, order, value), F.col(value), keys, order, "entry_index")
    return rows.groupBy(*keys, "entry_index").agg(F.count("*").alias("sample_count"), F.min(value).alias("value"))


#: Rows that one step of an expansion makes of a row, so that no array holds a long run.
_STEP = 1 << 16


def expanded(rows: DataFrame, count: str, name: str = "_k", most: int | None = None) -> DataFrame:
    """A row for each of ``count`` of a row, numbered from 0: first the steps of a long run, then the rows of a step. With
    ``most``, for files that are not trusted, a greater count raises an error."""
    if most is not None:
        rows = rows.withColumn(count, F.when(F.col(count) > most, F.raise_error(F.lit("a run's count is out of bounds")).cast("long")).otherwise(F.col(count)))
    steps = rows.filter(F.col(count) > 0).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / _STEP).cast("long"))))
    first = F.col("_step") * _STEP
    return steps.withColumn(name, F.explode(F.sequence(first, F.least(first + _STEP, F.col(count)) - 1))).drop("_step")


def decode_runs(runs: DataFrame, keys: list[str] = TRACK, most: int | None = None) -> DataFrame:
    """(keys, sample_index, value) from runs of any length, or of ``most`` at most."""
    w = Window.partitionBy(*keys).orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    started = runs.withColumn("_first", F.coalesce(F.sum("sample_count").over(w), F.lit(0)).cast("long"))
    return expanded(started, "sample_count", most=most).select(*keys, (F.col("_first") + F.col("_k")).alias("sample_index"), "value")


def decode_times(runs: DataFrame, keys: list[str] = TRACK, most: int | None = None) -> DataFrame:
    """(keys, sample_index, duration, dts) from runs of durations of any length, or of ``most`` at most."""
    w = Window.partitionBy(*keys).orderBy("entry_index").rowsBetween(Window.unboundedPreceding, -1)
    started = runs.withColumns({"_first": F.coalesce(F.sum("sample_count").over(w), F.lit(0)).cast("long"), "_dts": F.coalesce(F.sum(F.col("sample_count") * F.col("value")).over(w), F.lit(0)).cast("long")})
    out = expanded(started, "sample_count", most=most)
    return out.select(*keys, (F.col("_first") + F.col("_k")).alias("sample_index"), F.col("value").alias("duration"), (F.col("_dts") + F.col("_k") * F.col("value")).alias("dts"))


def sum_before(df: DataFrame, value: str, name: str, keys: list[str] = TRACK, order: str = "sample_index", origin: int = 0) -> DataFrame:
    """``name``: sum of ``value`` over all earlier rows of the key, from ``origin``."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, (F.coalesce(F.sum(value).over(w), F.lit(0)) + origin).cast("long"))


def assign_chunks(df: DataFrame, per_chunk: int, keys: list[str] = TRACK) -> DataFrame:
    """``chunk_index``: a chunk ends when it holds ``per_chunk`` samples or the sample description changes.

    A change starts a new count, so a sample's chunk follows from its place in its run of one description.
    """
    w = _ordered(keys, "sample_index")  # of all windows, so that a track is sorted once
    value = F.col("description_index")
    turn = F.lag(F.lit(1)).over(w).isNull() | ~value.eqNullSafe(F.lag(value).over(w))
    rows = df.withColumns({"_turn": turn, "_k": F.row_number().over(w)})
    rows = rows.withColumn("_in_run", F.col("_k") - F.last(F.when(F.col("_turn"), F.col("_k")), ignorenulls=True).over(w))
    return rows.withColumn("chunk_index", F.sum(F.when(F.col("_in_run") % per_chunk == 0, 1).otherwise(0)).over(w).cast("long")).drop("_turn", "_k", "_in_run")


def chunk_layout(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """From samples with chunk_index: ``chunk_offset`` and ``offset`` when chunks follow one another in a track."""
    w = _ordered(keys, "sample_index")
    chunk = F.col("chunk_index")
    first = F.lag(F.lit(1)).over(w).isNull() | ~chunk.eqNullSafe(F.lag(chunk).over(w))
    rows = df.withColumns({"offset": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"), "_first": first})
    return rows.withColumn("chunk_offset", F.last(F.when(F.col("_first"), F.col("offset")), ignorenulls=True).over(w)).drop("_first")


def encode_chunk_map(df: DataFrame, keys: list[str] = TRACK, merge: bool = False) -> DataFrame:
    """(keys, entry_index, first_chunk, samples_per_chunk, description_index): an entry for each chunk, or with ``merge``
    for each run of alike chunks."""
    chunks = df.groupBy(*keys, "chunk_index").agg(F.count("*").alias("samples_per_chunk"), F.min("description_index").alias("description_index"))
    if not merge:
        return chunks.select(*keys, (F.col("chunk_index") - 1).alias("entry_index"), F.col("chunk_index").alias("first_chunk"), "samples_per_chunk", "description_index")
    rows = run_ids(chunks, F.struct("samples_per_chunk", "description_index"), keys, "chunk_index", "entry_index")
    return rows.groupBy(*keys, "entry_index").agg(F.min("chunk_index").alias("first_chunk"), F.min("samples_per_chunk").alias("samples_per_chunk"), F.min("description_index").alias("description_index"))


def expand_chunk_map(stsc: DataFrame, chunks: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, chunk_index, offset, samples_per_chunk, description_index, first_sample) for every chunk of ``chunks``
    (keys, chunk_index, offset): a range join, each entry up to the next one's first chunk, the last without bound."""
    w = Window.partitionBy(*keys).orderBy("chunk_index")
    marks = stsc.select(*keys, F.col("first_chunk").alias("chunk_index"), "samples_per_chunk", "description_index", F.lit(0).alias("_chunk"), F.lit(None).cast("long").alias("offset"))
    rows = chunks.select(*keys, "chunk_index", F.lit(None).cast("long").alias("samples_per_chunk"), F.lit(None).cast("long").alias("description_index"), F.lit(1).alias("_chunk"), "offset")
    both = Window.partitionBy(*keys).orderBy("chunk_index", "_chunk")
    filled = marks.unionByName(rows)
    for c in ("samples_per_chunk", "description_index"):
        filled = filled.withColumn(c, F.last(c, ignorenulls=True).over(both))
    filled = filled.filter("_chunk = 1").drop("_chunk")
    before = F.sum("samples_per_chunk").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return filled.withColumn("first_sample", F.coalesce(before, F.lit(0)).cast("long"))


def sync_table(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, sample_number): 1-based sync samples, and none for a track of which all samples, or none, are sync."""
    w = Window.partitionBy(*keys)
    mixed = F.min(F.col("is_sync").cast("int")).over(w) != F.max(F.col("is_sync").cast("int")).over(w)
    return df.withColumn("_mixed", mixed).filter("_mixed and is_sync").select(*keys, (F.col("sample_index") + 1).alias("sample_number"))


def offset_table(chunks: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """(keys, kind, chunk_count): 32-bit chunk offsets suffice if the last chunk begins below 2**32."""
    g = chunks.groupBy(*keys).agg(F.max_by("chunk_offset", "chunk_index").alias("_last"), F.countDistinct("chunk_index").alias("chunk_count"))
    return g.select(*keys, F.when(F.col("_last") <= 0xFFFFFFFF, "stco").otherwise("co64").alias("kind"), "chunk_count")


def composition_table(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Runs of cts deltas, none for a track whose deltas are all 0. A constant delta other than 0 is kept."""
    some = F.max(F.when(F.col("cts_delta") != 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return encode_runs(df.withColumn("_some", some).filter("_some = 1"), "cts_delta", keys)


def timeline(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, entry_index, d, r): durations with the number of repeats after the first, null for none."""
    runs = encode_runs(df, value, keys, order)
    return runs.select(*keys, "entry_index", F.col("value").alias("d"), F.when(F.col("sample_count") > 1, F.col("sample_count") - 1).alias("r"))
