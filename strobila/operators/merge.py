"""Interleaving tracks, comparing files, joins of samples with side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strobila.operators.runs import TRACK


def interleave(df: DataFrame, by: str = "dts", last_wins: bool = False) -> DataFrame:
    """``position``: 0-based place of a sample when a file's tracks are read together in order of ``by``.

    Ties go to the smaller track_id, or with ``last_wins`` to the greater.
    """
    tie = F.col("track_id").desc() if last_wins else F.col("track_id")
    w = Window.partitionBy("file").orderBy(by, tie, "sample_index")
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def not_monotonic(df: DataFrame, by: str = "offset") -> DataFrame:
    """Tracks in which ``by`` falls somewhere: their order of reading is that of the heads, not a global sort."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    return df.withColumn("_fall", F.lag(by).over(w) > F.col(by)).filter("_fall").select(*TRACK).distinct()


def greedy_interleave(df: DataFrame, by: str = "offset") -> DataFrame:
    """``position`` for tracks that need not be monotonic: always the track whose next sample has the least ``by``.

    A sample is read when all tracks' heads are at or above it, that is in order of the running maximum within its
    track, so one running maximum and one sort give the same order as merging by heads.
    """
    own = Window.partitionBy(*TRACK).orderBy("sample_index").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy("file").orderBy("_reach", "track_id", "sample_index")
    return df.withColumn("_reach", F.max(by).over(own)).withColumn("position", (F.row_number().over(w) - 1).cast("long")).drop("_reach")


def switch_runs(df: DataFrame) -> DataFrame:
    """From ``position``: ``run``, which grows when the track changes, and ``switch``, which flips with it."""
    w = Window.partitionBy("file").orderBy("position")
    turn = F.when(F.col("track_id") != F.lag("track_id").over(w), 1).otherwise(0)
    out = df.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w).cast("long")).drop("_turn")
    return out.withColumn("switch", (F.col("run") % 2).cast("int"))


def buffer_peak(df: DataFrame) -> DataFrame:
    """(file, peak): most bytes held when samples arrive in reading order and a track's last one leaves at its next."""
    w = Window.partitionBy("file").orderBy("position")
    own = Window.partitionBy(*TRACK).orderBy("position")
    held = F.col("size") - F.coalesce(F.lag("size").over(own), F.lit(0))
    return df.withColumn("_held", held).withColumn("_full", F.sum("_held").over(w)).groupBy("file").agg(F.max("_full").cast("long").alias("peak"))


def positional_diff(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], fields: list[str], full: bool = True) -> DataFrame:
    """Rows side by side by place within a key that differ in a field; with ``full`` also those without a partner.

    ``status``: ``differs``, ``left_only`` or ``right_only``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)

    def placed(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("place", (F.row_number().over(w) - 1).cast("long")).select(*keys, "place", F.struct(*fields).alias(side))

    both = placed(a, "l").join(placed(b, "r"), [*keys, "place"], "full" if full else "inner")
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("differs")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))
    cols = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in fields for s in ("l", "r")]
    return both.filter(F.col("l").isNull() | F.col("r").isNull() | differs).select(*keys, "place", status.alias("status"), *cols)


def dangling(pointers: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Index entries that point at nothing."""
    return pointers.join(targets.select(*on).distinct(), on, "left_anti")


def cascade(*levels: Column | int) -> Column:
    """The first value present: a run's entry, its fragment's default, the track's default, or a constant."""
    return F.coalesce(*[F.lit(v) if isinstance(v, int) else v for v in levels])


def matches(groups: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every video track with every audio group that its pattern list admits: ``*`` all, a name, or ``-`` none.

    ``tracks``: (track, match ARRAY<STRING>); ``groups``: (group). A track that admits all is repeated for each of a few
    lots of the groups and joined with the lot, so that neither side meets in one task, however many there are of either.
    """
    lots = 16
    named = tracks.withColumn("group", F.explode("match")).join(groups, "group", "inner").select("track", "group")
    stars = tracks.filter(F.array_contains("match", "*")).select("track", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"))
    every = stars.join(groups.select("group", F.pmod(F.hash("group"), F.lit(lots)).alias("_lot")), "_lot").select("track", "group")
    return named.unionByName(every).distinct()
