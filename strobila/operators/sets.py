"""Tracks in sets: adaptation sets, their maxima, audio groups with their defaults and rates, selections, languages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobila.operators.runs import TRACK
from strobila.operators.segments import drop_similar_rates

#: The older three-letter codes of languages, beside those that the runtime's own table gives.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}


def languages(spark: SparkSession) -> dict[str, tuple[str, str]]:
    """Three-letter codes to (two-letter code, English name), from the runtime's table of ISO 639."""
    locale = spark._jvm.java.util.Locale
    out = {}
    for code in locale.getISOLanguages():
        if len(code) == 2:
            own = locale.forLanguageTag(code)
            out[own.getISO3Language()] = (own.getLanguage(), own.getDisplayLanguage(locale.ENGLISH))
    by_two = dict(out.values())
    return out | {three: (two, by_two[two]) for three, two in BIBLIOGRAPHIC.items() if two in by_two}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.element_at(pairs, key), key)


def with_language(tracks: DataFrame, column: str = "language", remap: dict[str, str] | None = None) -> DataFrame:
    """``tracks`` with the short code in place of ``column`` (unknown codes stay), then through ``remap``, and with
    ``language_name``, its English name or else the code."""
    known = languages(tracks.sparkSession)
    code = _lookup({k: v[0] for k, v in known.items()}, F.col(column))
    out = tracks.withColumn(column, _lookup(remap, code) if remap else code)
    return out.withColumn("language_name", _lookup(dict(known.values()), F.col(column)))


def max_per_set(tracks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, max_<column>, members): the greatest value of each column in a set; 0 where all are null."""
    return tracks.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c}") for c in columns], F.count("*").alias("members"))


def adaptation_sets(tracks: DataFrame, group: list[str]) -> DataFrame:
    """``tracks`` with ``set_key`` (array) and ``order_index`` (from 1), without those that a set does not take.

    Tracks: group, ordinal, type, language, codec, codec_family, label, bandwidth. Audio goes by language, codec and the
    number of its label, labels being numbered as they first occur in the group, and is taken unless its rate is within a
    tenth of one already taken; video by family; subtitles by language and family, the first track only. Other types are
    in no set.
    """
    label = F.coalesce("label", F.lit(""))
    w = Window.partitionBy(*group)
    rows = tracks.withColumn("_first", F.min("ordinal").over(Window.partitionBy(*group, label)))
    rows = rows.withColumn("_label", F.dense_rank().over(w.orderBy("_first")).cast("string"))
    key = (
        F.when(F.col("type") == "audio", F.array(F.lit("audio"), F.coalesce("language", F.lit("")), F.coalesce("codec", F.lit("")), "_label"))
        .when(F.col("type") == "video", F.array(F.lit("video"), F.coalesce("codec_family", F.lit(""))))
        .when(F.col("type") == "subtitles", F.array(F.lit("subtitles"), F.coalesce("language", F.lit("")), F.coalesce("codec_family", F.lit(""))))
    )
    rows = rows.withColumn("set_key", key).filter("set_key is not null").drop("_first", "_label")
    own = Window.partitionBy(*group, "set_key").orderBy("ordinal")
    audio = drop_similar_rates(rows.filter("type = 'audio'").withColumn("_set", F.array_join("set_key", "\x1f")), [*group, "_set"]).drop("_set")
    rest = rows.filter("type <> 'audio'").withColumn("_k", F.row_number().over(own)).filter("type = 'video' or _k = 1").drop("_k")
    return audio.unionByName(rest).withColumn("order_index", F.row_number().over(own).cast("long"))


def audio_groups(tracks: DataFrame, group: list[str]) -> DataFrame:
    """``tracks`` (group, ordinal, language, codec, audio_group) with a group for those that name none.

    Where these tracks of a presentation have one language, each is a group of its own, ``audio`` for a single one, else
    ``audio/1`` and so on; where they have several, tracks of one codec make the group ``audio/<codec>``.
    """
    w = Window.partitionBy(*group, F.col("audio_group").isNull())
    one = F.size(F.collect_set(F.coalesce("language", F.lit(""))).over(w)) == 1
    k, n = F.row_number().over(w.orderBy("ordinal")), F.count("*").over(w)
    own = F.when(one & (n == 1), F.lit("audio")).when(one, F.concat(F.lit("audio/"), k.cast("string"))).otherwise(F.concat(F.lit("audio/"), F.coalesce("codec", F.lit(""))))
    return tracks.withColumn("audio_group", F.coalesce("audio_group", own))


def group_rates(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_rate, peak_rate, codecs): the greatest rates of a group's tracks and its codecs in order."""
    return tracks.groupBy(*keys).agg(F.max("mean_rate").alias("mean_rate"), F.max("peak_rate").alias("peak_rate"), F.concat_ws(",", F.array_sort(F.collect_set("codec"))).alias("codecs"))


def with_defaults(tracks: DataFrame, keys: list[str], asked: str = "asked_default") -> DataFrame:
    """``is_default``: what a track asks for; of those that do not say, the first, unless an earlier one was selected."""
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.coalesce(F.col(asked), F.lit(True)).cast("int")).over(before), F.lit(0)) == 1
    return tracks.withColumn("is_default", F.coalesce(F.col(asked), ~earlier))


def nth_of_kind(tracks: DataFrame, kind: str, n: int, group: list[str], type_column: str = "type", order: str = "track_id") -> DataFrame:
    """The ``n``-th track (from 1) of a kind in each group."""
    w = Window.partitionBy(*group).orderBy(order)
    return tracks.filter(F.col(type_column) == kind).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == n).drop("_k")


def tracks_of(rows: DataFrame, ids: list[int], column: str = "track_id") -> DataFrame:
    """Rows of the listed tracks, for samples, track boxes and track defaults alike."""
    return rows.filter(F.col(column).isin(ids))


def tracks_with(rows: DataFrame, marks: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Rows whose track has at least one of ``marks``."""
    return rows.join(marks.select(*keys), keys, "left_semi")


def union_of(**parts: DataFrame) -> DataFrame:
    """The rows of all parts, with the part's name as ``kind``."""
    out = None
    for kind, part in parts.items():
        own = part.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The least ``order`` for each different ``keys``, such as each key id's first use."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def composition_times(samples: DataFrame) -> DataFrame:
    """``cts``: when a sample is shown, its decode time and delta."""
    return samples.withColumn("cts", F.col("dts") + F.col("cts_delta"))


def renumbered(rows: DataFrame, parent: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """``name``: places from 0 among what is left of a parent's rows."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def lookup_keys(tracks: DataFrame, keys: DataFrame) -> DataFrame:
    """``tracks`` (file, track_id, kid) with ``key``: by key id where ``keys`` (track_id, kid, key) has it, else by track;
    null where it has neither. A key row names a kid or a track."""
    by_kid = keys.filter("kid is not null").groupBy(F.lower("kid").alias("_kid")).agg(F.first("key").alias("_a"))
    by_track = keys.filter("kid is null").groupBy(F.col("track_id").alias("_track")).agg(F.first("key").alias("_b"))
    out = tracks.join(by_kid, F.lower(tracks.kid) == by_kid._kid, "left").join(by_track, tracks.track_id == by_track._track, "left")
    return out.withColumn("key", F.coalesce("_a", "_b")).drop("_kid", "_track", "_a", "_b")
