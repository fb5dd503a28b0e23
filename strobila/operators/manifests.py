"""Playlists and manifests as ordered lines, made from segments and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strobila.functions.scalars import iso_duration, target_duration_ceiling, target_duration_rounded


def document(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, text): the lines of each document joined in order; a manifest fits in a task."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*keys).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def media_playlist(segments: DataFrame, keys: list[str], url: Column, version: int = 3, rounded: bool = False, byte_ranges: bool = False, key_uri: str | None = None, method: str = "AES-128", iv: str | None = None, map_uri: str | None = None) -> DataFrame:
    """(keys, position, line): a video-on-demand playlist of segments (keys, segment_index, seconds[, size, offset]).

    ``key_uri``, ``method`` and ``iv`` (hex) say how segments are encrypted, ``map_uri`` where their header is.
    """
    extra = []
    if map_uri is not None:
        extra.append(f'#EXT-X-MAP:URI="{map_uri}"')
    if key_uri is not None:
        extra.append(f'#EXT-X-KEY:METHOD={method},URI="{key_uri}"' + (f",IV=0x{iv}" if iv else ""))
    longest = segments.groupBy(*keys).agg(F.max("seconds").alias("_longest"))
    target = target_duration_rounded(F.col("_longest")) if rounded else target_duration_ceiling(F.col("_longest"))
    head = longest.select(*keys, F.posexplode(F.array(F.lit("#EXTM3U"), F.lit(f"#EXT-X-VERSION:{version}"), F.lit("#EXT-X-PLAYLIST-TYPE:VOD"), F.concat(F.lit("#EXT-X-TARGETDURATION:"), target.cast("string")), F.lit("#EXT-X-MEDIA-SEQUENCE:0"), *map(F.lit, extra))).alias("_k", "line"))
    head = head.select(*keys, (F.col("_k") - 5 - len(extra)).cast("long").alias("position"), "line")
    own = [F.format_string("#EXTINF:%.6f,", F.col("seconds"))]
    if byte_ranges:
        own.append(F.concat(F.lit("#EXT-X-BYTERANGE:"), F.col("size").cast("string"), F.lit("@"), F.col("offset").cast("string")))
    own.append(url)
    body = segments.select(*keys, "segment_index", F.posexplode(F.array(*own)).alias("_k", "line"))
    body = body.select(*keys, (F.col("segment_index") * len(own) + F.col("_k")).cast("long").alias("position"), "line")
    tail = longest.select(*keys, F.lit((1 << 62)).alias("position"), F.lit("#EXT-X-ENDLIST").alias("line"))
    return head.unionByName(body).unionByName(tail)


def sync_playlist(syncs: DataFrame, keys: list[str], url: Column) -> DataFrame:
    """(keys, position, line): a playlist of sync samples (keys, sample_index, seconds, offset, size) by byte range."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    rows = syncs.withColumn("segment_index", (F.row_number().over(w) - 1).cast("long"))
    out = media_playlist(rows, keys, url, version=4, byte_ranges=True)
    return out.withColumn("line", F.when(F.col("line") == "#EXT-X-PLAYLIST-TYPE:VOD", "#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-I-FRAMES-ONLY").otherwise(F.col("line")))


def master_playlist(variants: DataFrame, audio: DataFrame) -> DataFrame:
    """(presentation, text). Variants: presentation, name, bandwidth, average, codecs, width, height, audio_group;
    audio: presentation, audio_group, name, language, is_default, url. An attribute without a value is left out, a track
    never."""
    quoted = lambda name, c: F.concat(F.lit(f'{name}="'), F.col(c).cast("string"), F.lit('"'))
    plain = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    default = F.concat(F.lit("DEFAULT="), F.when(F.col("is_default"), "YES").otherwise("NO"))
    media = F.concat(F.lit("#EXT-X-MEDIA:"), F.concat_ws(",", F.lit("TYPE=AUDIO"), quoted("GROUP-ID", "audio_group"), quoted("LANGUAGE", "language"), quoted("NAME", "name"), F.lit("AUTOSELECT=YES"), default, quoted("URI", "url")))
    a = audio.select("presentation", F.lit(1).alias("part"), F.coalesce("audio_group", F.lit("")).alias("k1"), F.coalesce("name", F.lit("")).alias("k2"), media.alias("line"))
    size = F.concat(F.lit("RESOLUTION="), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    info = F.concat(F.lit("#EXT-X-STREAM-INF:"), F.concat_ws(",", quoted("AUDIO", "audio_group"), plain("AVERAGE-BANDWIDTH", "average"), plain("BANDWIDTH", "bandwidth"), quoted("CODECS", "codecs"), size), F.lit("\n"), "name", F.lit(".m3u8"))
    v = variants.select("presentation", F.lit(2).alias("part"), F.lpad(F.coalesce(F.col("bandwidth"), F.lit(0)).cast("string"), 20, "0").alias("k1"), F.col("name").alias("k2"), info.alias("line"))
    head = variants.select("presentation").distinct().select("presentation", F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit("#EXTM3U\n#EXT-X-VERSION:6").alias("line"))
    return document(head.unionByName(a).unionByName(v), ["presentation"], ["part", "k1", "k2"])


def _attr(name: str, value: Column) -> Column:
    """An attribute, or nothing where there is no value."""
    escaped = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit(f' {name}="'), escaped, F.lit('"')), F.lit(""))


def _joined(value: str, *order: str) -> Column:
    """The texts of a group in order, a line for each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "\n")


def dash_manifest(tracks: DataFrame, timelines: DataFrame) -> DataFrame:
    """(presentation, text): an MPD. Tracks: presentation, set_name, mime, track, codecs, bandwidth, seconds, timescale,
    and if known language and default_kid; timelines: presentation, track, entry_index, d, r.

    One adaptation set for each set_name, tracks by bandwidth. The duration is that of the first video track, of an audio
    track where there is none, else of any. An attribute without a value is left out, a track never; a set whose tracks
    have a key id says how it is protected.
    """
    for c in ("language", "default_kid"):
        if c not in tracks.columns:
            tracks = tracks.withColumn(c, F.lit(None).cast("string"))
    s = F.concat(F.lit("          <S"), _attr("d", F.col("d")), _attr("r", F.col("r")), F.lit("/>"))
    runs = timelines.withColumn("s", s).groupBy("presentation", "track").agg(_joined("s", "entry_index").alias("_s"))
    timeline = F.concat(F.lit("          <SegmentTimeline>\n"), F.col("_s"), F.lit("\n          </SegmentTimeline>\n"))
    rep = F.concat(
        F.lit("      <Representation"), _attr("id", F.col("track")), _attr("codecs", F.col("codecs")), _attr("bandwidth", F.col("bandwidth")), F.lit(">\n        <SegmentTemplate"), _attr("timescale", F.col("timescale")),
        F.lit(' initialization="$RepresentationID$/init.mp4" media="$RepresentationID$/seg-$Number$.m4s" startNumber="1">\n'), F.coalesce(timeline, F.lit("")), F.lit("        </SegmentTemplate>\n      </Representation>"),
    )
    rows = tracks.join(runs, ["presentation", "track"], "left").withColumn("_rep", rep)
    kind = F.when(F.col("mime").startswith("video"), 0).when(F.col("mime").startswith("audio"), 1).otherwise(2)
    first = F.min(F.when(F.col("seconds").isNotNull(), F.struct(kind.alias("kind"), "track", "seconds"))).alias("_first")
    sets = rows.groupBy("presentation", "set_name", "mime").agg(_joined("_rep", "bandwidth", "track").alias("_reps"), first, F.min("language").alias("_lang"), F.min("default_kid").alias("_kid"))
    guard = F.coalesce(F.concat(F.lit('      <ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc" xmlns:cenc="urn:mpeg:cenc:2013"'), F.when(F.col("_kid").isNotNull(), _attr("cenc:default_KID", F.col("_kid"))), F.lit("/>\n")), F.lit(""))
    body = F.concat(F.lit("    <AdaptationSet"), _attr("mimeType", F.col("mime")), _attr("lang", F.col("_lang")), F.lit(">\n"), guard, F.col("_reps"), F.lit("\n    </AdaptationSet>"))
    whole = sets.withColumn("_body", body).groupBy("presentation").agg(_joined("_body", "set_name", "mime").alias("_sets"), F.min("_first").alias("_first"))
    head = F.concat(F.lit('<?xml version="1.0"?>\n<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static"'), _attr("mediaPresentationDuration", iso_duration(F.col("_first.seconds"))), F.lit(' profiles="urn:mpeg:dash:profile:isoff-live:2011">\n  <Period>\n'))
    return whole.select("presentation", F.concat(head, F.col("_sets"), F.lit("\n  </Period>\n</MPD>\n")).alias("text"))


def smooth_manifest(tracks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(presentation, text): a client manifest. Tracks: presentation, kind, track, bandwidth, codec; chunks:
    presentation, kind, segment_index, duration in units of 100 ns."""
    level = F.concat(F.lit("    <QualityLevel"), _attr("Bitrate", F.col("bandwidth")), _attr("FourCC", F.col("codec")), F.lit("/>"))
    levels = tracks.groupBy("presentation", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bandwidth", "track", level.alias("x")))), lambda r: r["x"]), "\n").alias("_levels"))
    chunk = F.concat(F.lit("    <c"), _attr("d", F.col("duration")), F.lit("/>"))
    parts = chunks.groupBy("presentation", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", chunk.alias("x")))), lambda r: r["x"]), "\n").alias("_chunks"), F.count("*").alias("_n"), F.sum("duration").alias("_d"))
    index = F.concat(F.lit("  <StreamIndex"), _attr("Chunks", F.col("_n")), _attr("Type", F.col("kind")), F.lit(">\n"), F.col("_levels"), F.lit("\n"), F.col("_chunks"), F.lit("\n  </StreamIndex>"))
    rows = levels.join(parts, ["presentation", "kind"])
    whole = rows.groupBy("presentation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", index.alias("x")))), lambda r: r["x"]), "\n").alias("_x"), F.max("_d").alias("_d"))
    return whole.select("presentation", F.concat(F.lit('<?xml version="1.0"?>\n<SmoothStreamingMedia MajorVersion="2" MinorVersion="0"'), _attr("Duration", F.col("_d")), F.lit(">\n"), F.col("_x"), F.lit("\n</SmoothStreamingMedia>\n")).alias("text"))
