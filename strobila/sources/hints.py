"""Hint tracks: the packets that their samples describe, put together from media samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTS = (
    "file string, track_id long, sample_index long, packet long, part long, relative_time long, header binary, kind int, immediate binary, "
    "reference int, sample_number long, start long, length long"
)


def hint_parts(data: bytes) -> list[tuple]:
    """(packet, part, relative time, packet header, kind, immediate bytes, track reference, sample number, start, length)
    of a hint sample. Kind 1: bytes given here; 2: bytes of a media sample; others add nothing."""
    out, at = [], 4
    for packet in range(int.from_bytes(data[:2], "big")):
        time = int.from_bytes(data[at : at + 4], "big", signed=True)
        head, flags, count = data[at + 4 : at + 8], int.from_bytes(data[at + 8 : at + 10], "big"), int.from_bytes(data[at + 10 : at + 12], "big")
        at += 12
        if flags & 4:
            at += int.from_bytes(data[at : at + 4], "big")
        if not count:
            out.append((packet, 0, time, head, 0, b"", 0, 0, 0, 0))
        for part in range(count):
            c = data[at : at + 16]
            if len(c) < 16:
                raise ValueError("a hint sample ends early")
            kind = c[0]
            if kind == 1:
                out.append((packet, part, time, head, 1, c[2 : 2 + c[1]], 0, 0, 0, c[1]))
            elif kind == 2:
                out.append((packet, part, time, head, 2, b"", int.from_bytes(c[1:2], "big", signed=True), int.from_bytes(c[4:8], "big"), int.from_bytes(c[8:12], "big"), int.from_bytes(c[2:4], "big")))
            else:
                out.append((packet, part, time, head, kind, b"", 0, 0, 0, 0))
            at += 16
    return out


def packets(hints: DataFrame, media: DataFrame, ssrc: int = 0) -> DataFrame:
    """(file, track_id, sample_index, packet, relative_time, content): RTP packets of hint samples.

    ``hints``: file, track_id, sample_index, rtp_time, media_track_id, data; ``media``: file, track_id, sample_index, data.
    Media bytes come by an equi-join on the sample number; a part that points at no sample makes its packet null.
    """

    def work(batches):
        for pdf in batches:
            rows = [(f, t, s, *p) for f, t, s, d in zip(pdf["file"], pdf["track_id"], pdf["sample_index"], pdf["data"]) for p in hint_parts(bytes(d))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARTS.split(", ")])

    key = ["file", "track_id", "sample_index"]
    parts = hints.select(*key, "data").mapInPandas(work, _PARTS).join(hints.select(*key, "rtp_time", "media_track_id"), key)
    source = media.select("file", F.col("track_id").alias("media_track_id"), (F.col("sample_index") + 1).alias("sample_number"), F.col("data").alias("_data"))
    joined = parts.join(source, ["file", "media_track_id", "sample_number"], "left")
    piece = F.when(F.col("kind") == 1, F.col("immediate")).when(F.col("kind") == 2, F.expr("substring(_data, cast(start + 1 as int), cast(length as int))")).otherwise(F.lit(b""))
    g = joined.withColumn("_piece", piece).groupBy(*key, "packet", "relative_time", "header", "rtp_time")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("_piece").alias("x")))), lambda r: r["x"]), "")
    whole = g.agg(body.alias("_body"), F.count_if(F.col("_piece").isNull()).alias("_lost"))
    # First two bytes: version 2 with the header's padding, extension, marker and payload type; then its number.
    h = F.hex("header")
    first = F.lpad(F.hex((F.conv(F.substring(h, 1, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x30))).bitwiseOR(F.lit(0x80))), 2, "0")
    stamp = F.lpad(F.hex((F.col("rtp_time") + F.col("relative_time")).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    content = F.unhex(F.concat(first, F.substring(h, 3, 2), F.substring(h, 5, 4), stamp, F.lit(f"{ssrc:08X}"), F.col("_body")))
    return whole.select(*key, "packet", "relative_time", F.when(F.col("_lost") == 0, content).alias("content"))


def numbered(packets_: DataFrame) -> DataFrame:
    """``packets_`` with ``position``: their order in the track."""
    w = Window.partitionBy("file", "track_id").orderBy("sample_index", "packet")
    return packets_.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
