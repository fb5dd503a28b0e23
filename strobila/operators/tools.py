"""Whole-file tasks made of the other operators: clips, muxing, exports, splits, listings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strobila.operators.groups import Bytes, by_group
from strobila.operators.runs import TRACK, assign_chunks
from strobila.sources import writers


#: Bytes of tracks that leave a task at a time, and of the largest file that a row holds.
_HELD, _LARGEST = 1 << 22, (1 << 31) - 1
#: The matrix that leaves a picture as it is.
_UNITY = writers.words(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def clip(samples: DataFrame, start: int, duration: int) -> DataFrame:
    """Samples that play within ``duration`` ticks from ``start``, counted and timed anew; the one that covers the start
    is the first."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    kept = samples.filter((F.col("dts") + F.col("duration") > start) & (F.col("dts") < start + duration))
    first = F.min("dts").over(Window.partitionBy(*TRACK))
    return kept.withColumn("dts", F.col("dts") - first).withColumn("sample_index", (F.row_number().over(w) - 1).cast("long"))


def mux(samples: DataFrame, descriptions: DataFrame, timescales: DataFrame, per_chunk: int = 16) -> DataFrame:
    """(file, content): files of all tracks of a file name, sample tables first. Samples: TRACK, sample_index, duration,
    cts_delta, size, is_sync, description_index, data; descriptions: TRACK, handler, entry; timescales: TRACK, timescale.

    A track's tables and data are made by themselves; one task joins those of a file, which must fit in a task; longer ones
    are better written as fragments.
    """
    rows = assign_chunks(samples, per_chunk).join(descriptions, TRACK).join(timescales, TRACK)
    rows = rows.select(*TRACK, "sample_index", "duration", "cts_delta", "is_sync", "description_index", "chunk_index", "data", "handler", "entry", F.col("timescale").cast("long").alias("timescale"))
    names = ["file", "track_id", "trak", "first", "chunks", "millis", "data"]

    def tracks(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        duration, delta, sync, described, chunk = (rows.column(c).to_numpy() for c in ("duration", "cts_delta", "is_sync", "description_index", "chunk_index"))
        data, made, held = Bytes(rows.column("data")), [], 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            head = {c: rows.column(c)[a].as_py() for c in ("file", "track_id", "handler", "entry", "timescale")}
            own, total, scale, sound = slice(a, b), int(duration[a:b].sum()), head["timescale"], head["handler"] == "soun"
            millis = total * 1000 // scale if scale else 0
            size = data.sizes(a, b)
            tkhd = writers.full_box("tkhd", 0, 7, writers.words(0, 0, head["track_id"], 0, millis), bytes(12), b"\1\0" if sound else bytes(2), bytes(2), _UNITY, writers.words(0, 0))
            mdhd = writers.full_box("mdhd", 0, 0, writers.words(0, 0, scale, total), b"\x55\xc4\0\0")
            hdlr = writers.full_box("hdlr", 0, 0, bytes(4), head["handler"].encode(), bytes(12), b"\0")
            media = writers.full_box("smhd", 0, 0, bytes(4)) if sound else writers.full_box("vmhd", 0, 1, bytes(8)) if head["handler"] == "vide" else writers.full_box("nmhd", 0, 0)
            dinf = writers.box("dinf", writers.full_box("dref", 0, 0, writers.words(1), writers.full_box("url ", 0, 1)))
            # Offsets from the beginning of the track's data, until the file's layout is known.
            boxes = writers.tables(duration[own], delta[own], size, sync[own], chunk[own], described[own], np.cumsum(size) - size, head["entry"])
            trak = writers.box("trak", tkhd, writers.box("mdia", mdhd, hdlr, writers.box("minf", media, dinf, writers.box("stbl", *boxes))))
            last = boxes[-1] if boxes[-1][4:8] == b"stss" else b""
            chunks = int.from_bytes(boxes[-2 if last else -1][12:16], "big")
            made.append((head["file"], head["track_id"], trak, len(trak) - len(last) - 4 * chunks, chunks, millis, data.joined(a, b)))
            held += len(trak) + int(size.sum())
            if held >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)
                made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)

    def join(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            traks, data, ids = rows.column("trak").slice(a, b - a), rows.column("data").slice(a, b - a), rows.column("track_id").slice(a, b - a).to_pylist()
            first, chunks, millis = (rows.column(c).slice(a, b - a).to_pylist() for c in ("first", "chunks", "millis"))
            ftyp = writers.box("ftyp", b"isom", writers.words(0), b"isom")
            mvhd = writers.full_box("mvhd", 0, 0, writers.words(0, 0, 1000, max(0, *millis)), writers.words(0x10000), b"\1\0", bytes(10), _UNITY, bytes(24), writers.words(max(ids) + 1))
            sizes = [pc.binary_length(c).to_numpy().astype(np.int64) for c in (traks, data)]
            moov = 8 + len(mvhd) + int(sizes[0].sum())
            base, total = len(ftyp) + moov + 8, int(sizes[1].sum())
            if base + total > _LARGEST:
                raise ValueError(f"{rows.column('file')[a].as_py()} does not fit in a row; fragments would")
            content, at = bytearray(base + total), len(ftyp) + 8 + len(mvhd)
            content[:at] = ftyp + writers.words(moov) + b"moov" + mvhd
            content[base - 8 : base] = writers.words(total + 8) + b"mdat"
            place = base
            for i in range(b - a):
                trak, own = traks[i].as_py(), data[i].as_buffer()
                content[at : at + len(trak)] = trak
                offsets = np.frombuffer(trak, ">u4", chunks[i], first[i]).astype(np.int64) + place
                content[at + first[i] : at + first[i] + 4 * chunks[i]] = offsets.astype(">u4").tobytes()
                content[place : place + own.size] = memoryview(own)
                at, place = at + len(trak), place + own.size
            one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(content)], np.int32)), pa.py_buffer(content)])
            yield pa.RecordBatch.from_arrays([pa.array([rows.column("file")[a].as_py()], pa.string()), one], ["file", "content"])

    made = by_group(rows, TRACK, ["sample_index"], tracks, "file string, track_id long, trak binary, first long, chunks long, millis long, data binary")
    return by_group(made, ["file"], ["track_id"], join, "file string, content binary")


def aac_to_samples(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, descriptions, timescales) for ``mux`` of ADTS streams (path, content): frames without their headers, and
    an audio entry with the stream's configuration."""
    from strobila.functions.codecs import AAC_RATES, adts_frames

    schema = "file string, track_id long, sample_index long, duration long, cts_delta long, size long, is_sync boolean, description_index long, data binary, profile int, sample_rate long, channels int"

    def work(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                rows = [
                    (path, 1, k, f["samples"], 0, f["size"] - f["header_size"], True, 1, content[f["offset"] + f["header_size"] : f["offset"] + f["size"]], f["profile"], f["sample_rate"], f["channels"])
                    for k, f in enumerate(adts_frames(content))
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    frames = files.select("path", "content").mapInPandas(work, schema)
    first = frames.groupBy(*TRACK).agg(F.min_by(F.struct("profile", "sample_rate", "channels"), "sample_index").alias("f")).select(*TRACK, "f.*")

    @F.pandas_udf("binary")
    def entry(profile: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for p, r, c in zip(profile, rate, channels):
            config = (int(p) << 11 | AAC_RATES.index(int(r)) << 7 | int(c) << 3).to_bytes(2, "big")
            decoder = b"\x40\x15" + bytes(11) + b"\x05\x02" + config
            stream = b"\0\1\0\x04" + bytes([len(decoder)]) + decoder + b"\x06\x01\x02"
            esds = writers.full_box("esds", 0, 0, b"\x03", bytes([len(stream)]), stream)
            out.append(writers.box("mp4a", bytes(6), b"\0\1", bytes(8), int(c).to_bytes(2, "big"), b"\0\x10", bytes(4), (int(r) << 16).to_bytes(4, "big"), esds))
        return pd.Series(out)

    descriptions = first.select(*TRACK, F.lit("soun").alias("handler"), entry("profile", "sample_rate", "channels").alias("entry"))
    return frames.drop("profile", "sample_rate", "channels"), descriptions, first.select(*TRACK, F.col("sample_rate").alias("timescale"))


def export_aac(samples: DataFrame, profile: int, frequency_index: int, channels: int) -> DataFrame:
    """(file, track_id, sample_index, data): every frame with its own header; joined in order they make a stream."""

    @F.pandas_udf("binary")
    def framed(data: pd.Series) -> pd.Series:
        return pd.Series([writers.adts_header(profile, frequency_index, channels, len(d)) + bytes(d) for d in data])

    return samples.select(*TRACK, "sample_index", framed("data").alias("data"))


def export_units(samples: DataFrame, length_size: int, prefix: list[bytes] = ()) -> DataFrame:
    """(file, track_id, sample_index, data): samples as start-code byte streams, parameter sets before sync samples."""

    @F.pandas_udf("binary")
    def plain(data: pd.Series, sync: pd.Series) -> pd.Series:
        return pd.Series([writers.to_annex_b(bytes(d), length_size, list(prefix) if s else []) for d, s in zip(data, sync)])

    return samples.select(*TRACK, "sample_index", plain("data", "is_sync").alias("data"))


def list_units(samples: DataFrame, length_size: int, hevc: bool = False) -> DataFrame:
    """(file, track_id, sample_index, unit_index, unit_type, size): the NAL units inside samples."""
    schema = "file string, track_id long, sample_index long, unit_index int, unit_type int, size long"

    def work(batches):
        for pdf in batches:
            rows = []
            for file, track, index, data in zip(pdf["file"], pdf["track_id"], pdf["sample_index"], pdf["data"]):
                data, at, k = bytes(data), 0, 0
                while at + length_size < len(data):
                    n = int.from_bytes(data[at : at + length_size], "big")
                    head = data[at + length_size]
                    rows.append((file, track, index, k, head >> 1 & 63 if hevc else head & 31, n))
                    at, k = at + length_size + n, k + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return samples.select(*TRACK, "sample_index", "data").mapInPandas(work, schema)


def split_names(fragments: DataFrame, pattern: str = "segment-%d.%04d.m4s") -> DataFrame:
    """``fragments`` with ``name``: the track and the fragment's number within its track."""
    w = Window.partitionBy("file", "track_id").orderBy("segment_index")
    return fragments.withColumn("name", F.format_string(pattern, "track_id", F.row_number().over(w)))


def dump_prefix(samples: DataFrame, size: int = 12) -> DataFrame:
    return samples.withColumn("head", F.hex(F.substring("data", 1, size)))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key in order, such as the distinct key ids of a presentation."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def process(samples: DataFrame, handler, schema: str, keys: list[str] = TRACK) -> DataFrame:
    """A user's ``handler(pandas rows in order) -> pandas rows`` over every track: the hook for transforms of one's own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return handler(pdf.sort_values("sample_index", ignore_index=True))

    return samples.groupBy(*keys).applyInPandas(run, schema)


#: Speakers by bit of an E-AC-3 channel map, from the highest bit down, and how many channels each stands for.
SPEAKERS = [("L", 1), ("C", 1), ("R", 1), ("Ls", 1), ("Rs", 1), ("Lc/Rc", 2), ("Lrs/Rrs", 2), ("Cs", 1), ("Ts", 1), ("Lsd/Rsd", 2), ("Lw/Rw", 2), ("Vhl/Vhr", 2), ("Vhc", 1), ("Lts/Rts", 2), ("LFE2", 1), ("LFE", 1)]


def speaker_count(channel_map: int) -> int:
    return sum(n for k, (_, n) in enumerate(SPEAKERS) if channel_map >> (15 - k) & 1)


def speaker_names(channel_map: int) -> str:
    return " ".join(s for k, (s, _) in enumerate(SPEAKERS) if channel_map >> (15 - k) & 1)


def regroup_by_channels(tracks: DataFrame) -> DataFrame:
    """(presentation, set_name): audio sets apart by channel count and by whether they carry objects. Tracks:
    presentation, set_name, channels, objects."""
    name = F.concat_ws("/", "set_name", F.when(F.col("objects"), F.lit("objects")).otherwise(F.concat(F.col("channels").cast("string"), F.lit("ch"))))
    return tracks.withColumn("set_name", name)


def json_manifest(tracks: DataFrame) -> DataFrame:
    """(presentation, text): tracks of a presentation as a JSON document, by name."""
    row = F.struct("name", "kind", "codecs", "bandwidth", "segment_count", "url")
    whole = F.struct(F.col("presentation").alias("presentation"), F.array_sort(F.collect_list(row)).alias("tracks"))
    return tracks.groupBy("presentation").agg(F.to_json(whole).alias("text"))
