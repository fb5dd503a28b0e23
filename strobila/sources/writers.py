"""Boxes and files from samples: sample tables, fragments and indexes, one task for each file or segment."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.operators.groups import Bytes, by_group

#: Bytes of fragments that leave a task at a time.
_HELD = 1 << 22
_U32 = struct.Struct(">I")


def box(kind: str, *parts: bytes) -> bytes:
    """A box; one of 2**32 bytes or more gets a 64-bit size."""
    body = b"".join(parts)
    name = kind.encode("latin-1")
    if len(body) + 8 >= 1 << 32:
        return _U32.pack(1) + name + (len(body) + 16).to_bytes(8, "big") + body
    return _U32.pack(len(body) + 8) + name + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def words(*values: int) -> bytes:
    return b"".join(_U32.pack(v & 0xFFFFFFFF) for v in values)


def _packed(*columns: np.ndarray, kind: str = ">u4") -> bytes:
    """Rows of numbers as words."""
    return (np.column_stack(columns) & (0xFFFFFFFF if kind == ">u4" else -1)).astype(kind).tobytes()


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and values of the runs of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.zeros(0, np.int64)
    return np.diff(np.append(starts, len(values))), values[starts]


def sample_tables(samples: pd.DataFrame, description: bytes) -> bytes:
    """The sample table box of one track's samples in order, with offsets by chunk."""
    s = samples.sort_values("sample_index")
    return box("stbl", *tables(*(s[c].to_numpy() for c in ("duration", "cts_delta", "size", "is_sync", "chunk_index", "description_index", "offset")), description))


def tables(duration: np.ndarray, delta: np.ndarray, size: np.ndarray, is_sync: np.ndarray, chunk: np.ndarray, described: np.ndarray, offset: np.ndarray, description: bytes) -> list[bytes]:
    """The boxes of a sample table, that of the chunk offsets and then that of the sync samples last.

    The composition table is left out only if every delta is 0, the sync table only if all samples or none are sync.
    """
    order = np.argsort(chunk, kind="stable")
    counts, _ = run_lengths(chunk[order])
    starts = np.cumsum(counts) - counts
    parts = [full_box("stsd", 0, 0, words(1), description)]
    runs, values = run_lengths(duration)
    parts.append(full_box("stts", 0, 0, words(len(runs)), _packed(runs, values)))
    if delta.any():
        runs, values = run_lengths(delta)
        parts.append(full_box("ctts", 1 if values.min() < 0 else 0, 0, words(len(runs)), _packed(runs, values)))
    parts.append(full_box("stsc", 0, 0, words(len(counts)), _packed(np.arange(1, len(counts) + 1), counts, np.minimum.reduceat(described[order], starts))))
    same = bool((size == size[0]).all())
    parts.append(full_box("stsz", 0, 0, words(int(size[0]) if same else 0, len(size)), b"" if same else _packed(size)))
    offsets = np.minimum.reduceat(offset[order], starts)
    if offsets[-1] > 0xFFFFFFFF:
        parts.append(full_box("co64", 0, 0, words(len(offsets)), _packed(offsets, kind=">u8")))
    else:
        parts.append(full_box("stco", 0, 0, words(len(offsets)), _packed(offsets)))
    sync = np.flatnonzero(is_sync) + 1
    if 0 < len(sync) < len(size):
        parts.append(full_box("stss", 0, 0, words(len(sync)), _packed(sync)))
    return parts


def fragment(sequence: int, track_id: int, base_dts: int, samples: pd.DataFrame, data: list[bytes]) -> bytes:
    """A movie fragment and its media data. What is the same for all samples goes into the fragment's header."""
    s = samples.sort_values("sample_index")
    return packed_fragment(sequence, track_id, base_dts, *(s[c].to_numpy() for c in ("duration", "size", "cts_delta", "is_sync")), b"".join(data))


def packed_fragment(sequence: int, track_id: int, base_dts: int, durations: np.ndarray, sizes: np.ndarray, deltas: np.ndarray, sync: np.ndarray, data: bytes) -> bytes:
    return next(packed_fragments([sequence], [track_id], [base_dts], durations, sizes, deltas, sync, np.array([0, len(sizes)]), lambda a, b: data))


_heads: dict[tuple[int, bool], struct.Struct] = {}


def packed_fragments(sequence: list[int], track_id: list[int], base_dts: list[int], durations: np.ndarray, sizes: np.ndarray, deltas: np.ndarray, sync: np.ndarray, bounds: np.ndarray, data: Callable[[int, int], bytes]) -> Iterator[bytes]:
    """Fragments of samples ``bounds[g]`` to ``bounds[g + 1]``, whose data is ``data(bounds[g], bounds[g + 1])``."""
    first, last, counts = bounds[:-1], bounds[1:] - 1, np.diff(bounds)
    marks = np.where(sync, 0x02000000, 0x01010000)
    turns = [np.concatenate([[0], np.cumsum(x[1:] != x[:-1])]) for x in (durations, sizes, marks)]
    one_duration, one_size, one_mark = (t[last] == t[first] for t in turns)
    first_only = ~one_mark & (turns[2][last] == turns[2][np.minimum(first + 1, last)])
    marked = one_mark | first_only
    delayed = np.logical_or.reduceat(deltas != 0, first)
    versions = delayed & (np.minimum.reduceat(deltas, first) < 0)
    flags = 0x020000 | np.where(one_duration, 0x8, 0) | np.where(one_size, 0x10, 0) | np.where(marked, 0x20, 0)
    run_flags = 0x1 | np.where(one_duration, 0, 0x100) | np.where(one_size, 0, 0x200) | np.where(marked, 0, 0x400) | np.where(delayed, 0x800, 0) | np.where(first_only, 0x4, 0)
    # The entries of all runs that have the same columns are made together.
    shape = run_flags & 0xF00
    blocks, starts, widths = {}, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for code in np.unique(shape).tolist():
        own, columns = shape == code, [c for c, bit in ((durations, 0x100), (sizes, 0x200), (marks, 0x400), (deltas, 0x800)) if code & bit]
        rows = np.repeat(own, counts)
        blocks[code] = memoryview(_packed(*[c[rows] for c in columns]) if columns else b"")
        widths[own] = 4 * len(columns)
        starts[own] = (np.cumsum(counts[own]) - counts[own]) * 4 * len(columns)
    each = (x.tolist() for x in (first, counts, durations[first], sizes[first], marks[last], marks[first], one_duration, one_size, marked, first_only, flags, run_flags, versions, shape, starts, widths))
    for k, (a, n, duration, size, mark, head_mark, has_duration, has_size, has_mark, lone, flag, run_flag, version, code, start, width) in enumerate(zip(*each)):
        values = [v & 0xFFFFFFFF for v, on in ((duration, has_duration), (size, has_size), (mark, has_mark)) if on]
        head = _heads.get((len(values), lone))
        if head is None:
            head = _heads[len(values), lone] = struct.Struct(f">I4sI4sIII4sI4sII{len(values)}II4sIQI4sIII{'I' if lone else ''}")
        entries = blocks[code][start : start + n * width]
        trun, moof = 20 + 4 * lone + len(entries), head.size + len(entries)
        made = head.pack(
            moof, b"moof", 16, b"mfhd", 0, sequence[k] & 0xFFFFFFFF, moof - 24, b"traf", 16 + 4 * len(values), b"tfhd", flag, track_id[k] & 0xFFFFFFFF, *values,
            20, b"tfdt", 1 << 24, base_dts[k], trun, b"trun", version << 24 | run_flag, n, moof + 8, *([head_mark] if lone else []),
        )
        yield b"".join([made, entries, box("mdat", data(a, a + n))])


def segment_index(track_id: int, timescale: int, earliest: int, references: list[tuple[int, int, bool]]) -> bytes:
    """A segment index over (size, duration, begins with sync) of the segments that follow."""
    body = [words(track_id, timescale), earliest.to_bytes(8, "big"), bytes(8), struct.pack(">HH", 0, len(references))]
    return full_box("sidx", 1, 0, *body, *[words(size, duration, 0x90000000 if sync else 0) for size, duration, sync in references])


def random_access(track_id: int, entries: list[tuple[int, int]]) -> bytes:
    """A random access box over (time, fragment offset) of one track."""
    tfra = full_box("tfra", 1, 0, words(track_id, 0, len(entries)), *[t.to_bytes(8, "big") + o.to_bytes(8, "big") + bytes([1, 1, 1]) for t, o in entries])
    return box("mfra", tfra, full_box("mfro", 0, 0, words(8 + len(tfra) + 16)))


def write_fragments(samples: DataFrame, timescale: int) -> DataFrame:
    """(file, track_id, segment_index, sequence, content, duration, earliest): a fragment of every segment.

    ``samples``: with segment_index and data; one group is one segment, so files of any length are written in parallel.
    """

    names = ["file", "track_id", "segment_index", "sequence", "content", "duration", "earliest"]

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, data = bounds[:-1], Bytes(rows.column("data"))
        track, segment, dts, duration, size, delta, sync = (rows.column(c).to_numpy() for c in ("track_id", "segment_index", "dts", "duration", "size", "cts_delta", "is_sync"))
        files, tracks, segments, begins = rows.column("file").take(pa.array(first)).to_pylist(), *(x[first].tolist() for x in (track, segment, dts))
        contents = packed_fragments([n + 1 for n in segments], tracks, begins, duration, size, delta, sync, bounds, data.joined)
        made, held = [], 0
        for file, track_id, number, total, begin, content in zip(files, tracks, segments, np.add.reduceat(duration, first).tolist(), begins, contents):
            made.append((file, track_id, number, number + 1, content, total, begin))
            held += len(content)
            if held >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)
                made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)

    schema = "file string, track_id long, segment_index long, sequence long, content binary, duration long, earliest long"
    rows = samples.select("file", "track_id", "segment_index", "sample_index", "dts", "duration", "size", "cts_delta", "is_sync", "data")
    return by_group(rows, ["file", "track_id", "segment_index"], ["sample_index"], work, schema)


def packed_size_table(sizes: DataFrame) -> DataFrame:
    """(file, track_id, field_size, content): the smallest packed size table, of 8 or 16 bits, or null where a size
    needs more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from strobila.sources.boxes import pack_sizes

        s = pdf.sort_values("sample_index")["size"].tolist()
        width = 8 if max(s) < 256 else 16 if max(s) < 65536 else None
        content = None if width is None else full_box("stz2", 0, 0, words(width, len(s)), pack_sizes(s, width))
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "track_id": [pdf["track_id"].iloc[0]], "field_size": pd.array([width], "Int32"), "content": [content]})

    return sizes.groupBy("file", "track_id").applyInPandas(build, "file string, track_id long, field_size int, content binary")


def adts_header(profile: int, frequency_index: int, channels: int, size: int) -> bytes:
    """The seven bytes before a raw AAC frame of ``size`` bytes."""
    n = size + 7
    return bytes([0xFF, 0xF1, (profile - 1) << 6 | frequency_index << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC])


def to_annex_b(sample: bytes, length_size: int, prefix: list[bytes] = ()) -> bytes:
    """A sample of length-prefixed NAL units as a byte stream with start codes."""
    out, at = [b"\0\0\0\1" + p for p in prefix], 0
    while at + length_size <= len(sample):
        n = int.from_bytes(sample[at : at + length_size], "big")
        at += length_size
        if at + n > len(sample):
            raise ValueError("a unit ends beyond its sample")
        out.append(b"\0\0\0\1" + sample[at : at + n])
        at += n
    return b"".join(out)


def assemble(parts: DataFrame, keys: list[str], order: str, value: str = "content") -> DataFrame:
    """(keys, content): parts joined end to end in order; for outputs that fit in a task, such as headers and manifests."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: F.hex(x[value]))
    return parts.groupBy(*keys).agg(F.unhex(F.array_join(rows, "")).alias("content"))
