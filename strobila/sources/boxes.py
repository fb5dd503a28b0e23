"""Files of boxes as rows: one row for each box, with its place in the tree, its fields and, if asked, its payload.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do; the walk of a file is iterative,
and ``mdat`` payloads are never copied. A container's payload is what it holds before its children. The entries of
tables stay in their payloads, which ``media`` decodes as arrays; only a dump asks for them as fields.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strobila.sources.layouts import (
    _AUDIO,
    _VISUAL,
    AUDIO_ENTRIES,
    CONTAINERS,
    LAYOUTS,
    OTHER_ENTRIES,
    PREFIXED,
    VISUAL_ENTRIES,
    Truncated,
    decode,
)

ATOMS = (
    "file string, atom_id long, parent_id long, ordinal int, depth int, path string, type string, offset long, header_size int, "
    "size long, version int, flags long, fields map<string,string>, payload binary, error string"
)
#: Boxes whose payloads are tables, which stay with their rows even where other payloads are left out.
TABLES = frozenset("stts ctts stsc stco co64 stss stsz stz2 trun sidx tfra sbgp elst".split())


class Box:
    __slots__ = ("type", "offset", "header", "size", "version", "flags", "fields", "payload", "parent", "id", "ordinal", "depth", "path", "error", "entries")

    def __init__(self, type, offset, header, size, parent, id, ordinal, depth, path):
        self.type, self.offset, self.header, self.size, self.parent, self.id = type, offset, header, size, parent, id
        self.ordinal, self.depth, self.path, self.fields = ordinal, depth, path, {}
        self.version = self.flags = self.payload = self.error = self.entries = None


_HEAD = struct.Struct(">I4s")


def header(data: bytes | memoryview, at: int, end: int) -> tuple[str, int, int] | None:
    """(type, header size, total size) of the box at ``at``; None where there is no whole box.

    Size 1: a 64-bit size follows; size 0: the box ends with what holds it; less than a header: not a box.
    """
    if at + 8 > end:
        return None
    size, kind = _HEAD.unpack_from(data, at)
    kind, head = kind.decode("latin-1"), 8
    if size == 1:
        if at + 16 > end:
            return None
        size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
    elif size == 0:
        size = end - at
    if size < head or at + size > end:
        return None
    return kind, head, size


#: Bytes of a file that reach a walk at a time.
_PIECE = 1 << 22


def pieces(files: DataFrame) -> DataFrame:
    """(path, length, content): the contents of ``files`` (path, content) in pieces, those of a file one after the other, so
    that Python never has to hold a file."""
    files = files.select("path", F.col("content").cast("binary").alias("content"))
    n = F.length("content")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _PIECE).cast("int")), lambda k: F.substring("content", k * _PIECE + 1, F.lit(_PIECE)))
    return files.select("path", n.cast("long").alias("length"), F.explode_outer(F.when(n > _PIECE, cut).otherwise(F.array("content"))).alias("content"))


class Pieces:
    """A file that comes in pieces, of which only those are held that a walk, which never turns back, still needs."""

    def __init__(self, length: int, first: memoryview, rest: Iterator[memoryview]):
        self.length, self.view, self.base, self.rest = length, first, 0, rest

    def __len__(self) -> int:
        return self.length

    def cover(self, start: int, end: int) -> tuple[memoryview, int]:
        """(bytes, where they begin) of a stretch that begins at ``start`` or before; what is before it is let go."""
        reach = self.base + len(self.view)
        if end > reach:
            held = [self.view[start - self.base :]] if start < reach else []
            while end > reach:
                piece = next(self.rest)
                reach += len(piece)
                if reach > start:
                    held.append(piece)
            self.view = held[0] if len(held) == 1 else memoryview(b"".join(held))
            self.base = reach - len(self.view)
        return self.view, self.base


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview | Pieces]]:
    """(path, content) of the files whose ``pieces`` come; a file is to be walked before the next one is asked for."""

    def each() -> Iterator[tuple[str, int, memoryview]]:
        for b in batches:
            for i in range(b.num_rows):
                path, length, content = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_buffer()
                if content is None:
                    raise ValueError(f"a file without content: {path}")
                yield path, length, memoryview(content)  # not copied

    parts = each()
    for path, length, first in parts:
        if len(first) == length:
            yield path, first
            continue
        left = length - len(first)

        def rest() -> Iterator[memoryview]:
            nonlocal left
            while left:
                piece = next(parts)[2]
                left -= len(piece)  # noqa: B023
                yield piece

        yield path, Pieces(length, first, own := rest())
        for _ in own:  # what the walk did not need
            pass


def walk(data: bytes | memoryview | Pieces, moov_only: bool = False, max_depth: int | None = None, payloads: bool = True, entries: bool = False, decoders: dict | None = None, kinds: frozenset[str] | None = None) -> Iterator[Box]:
    """All boxes of a file in file order. A box that does not fit in what holds it ends the walk there.

    ``kinds``: of others, no fields are read and no boxes given, but what they hold is walked. ``decoders``: functions ``payload -> dict`` by type, for boxes that have no layout or in place of it.
    """
    counter, decoders = 0, decoders or {}
    whole = len(data)
    view, base = (data.view, data.base) if isinstance(data, Pieces) else (data, 0)
    reach = base + len(view)
    stack: list[tuple[int, int, Box | None, dict, bool]] = [(0, whole, None, {}, False)]
    while stack:
        at, end, parent, seen, described = stack.pop()
        if at + 16 > reach and reach < whole:
            view, base = data.cover(at, min(at + 16, whole))
            reach = base + len(view)
        found = header(view, at - base, end - base)
        if found is None:
            continue
        kind, head, size = found
        if kind == "uuid" and size >= head + 16:
            head += 16
        n = seen.get(kind, 0)
        seen[kind] = n + 1
        ordinal = seen["#"] = seen.get("#", -1) + 1
        depth = 0 if parent is None else parent.depth + 1
        name = f"{kind}[{n}]"
        box = Box(kind, at, head, size, None if parent is None else parent.id, counter, ordinal, depth, name if parent is None else f"{parent.path}/{name}")
        counter += 1
        plain = kind in CONTAINERS and kind != "ipro" and not described and kind not in decoders  # of such, no byte is its own
        wanted = kinds is None or kind in kinds
        filled = not plain and (described or kind in PREFIXED or kind == "ipro" or wanted and (kind in _FILLED or kind in decoders))
        carried = wanted and (payloads or kind in TABLES) and kind != "mdat"
        body = b""
        if (filled or carried) and not plain and kind != "mdat":
            if at + size > reach:
                view, base = data.cover(at, at + size)
                reach = base + len(view)
            body = bytes(view[at + head - base : at + size - base])
        inner = 0 if plain else _fill(box, body, described, view[at + head - 16 - base : at + head - base].hex() if kind == "uuid" else "", entries, decoders) if filled else None
        if inner is not None:
            box.payload = body[:inner]
        elif carried:
            box.payload = body
        if wanted:
            yield box
        if at + size < end and not (moov_only and parent is None and kind == "moov"):
            stack.append((at + size, end, parent, seen, entries))
        if inner is not None and (max_depth is None or depth < max_depth):
            stack.append((at + head + inner, at + size, box, {}, kind == "stsd"))


def _fill(box: Box, body: bytes, entry: bool, uuid: str, entries: bool, decoders: dict) -> int | None:
    """Sets a box's fields; returns where its children begin, None for a leaf."""
    kind = box.type
    try:
        if entry:
            if kind in AUDIO_ENTRIES:
                box.fields, at = decode(_AUDIO, body)
                return at + {1: 16, 2: 36}.get(box.fields.get("qt_version"), 0)
            if kind in VISUAL_ENTRIES:
                box.fields, at = decode(_VISUAL, body)
                raw = bytes.fromhex(box.fields.pop("compressor_raw"))
                box.fields["compressor"] = raw[1 : 1 + min(31, raw[0])].decode("latin-1")
                return at
            if kind == "stpp":
                box.fields, at = decode("skip6 data_reference_index:u16 namespace:str schema_location:str image_mime_type:str", body)
                return at
            if kind == "rtp ":
                box.fields, at = decode("skip6 data_reference_index:u16 hint_track_version:u16 highest_compatible_version:u16 max_packet_size:u32", body)
                return at
            box.fields, at = decode("skip6 data_reference_index:u16", body)
            return at if kind in OTHER_ENTRIES else None
        if kind in decoders:
            box.fields = dict(decoders[kind](body))
            return None
        if kind in CONTAINERS and kind != "ipro":
            return 0
        if kind == "ipro":
            box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
            return 6
        if kind in PREFIXED:
            if kind == "meta" and body[4:8] == b"hdlr":  # without version and flags
                return 0
            box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
            if PREFIXED[kind] == 8:
                box.fields["entry_count"] = int.from_bytes(body[4:8], "big")
            return PREFIXED[kind]
        if kind == "uuid":
            box.fields["uuid"] = uuid
            return None
        if kind in ("stsz", "stz2", "tfra", "avcC", "hvcC", "dvcC", "dvvC", "av1C", "dac3", "dec3"):
            box.entries = entries
            box.fields = _SPECIAL[kind](box, body)
            return None
        if kind in LAYOUTS:
            full, layout = LAYOUTS[kind]
            if full:
                if len(body) < 4:
                    raise Truncated("no version and flags")
                box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
            box.fields, _ = decode(layout, body[4 * full :], box.version or 0, box.flags or 0, entries or kind not in TABLES)
            if kind == "sidx" and entries:
                _split_references(box.fields)
    except (Truncated, IndexError, ValueError) as e:
        box.error = str(e)
    return None


def _split_references(fields: dict) -> None:
    for k in range(int(fields.get("reference_count", 0))):
        ref, sap = fields.pop(f"reference[{k}]"), fields.pop(f"sap[{k}]")
        fields |= {f"reference_type[{k}]": ref >> 31, f"referenced_size[{k}]": ref & 0x7FFFFFFF, f"starts_with_SAP[{k}]": sap >> 31, f"SAP_type[{k}]": sap >> 28 & 7, f"SAP_delta_time[{k}]": sap & 0x0FFFFFFF}


def _sizes(box: Box, body: bytes) -> dict:
    box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
    fixed, count = (int.from_bytes(body[k : k + 4], "big") for k in (4, 8))
    if not fixed and 12 + 4 * count > len(body):
        raise Truncated("sizes end early")
    each = range(0 if fixed or not box.entries else count)
    return {"sample_size": fixed, "sample_count": count} | {f"size[{k}]": int.from_bytes(body[12 + 4 * k : 16 + 4 * k], "big") for k in each}


def unpack_sizes(body: bytes, width: int, count: int) -> list[int]:
    """Sizes of 4, 8 or 16 bits each; of 4 bits, the high half of a byte comes first."""
    if len(body) * 8 < width * count:
        raise Truncated("sizes end early")
    if width == 4:
        return [body[k // 2] >> (4 if k % 2 == 0 else 0) & 15 for k in range(count)]
    step = width // 8
    return [int.from_bytes(body[step * k : step * (k + 1)], "big") for k in range(count)]


def pack_sizes(sizes: list[int], width: int) -> bytes:
    if max(sizes, default=0) >= 1 << width:
        raise ValueError(f"a size does not fit in {width} bits")
    if width == 4:
        even = [*sizes, 0] if len(sizes) % 2 else sizes
        return bytes(a << 4 | b for a, b in zip(even[::2], even[1::2]))
    return b"".join(s.to_bytes(width // 8, "big") for s in sizes)


def _packed_sizes(box: Box, body: bytes) -> dict:
    box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
    width, count = body[7], int.from_bytes(body[8:12], "big")
    if (len(body) - 12) * 8 < width * count:
        raise Truncated("sizes end early")
    each = unpack_sizes(body[12:], width, count) if box.entries else []
    return {"field_size": width, "sample_count": count} | {f"size[{k}]": s for k, s in enumerate(each)}


def _random_access(box: Box, body: bytes) -> dict:
    box.version, box.flags = body[0], int.from_bytes(body[1:4], "big")
    track, lengths, count = (int.from_bytes(body[k : k + 4], "big") for k in (4, 8, 12))
    traf, trun, sample = ((lengths >> s & 3) + 1 for s in (4, 2, 0))
    layout = f"**[time:V moof_offset:V traf_number:u{8 * traf} trun_number:u{8 * trun} sample_number:u{8 * sample}]"
    fields, _ = decode(layout, body[16:] if box.entries else b"", box.version)
    return {"track_id": track, "length_size_of_traf_num": traf, "length_size_of_trun_num": trun, "length_size_of_sample_num": sample, "entry_count": count} | fields


def _avc_config(box: Box, body: bytes) -> dict:
    out = {"configuration_version": body[0], "profile": body[1], "profile_compatibility": body[2], "level": body[3], "nalu_length_size": (body[4] & 3) + 1}
    at = 5
    for name, mask in (("sequence_parameter", 31), ("picture_parameter", 255)):
        n, at = body[at] & mask, at + 1
        for k in range(n):
            size = int.from_bytes(body[at : at + 2], "big")
            out[f"{name}[{k}]"] = body[at + 2 : at + 2 + size].hex()
            at += 2 + size
    return out


def _hevc_config(box: Box, body: bytes) -> dict:
    out = {
        "configuration_version": body[0], "profile_space": body[1] >> 6, "tier": body[1] >> 5 & 1, "profile": body[1] & 31, "profile_compatibility": body[2:6].hex(),
        "constraint": body[6:12].hex(), "level": body[12], "min_spatial_segmentation": int.from_bytes(body[13:15], "big") & 0xFFF, "parallelism_type": body[15] & 3,
        "chroma_format": body[16] & 3, "luma_depth": 8 + (body[17] & 7), "chroma_depth": 8 + (body[18] & 7), "average_frame_rate": int.from_bytes(body[19:21], "big"),
        "constant_frame_rate": body[21] >> 6, "number_of_temporal_layers": body[21] >> 3 & 7, "temporal_id_nested": body[21] >> 2 & 1, "nalu_length_size": (body[21] & 3) + 1,
    }
    at = 23
    for k in range(body[22]):
        kind, n, at = body[at] & 63, int.from_bytes(body[at + 1 : at + 3], "big"), at + 3
        for i in range(n):
            size = int.from_bytes(body[at : at + 2], "big")
            out[f"nalu[{k}][{i}]"] = f"{kind}:{body[at + 2 : at + 2 + size].hex()}"
            at += 2 + size
    return out


def _dolby_vision(box: Box, body: bytes) -> dict:
    x = int.from_bytes(body[2:4], "big")
    return {"dv_version_major": body[0], "dv_version_minor": body[1], "dv_profile": x >> 9, "dv_level": x >> 3 & 63, "rpu_present_flag": x >> 2 & 1, "el_present_flag": x >> 1 & 1, "bl_present_flag": x & 1, "dv_bl_signal_compatibility_id": body[4] >> 4 if len(body) > 4 else 0}


def _av1_config(box: Box, body: bytes) -> dict:
    b1, b2, b3 = body[1:4]
    return {
        "version": body[0] & 127, "seq_profile": b1 >> 5, "seq_level_idx_0": b1 & 31, "seq_tier_0": b2 >> 7, "high_bitdepth": b2 >> 6 & 1, "twelve_bit": b2 >> 5 & 1, "monochrome": b2 >> 4 & 1,
        "chroma_subsampling_x": b2 >> 3 & 1, "chroma_subsampling_y": b2 >> 2 & 1, "chroma_sample_position": b2 & 3, "initial_presentation_delay": (b3 & 15) + 1 if b3 & 16 else 0,
    }


def _ac3_config(box: Box, body: bytes) -> dict:
    x = int.from_bytes(body[:3], "big")
    return {"fscod": x >> 22, "bsid": x >> 17 & 31, "bsmod": x >> 14 & 7, "acmod": x >> 11 & 7, "lfeon": x >> 10 & 1, "bit_rate_code": x >> 5 & 31}


def _eac3_config(box: Box, body: bytes) -> dict:
    x = int.from_bytes(body[:2], "big")
    out, at = {"data_rate": x >> 3, "substreams": (x & 7) + 1}, 2
    for k in range((x & 7) + 1):
        y = int.from_bytes(body[at : at + 3], "big")
        out |= {f"fscod[{k}]": y >> 22, f"bsid[{k}]": y >> 17 & 31, f"bsmod[{k}]": y >> 12 & 31, f"acmod[{k}]": y >> 9 & 7, f"lfeon[{k}]": y >> 8 & 1}
        dependent = y >> 1 & 15
        at += 3
        if dependent:
            out[f"chan_loc[{k}]"] = (y & 1) << 8 | body[at]
            at += 1
    if len(body) >= at + 2 and body[at] & 1:
        out["complexity_index_type_a"] = body[at + 1]
    return out


_SPECIAL = {"stsz": _sizes, "stz2": _packed_sizes, "tfra": _random_access, "avcC": _avc_config, "hvcC": _hevc_config, "dvcC": _dolby_vision, "dvvC": _dolby_vision, "av1C": _av1_config, "dac3": _ac3_config, "dec3": _eac3_config}
#: Boxes of which more is known than their type and size.
_FILLED = frozenset([*CONTAINERS, *PREFIXED, *LAYOUTS, *_SPECIAL, "uuid"])


def rows_of(file: str, data: bytes | memoryview | Pieces, strict: bool = False, at: str | None = None, **options) -> Iterator[tuple]:
    for b in walk(data, **options):
        if strict and b.error:
            raise ValueError(f"{file}, {b.path}: {b.error}")
        if at is None or b.path == at:
            yield (file, b.id, b.parent, b.ordinal, b.depth, b.path, b.type, b.offset, b.header, b.size, b.version, b.flags, {k: str(v) for k, v in b.fields.items()}, b.payload, b.error)


_NAMES = [c.split()[0] for c in ATOMS.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ATOMS.split(", ")])
#: Boxes, and bytes of their payloads, that leave a file's walk at a time, however many it has.
_ROWS, _HELD = 1 << 12, 1 << 22
#: Boxes that leave an edited tree at a time.
_SLICE = 1 << 16


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[list(x.items()) for x in c] if f.name == "fields" else c for c, f in zip(zip(*rows), _SCHEMA)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def atoms(files: DataFrame, moov_only: bool = False, max_depth: int | None = None, payloads: bool = True, strict: bool = False, entries: bool = False, decoders: dict | None = None, at: str | None = None) -> DataFrame:
    """Boxes of ``files`` (path, content). ``strict``: a box that its layout does not fit raises an error; otherwise it
    keeps its row, with ``error``. ``entries``: the entries of tables as fields too, for dumps. ``decoders``: functions
    ``payload -> dict`` by type for further boxes, which go to the tasks with the walk. ``at``: all boxes are walked, but
    only those whose ``path`` it is become rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, content in contents(batches):
            for r in rows_of(path, content, strict, at, moov_only=moov_only, max_depth=max_depth, payloads=payloads, entries=entries, decoders=decoders):
                rows.append(r)
                held += len(r[-2] or b"")
                if len(rows) == _ROWS or held >= _HELD:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return pieces(files).mapInArrow(work, ATOMS)


def read_atoms(spark: SparkSession, path: str, **options) -> DataFrame:
    return atoms(spark.read.format("binaryFile").load(path), **options)


def files_of(df: DataFrame) -> DataFrame:
    """(file, length, major_brand, minor_version, brands, moov_before_mdat): one row for each file of a tree; the last is
    null where either box is missing."""
    top = df.filter("depth = 0")
    head = F.col("type").isin("ftyp", "styp")
    brand = lambda name: F.min_by(F.when(head, F.col("fields")[name]), F.when(head, F.col("offset")))
    values = F.min_by(F.when(head, F.map_values(F.map_filter("fields", lambda k, v: k.startswith("compatible_brand")))), F.when(head, F.col("offset")))
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.col("offset")))
    return top.groupBy("file").agg(
        F.max(F.col("offset") + F.col("size")).alias("length"), brand("major_brand").alias("major_brand"), brand("minor_version").cast("long").alias("minor_version"),
        F.coalesce(values, F.array().cast("array<string>")).alias("brands"), (first("moov") < first("mdat")).alias("moov_before_mdat"),
    )


def project(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """(file, path, fields): the named fields of all boxes of a type, as texts."""
    return df.filter(F.col("type") == kind).select("file", "path", *[F.col("fields")[f].alias(f) for f in fields])


# Queries on the tree


def parse_path(path: str) -> list[tuple[str, int]] | None:
    """``moov/trak[1]/mdia`` as (name, ordinal) steps; None if malformed. A step is four characters, or 32 hex digits of a
    uuid, counted among the boxes of that uuid."""
    out = []
    for step in path.split("/"):
        m = re.fullmatch(r"(.{4}|[0-9A-Fa-f]{32})(?:\[(\d+)\])?", step)
        if not m:
            return None
        out.append((m[1].lower() if len(m[1]) == 32 else m[1], int(m[2] or 0)))
    return out


def _written(steps: list[tuple[str, int]]) -> str:
    return "/".join(f"{name}[{n}]" for name, n in steps)


def find(df: DataFrame, path: str) -> DataFrame:
    """Boxes at a path, of every file; none for a malformed path."""
    steps = parse_path(path)
    if steps is None:
        return df.filter(F.lit(False))
    if all(len(name) == 4 for name, _ in steps):
        return df.filter(F.col("path") == _written(steps))
    out = None
    for name, n in steps:
        own = df.filter(F.col("parent_id").isNull()) if out is None else children(df, out)
        own = own.filter(F.col("type") == name if len(name) == 4 else (F.col("type") == "uuid") & (F.lower(F.col("fields")["uuid"]) == name))
        k = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
        out = own.withColumn("_k", k).filter(F.col("_k") == n + 1).drop("_k")
    return out


def find_in(files: DataFrame, path: str, **options) -> DataFrame:
    """``find`` among the ``atoms`` of ``files`` (path, content), of which only those at the path leave their file's walk."""
    steps = parse_path(path)
    if steps is None or any(len(name) != 4 for name, _ in steps):
        return find(atoms(files, **options), path)
    return atoms(files, at=_written(steps), **options)


def children(df: DataFrame, parent: DataFrame, kind: str | None = None) -> DataFrame:
    keys = parent.select("file", F.col("atom_id").alias("parent_id"))
    out = df.join(keys, ["file", "parent_id"], "left_semi")
    return out if kind is None else out.filter(F.col("type") == kind)


def _levels(parent: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes of a tree (``parent``: -1 for those at the top) by depth, each depth in the order of the tree."""
    order = np.lexsort((place, parent))
    above = parent[order]
    at = order[np.searchsorted(above, -1, "left") : np.searchsorted(above, -1, "right")]
    while len(at):
        yield at
        first, last = np.searchsorted(above, at, "left"), np.searchsorted(above, at, "right")
        counts = last - first
        at = order[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]


def _parents(atom_id: np.ndarray, parent_id: pa.Array) -> np.ndarray:
    """Where every row's parent is, -1 where there is none."""
    known = ~parent_id.is_null().to_numpy(zero_copy_only=False)
    wanted, order = parent_id.fill_null(0).to_numpy(zero_copy_only=False), np.argsort(atom_id)
    spot = order[np.minimum(np.searchsorted(atom_id, wanted, sorter=order), len(order) - 1)]
    return np.where(known & (atom_id[spot] == wanted), spot, -1)


def _measured(levels: list[np.ndarray], parent: np.ndarray, own: np.ndarray, header_size: np.ndarray, size: np.ndarray, is_uuid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every header, eight more from 4 GiB on, and of what follows it; ``own``: bytes before its children, -1 for a
    box whose payload is not in its row."""
    extra, inside, head = np.where(is_uuid, 16, 0), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    body = np.zeros(len(own), np.int64)
    for at in reversed(levels):
        body[at] = np.where(own[at] < 0, size[at] - header_size[at], own[at] + inside[at])
        head[at] = np.where((header_size[at] - extra[at] == 16) | (body[at] + 8 + extra[at] >= 1 << 32), 16, 8) + extra[at]
        held = parent[at] >= 0
        np.add.at(inside, parent[at][held], (head + body)[at][held])
    return head, body


class _Editor:
    """A tree whose boxes are numbers; only children of boxes that are edited are lists."""

    def __init__(self, kinds: list[str], codes: np.ndarray, uuids: dict[int, str], parent: np.ndarray, place: np.ndarray):
        self.kinds, self.codes, self.uuids, self.n = kinds, codes, uuids, len(codes)
        self.order = np.lexsort((place, parent))
        self.above = parent[self.order]
        self.lists: dict[int, list[int]] = {}
        self.new: list[dict] = []

    def children(self, i: int) -> list[int]:
        if i not in self.lists:
            ends = [np.searchsorted(self.above, i, side) for side in ("left", "right")] if i < self.n else (0, 0)
            self.lists[i] = self.order[ends[0] : ends[1]].tolist()
        return self.lists[i]

    def child(self, i: int, name: str, n: int) -> int | None:
        if len(name) == 32:
            own = [c for c in self.children(i) if self.uuids.get(c) == name]
        else:
            own = [c for c in self.children(i) if (self.kinds[self.codes[c]] if c < self.n else self.new[c - self.n]["type"]) == name]
        return own[n] if n < len(own) else None

    def add(self, row: dict) -> int:
        self.new.append(row)
        at = self.n + len(self.new) - 1
        if row["type"] == "uuid":
            self.uuids[at] = row["fields"].get("uuid", "").lower()
        return at

    def parsed(self, content: bytes) -> list[int]:
        top, ids = [], {}
        for r in rows_of("", content):
            row = dict(zip(_NAMES, r))
            at = ids[row["atom_id"]] = self.add(row)
            (top if row["parent_id"] is None else self.children(ids[row["parent_id"]])).append(at)
        return top

    def at(self, path: str, create: bool) -> tuple[int | None, int | None]:
        """(parent, box) at a path. ``create``: missing plain containers are put last in what should hold them."""
        parent, here = None, -1
        for name, n in parse_path(path):
            parent, here = here, self.child(here, name, n)
            if here is None:
                if not create or name not in CONTAINERS or n:
                    return parent, None
                here = self.add({"type": name, "payload": b"", "fields": {}, "header_size": 8, "size": 8, "version": None, "flags": None, "error": None})
                self.children(parent).append(here)
        return parent, here


def edit(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """The trees of all files after ``("remove", path)``, ``("insert", parent path or "", bytes of boxes[, position])`` and
    ``("replace", path, bytes of boxes)``, in order; a path that is not there, or malformed, changes nothing, but an
    insertion makes the containers that it misses.

    Ordinals, paths, depths, sizes and entry counts are those of the new tree; ``offset`` stays the place in the file that
    was read, null for new boxes. A file's tree is edited in one task, as arrays; media data is not part of it.
    """
    for s in steps:
        if s[0] not in ("remove", "insert", "replace"):
            raise ValueError(f"no such edit: {s[0]}")
    arrow = to_arrow_schema(df.schema)
    plain = df.drop("path", "depth")
    kept = to_arrow_schema(plain.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).cast(kept)
        n, file = table.num_rows, table.column("file")[0].as_py()
        kinds = table.column("type").combine_chunks().dictionary_encode()
        codes, names = kinds.indices.to_numpy(), kinds.dictionary.to_pylist()
        uuids = {int(i): dict(table.column("fields")[int(i)].as_py() or []).get("uuid", "").lower() for i in np.flatnonzero(codes == names.index("uuid"))} if "uuid" in names else {}
        ids = table.column("atom_id").to_numpy()
        parent, place = _parents(ids, table.column("parent_id").combine_chunks()), table.column("ordinal").to_numpy().astype(np.int64)
        tree = _Editor(names, codes, uuids, parent, place)
        for kind, path, *rest in steps:
            if path and parse_path(path) is None:
                continue
            above, here = tree.at(path, kind == "insert") if path else (None, -1)
            if here is None:
                continue
            if kind == "insert":
                own = tree.children(here)
                k = rest[1] if len(rest) > 1 and rest[1] is not None else len(own)
                own[k:k] = tree.parsed(rest[0])
            else:
                own = tree.children(above)
                k = own.index(here)
                own[k : k + 1] = tree.parsed(rest[0]) if kind == "replace" else []
        fresh = int(ids.max()) + 1
        ids = np.concatenate([ids, fresh + np.arange(len(tree.new))])
        parent, place = (np.concatenate([x, np.full(len(tree.new), -2)]) for x in (parent, place))
        for i in tree.lists:
            parent[:n][tree.order[np.searchsorted(tree.above, i, "left") : np.searchsorted(tree.above, i, "right")] if i < n else []] = -2
        for i, own in tree.lists.items():
            parent[own], place[own] = i, np.arange(len(own))
        levels = list(_levels(parent, place))
        # Boxes that state how many children they have get rows of their own, as the new ones do.
        count = np.zeros(len(ids), np.int64)
        for at in levels:
            np.add.at(count, parent[at][parent[at] >= 0], 1)
        rows = [{"atom_id": int(ids[n + k]), **r, "offset": None} | {"atom_id": int(ids[n + k])} for k, r in enumerate(tree.new)]
        source = np.arange(len(ids))
        stating = [i for k in ("stsd", "dref") if k in names for i in np.flatnonzero(codes == names.index(k)).tolist()] + [n + k for k, r in enumerate(rows) if r["type"] in ("stsd", "dref")]
        for i in stating:
            r = rows[i - n] if i >= n else table.slice(i, 1).to_pylist()[0]
            if r["payload"] is None:
                continue
            r |= {"payload": bytes(r["payload"])[:4] + int(count[i]).to_bytes(4, "big"), "fields": {**dict(r["fields"] or {}), "entry_count": str(int(count[i]))}}
            if i < n:
                source[i] = n + len(rows)
                rows.append(r)
        rows = [{f.name: list(dict(r["fields"] or {}).items()) if f.name == "fields" else file if f.name == "file" else None if f.name in ("parent_id", "ordinal") else r.get(f.name) for f in kept} for r in rows]
        table = pa.concat_tables([table, pa.Table.from_pylist(rows, kept)]).combine_chunks()
        kinds = table.column("type").combine_chunks().dictionary_encode()
        codes, names = kinds.indices.to_numpy()[source], kinds.dictionary
        own = pc.fill_null(pc.binary_length(table.column("payload")), -1).to_numpy().astype(np.int64)[source]
        old_head, size = (table.column(c).to_numpy().astype(np.int64)[source] for c in ("header_size", "size"))
        head, body = _measured(levels, parent, own, old_head, size, pc.equal(names, "uuid").to_numpy(zero_copy_only=False)[codes])
        old_head, size = np.where(own < 0, old_head, head), np.where(own < 0, size, head + body)
        above_at = np.zeros(len(ids), np.int64)  # where a box is in its depth
        paths = None
        for depth, at in enumerate(levels):
            up, k = parent[at], np.arange(len(at))
            starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            ordinal = k - np.repeat(starts, np.diff(np.append(starts, len(at))))
            group = np.lexsort((k, codes[at], np.cumsum(np.isin(k, starts))))
            new = np.concatenate([[True], (up[group][1:] != up[group][:-1]) | (codes[at][group][1:] != codes[at][group][:-1])])
            firsts = np.flatnonzero(new)
            nth = np.empty(len(at), np.int64)
            nth[group] = k - np.repeat(firsts, np.diff(np.append(firsts, len(at))))
            step = pc.binary_join_element_wise(names.take(pa.array(codes[at])), "[", pa.array(nth).cast(pa.string()), "]", "")
            paths = step if paths is None else pc.binary_join_element_wise(paths.take(pa.array(above_at[up])), step, "/")
            above_at[at] = k
            for a in range(0, len(at), _SLICE):
                part = at[a : a + _SLICE]
                made = {
                    "atom_id": pa.array(ids[part]), "parent_id": pa.array(ids[up[a : a + _SLICE]], mask=up[a : a + _SLICE] < 0), "ordinal": pa.array(ordinal[a : a + _SLICE].astype(np.int32)), "depth": pa.array(np.full(len(part), depth, np.int32)),
                    "path": paths.slice(a, _SLICE), "header_size": pa.array(old_head[part].astype(np.int32)), "size": pa.array(size[part]),
                }
                taken = table.take(pa.array(source[part])).combine_chunks()
                columns = [made[f.name] if f.name in made else taken.column(f.name).chunk(0) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], [f.name for f in arrow])

    return plain.groupBy("file").applyInArrow(work, df.schema)


def remove(df: DataFrame, path: str) -> DataFrame:
    """The trees without the box at a path and all below it; see ``edit``."""
    return edit(df, [("remove", path)])


def insert(df: DataFrame, parent_path: str, content: bytes, position: int | None = None) -> DataFrame:
    """The boxes in ``content`` put below a path, before ``position`` or last; see ``edit``."""
    return edit(df, [("insert", parent_path, content, position)])


def replace(df: DataFrame, path: str, content: bytes) -> DataFrame:
    """The boxes in ``content`` in place of the one at a path; see ``edit``."""
    return edit(df, [("replace", path, content)])


def write_tree(df: DataFrame, files: DataFrame) -> DataFrame:
    """(file, content): every file's boxes as bytes. What has no payload in its row, such as media data, is taken from
    ``files`` (path, content) at its offset. A file is written in one task; chunk offsets are written as they are."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"file": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        source = right.column("content")[0].as_buffer() if right.num_rows else None
        ids, place, head, size = (left.column(c).to_numpy().astype(np.int64) for c in ("atom_id", "ordinal", "header_size", "size"))
        parent = _parents(ids, left.column("parent_id").combine_chunks())
        kinds, payload = left.column("type").combine_chunks().dictionary_encode(), left.column("payload").combine_chunks().cast(pa.binary())
        codes, names = kinds.indices.to_numpy(), [k.encode("latin-1") for k in kinds.dictionary.to_pylist()]
        own = pc.fill_null(pc.binary_length(payload), -1).to_numpy().astype(np.int64)
        is_uuid = np.array([k == b"uuid" for k in names])[codes]
        levels, offsets = list(_levels(parent, place)), left.column("offset")
        old_head = head
        head, body = _measured(levels, parent, own, head, size, is_uuid)
        start, whole = np.zeros(len(ids), np.int64), head + body
        for at in levels:
            up, before = parent[at], np.cumsum(whole[at]) - whole[at]
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            base = np.where(up >= 0, start[up] + head[up] + own[up], 0)
            start[at] = base + before - np.repeat(before[first], np.diff(np.append(first, len(at))))
        content = bytearray(int(whole[levels[0]].sum()))
        out, kept = np.frombuffer(content, np.uint8), np.concatenate(levels)
        short = kept[(head - np.where(is_uuid, 16, 0))[kept] == 8]
        letters = np.array([list(k) for k in names], np.uint8)
        for k in range(4):
            out[start[short] + k] = whole[short] >> (24 - 8 * k) & 255
            out[start[short] + 4 + k] = letters[codes[short], k]
        for i in kept[(head != 8)[kept]].tolist():
            at, plain = int(start[i]), int(head[i]) - (16 if is_uuid[i] else 0)
            if plain == 16:
                content[at : at + 16] = b"\0\0\0\1" + names[codes[i]] + int(whole[i]).to_bytes(8, "big")
            if is_uuid[i]:
                content[at + plain : at + plain + 16] = bytes.fromhex(dict(left.column("fields")[i].as_py() or []).get("uuid", ""))
        some = kept[own[kept] > 0]
        data = memoryview(payload.buffers()[2]) if len(some) else b""
        spots = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset :]
        for at, a, n in zip((start + head)[some].tolist(), spots[some].tolist(), own[some].tolist()):
            content[at : at + n] = data[a : a + n]
        for i in kept[own[kept] < 0].tolist():
            if source is None:
                raise ValueError(f"the bytes of a {names[codes[i]].decode('latin-1')} box are neither in its row nor in a file")
            at, a = int(start[i] + head[i]), offsets[i].as_py() + int(old_head[i])
            content[at : at + int(body[i])] = memoryview(source)[a : a + int(body[i])]
        one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(content)], np.int32)), pa.py_buffer(content)])
        return pa.table({"file": left.column("file").slice(0, 1).combine_chunks().cast(pa.string()), "content": one})

    own = files.select(F.col("path").alias("file"), "content")
    df = df.select("file", "atom_id", "parent_id", "ordinal", "type", "offset", "header_size", "size", "payload", F.when(F.col("type") == "uuid", F.col("fields")).alias("fields"))
    return df.groupBy("file").cogroup(own.groupBy("file")).applyInArrow(work, "file string, content binary")


def dump_json(df: DataFrame) -> DataFrame:
    """(file, line): every box as a JSON object, in file order."""
    row = F.struct("atom_id", "parent_id", "depth", F.col("type").alias("name"), "header_size", "size", "version", "flags", "fields")
    return df.select("file", "atom_id", F.to_json(row).alias("line"))


def dump_text(df: DataFrame) -> DataFrame:
    """(file, atom_id, line): every box as an indented line."""
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), F.col("type"), F.lit("] size="), F.col("header_size").cast("string"), F.lit("+"), (F.col("size") - F.col("header_size")).cast("string"), F.when(F.size("fields") > 0, F.concat(F.lit(" "), fields)).otherwise(""))
    return df.select("file", "atom_id", line.alias("line"))
