"""Layouts of box payloads, in a small notation, and their decoding.

A layout is a list of fields ``name:kind``. Kinds: ``u8 u16 u24 u32 u64 i8 i16 i32 i64`` big-endian integers; ``V`` u64 in
version 1, else u32; ``F16`` and ``F8`` fixed point with 16 and 8 fraction bits; ``4cc``; ``hN`` N bytes as hex; ``skipN``;
``str`` up to a zero byte; ``text`` and ``hex`` the rest; ``lang``. ``?mask`` before a field: only if that flag bit is
set; ``?vN`` only from version N on. ``count*[...]`` repeats a list as often as the field ``count`` says, ``**[...]`` to
the end of the payload. Repeated fields become ``name[i]``.
"""

from __future__ import annotations

import re
import struct

#: Boxes that hold only boxes.
CONTAINERS = frozenset(
    "moov trak mdia minf dinf stbl mvex moof traf mfra tref edts udta ilst schi sinf hnti mdri wave marl odrm odkm ipro".split()
)
#: Boxes with fields before their child boxes: bytes before the children.
PREFIXED = {"meta": 4, "dref": 8, "stsd": 8}
#: Sample entries by kind of fields before their child boxes.
AUDIO_ENTRIES = frozenset("mp4a enca ac-3 ec-3 ac-4 mlpa alac dtsc dtsh dtsl dtse fLaC Opus drms".split())
VISUAL_ENTRIES = frozenset("mp4v encv avc1 avc2 avc3 avc4 dvav dva1 hev1 hvc1 dvhe dvh1 av01 vp08 vp09 vp10 drmi".split())
OTHER_ENTRIES = frozenset(["mp4s", "rtp ", "stpp"])

_AUDIO = "skip6 data_reference_index:u16 qt_version:u16 skip6 channel_count:u16 sample_size:u16 skip4 sample_rate:F16"
_VISUAL = "skip6 data_reference_index:u16 skip16 width:u16 height:u16 horizontal:F16 vertical:F16 skip4 frame_count:u16 compressor_raw:h32 depth:u16 skip2"

#: (full box, layout). Field names are those that a dump shows.
LAYOUTS: dict[str, tuple[bool, str]] = {
    "ftyp": (False, "major_brand:4cc minor_version:u32 **[compatible_brand:4cc]"),
    "styp": (False, "major_brand:4cc minor_version:u32 **[compatible_brand:4cc]"),
    "mvhd": (True, "creation_time:V modification_time:V timescale:u32 duration:V rate:F16 volume:F8 skip10 matrix_raw:h36 skip24 next_track_id:u32"),
    "mehd": (True, "duration:V"),
    "mfhd": (True, "sequence_number:u32"),
    "trex": (True, "track_id:u32 default_sample_description_index:u32 default_sample_duration:u32 default_sample_size:u32 default_sample_flags:u32"),
    "hdlr": (True, "skip4 handler_type:4cc skip12 handler_name:str"),
    "tkhd": (True, "creation_time:V modification_time:V id:u32 skip4 duration:V skip8 layer:i16 alternate_group:i16 volume:F8 skip2 matrix_raw:h36 width:u32 height:u32"),
    "tfhd": (True, "track_id:u32 ?0x1 base_data_offset:u64 ?0x2 sample_description_index:u32 ?0x8 default_sample_duration:u32 ?0x10 default_sample_size:u32 ?0x20 default_sample_flags:u32"),
    "trun": (True, "sample_count:u32 ?0x1 data_offset:i32 ?0x4 first_sample_flags:u32 sample_count*[?0x100 d:u32 ?0x200 s:u32 ?0x400 f:u32 ?0x800 c:i32]"),
    "mfro": (True, "mfra_size:u32"),
    "mdhd": (True, "creation_time:V modification_time:V timescale:u32 duration:V language:lang skip2"),
    "stsc": (True, "entry_count:u32 entry_count*[first_chunk:u32 samples_per_chunk:u32 sample_desc_index:u32]"),
    "stco": (True, "entry_count:u32 entry_count*[offset:u32]"),
    "co64": (True, "entry_count:u32 entry_count*[offset:u64]"),
    "stts": (True, "entry_count:u32 entry_count*[sample_count:u32 sample_duration:u32]"),
    "ctts": (True, "entry_count:u32 entry_count*[count:u32 offset:i32]"),
    "stss": (True, "entry_count:u32 entry_count*[sample:u32]"),
    "url ": (True, "location:str"),
    "elst": (True, "entry_count:u32 entry_count*[segment_duration:V media_time:S media_rate:F16]"),
    "vmhd": (True, "graphics_mode:u16 op_color:h6"),
    "smhd": (True, "balance:i16 skip2"),
    "nmhd": (True, ""),
    "sthd": (True, ""),
    "hmhd": (True, "max_pdu_size:u16 avg_pdu_size:u16 max_bitrate:u32 avg_bitrate:u32"),
    "frma": (False, "original_format:4cc"),
    "schm": (True, "scheme_type:4cc scheme_version:u32 ?0x1 scheme_uri:str"),
    "tims": (False, "timescale:u32"),
    "sdp ": (False, "sdp_text:text"),
    "rtp ": (False, "description_format:4cc sdp_text:text"),
    "iKMS": (True, "kms_uri:str"),
    "iSFM": (True, "selective_encryption:u8 key_indicator_length:u8 IV_length:u8"),
    "iSLT": (False, "salt:h8"),
    "odhe": (True, "content_type_length:u8 content_type_and_children:hex"),
    "ohdr": (True, "encryption_method:u8 padding_scheme:u8 plaintext_length:u64 content_id_length:u16 rights_issuer_url_length:u16 textual_headers_length:u16 headers:hex"),
    "odda": (True, "encrypted_data_length:u64"),
    "odaf": (True, "selective_encryption:u8 key_indicator_length:u8 IV_length:u8"),
    "grpi": (True, "group_id_length:u16 key_encryption_method:u8 group_key_length:u16 group:hex"),
    "tfdt": (True, "base_media_decode_time:V"),
    "tenc": (True, "skip1 pattern:u8 default_isProtected:u8 default_Per_Sample_IV_Size:u8 default_KID:h16 constant_iv:hex"),
    "saiz": (True, "?0x1 aux_info_type:4cc ?0x1 aux_info_type_parameter:u32 default_sample_info_size:u8 sample_count:u32 sizes:hex"),
    "saio": (True, "?0x1 aux_info_type:4cc ?0x1 aux_info_type_parameter:u32 entry_count:u32 entry_count*[entry:V]"),
    "senc": (True, "sample_info_count:u32 info:hex"),
    "pdin": (True, "**[rate:u32 initial_delay:u32]"),
    "bloc": (True, "base_location:h256 purchase_location:h256"),
    "ainf": (True, "profile_version:u32 APID:str"),
    "pssh": (True, "system_id:h16 ?v1 kid_count:u32 ?v1 kid_count*[kid:h16] data_size:u32 data:hex"),
    "sidx": (True, "reference_ID:u32 timescale:u32 earliest_presentation_time:V first_offset:V skip2 reference_count:u16 reference_count*[reference:u32 subsegment_duration:u32 sap:u32]"),
    "sbgp": (True, "grouping_type:4cc ?v1 grouping_type_parameter:u32 entry_count:u32 entry_count*[sample_count:u32 group_description_index:u32]"),
    "sgpd": (True, "grouping_type:4cc ?v1 default_length:u32 entry_count:u32 entries:hex"),
    "mkid": (True, "entry_count:u32 entries:hex"),
    "dmlp": (False, "format_info:u32 peak_data_rate:u16 skip4"),
    "colr": (False, "colour_type:4cc ?nclx primaries:u16 ?nclx transfer:u16 ?nclx matrix:u16 rest:hex"),
    "8id ": (False, "value:str"),
    "8bdl": (False, "encoding:4cc encoding_version:u32 bundle_data:hex"),
    "mfra": (False, ""),
    "vpcC": (True, "profile:u8 level:u8 depth_and_flags:u8 colour_primaries:u8 transfer_characteristics:u8 matrix_coefficients:u8 init_size:u16 init:hex"),
    "esds": (True, "descriptors:hex"),
    "iods": (True, "descriptors:hex"),
} | {t: (False, "**[track_id:u32]") for t in "hint cdsc sync mpod dpnd ipir alis chap".split()}


class Truncated(ValueError):
    """A payload that ends before its layout does."""


def parse_layout(text: str) -> list[tuple]:
    """Nested (condition, name, kind) and (condition, count, [...]) items."""
    items, cond = [], None
    at = 0
    pattern = re.compile(r"\s*(?:\?(\S+)|(\S*?)\*\[|(\])|([^\s\]]+))")
    stack = []
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            break
        at = m.end()
        if m[1]:
            cond = m[1]
        elif m[2] is not None and text[at - 1] == "[":
            stack.append((items, cond, m[2] or "", cond))
            items, cond = [], None
        elif m[3]:
            inner, (items, c, count, _) = items, stack.pop()
            items.append((c, "*" if count == "*" else count, inner))
        else:
            name, _, kind = m[4].rpartition(":")
            items.append((cond, name, kind))
            cond = None
    return items


_parsed: dict[str, list[tuple]] = {}


def entry_size(items: list[tuple], version: int, flags: int) -> int:
    """Bytes of one entry of a repeated list of fields of fixed size."""
    size = 0
    for cond, _, kind in items:
        if cond and cond[0] == "v" and version < int(cond[1:]) or cond and cond[:2] == "0x" and not flags & int(cond, 16):
            continue
        if kind in ("V", "S"):
            size += 8 if version else 4
        elif kind in _FIXED:
            size += _FIXED[kind]
        else:
            size += int(kind[1:]) // 8 if kind[0] in "ui" else int(kind.lstrip("hskip"))
    return size


_FIXED = {"F16": 4, "F8": 2, "4cc": 4, "lang": 2}
_CODES = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i8": "b", "i16": "h", "i32": "i", "i64": "q"}
#: Readers of layouts for a version and flags, and how many are kept.
_readers: dict[tuple, tuple | None] = {}
_READERS = 1 << 12


def _reader(items: list[tuple], version: int, flags: int, entries: bool) -> tuple | None:
    """(names, reader of all numbers, which of them counts a list that is passed over or None, bytes of its entry); None
    for a layout of other things."""
    names, form, counted, entry = [], ">", None, 0
    for cond, name, kind in items:
        if cond is not None and cond[0] != "v" and cond[:2] != "0x" or counted is not None:
            return None
        if cond is not None and not (version >= int(cond[1:]) if cond[0] == "v" else flags & int(cond, 16)):
            continue
        if isinstance(kind, list):
            if entries or name not in names:
                return None
            counted, entry = names.index(name), entry_size(kind, version, flags)
            continue
        if kind.startswith("skip"):
            form += f"{int(kind[4:])}x"
            continue
        kind = {"V": "u64" if version else "u32", "S": "i64" if version else "i32"}.get(kind, kind)
        if kind not in _CODES:
            return None
        names.append(name)
        form += _CODES[kind]
    return names, struct.Struct(form), counted, entry


def decode(layout: str, data: bytes, version: int = 0, flags: int = 0, entries: bool = True) -> tuple[dict[str, object], int]:
    """Field values of a payload, and how many of its bytes the layout takes; an impossible count is refused. Without
    ``entries`` lists of a counted number of entries are checked for length and passed over."""
    items = _parsed.get(layout)
    if items is None:
        items = _parsed[layout] = parse_layout(layout)
    key = layout, version, flags, entries
    if key not in _readers and len(_readers) < _READERS:
        _readers[key] = _reader(items, version, flags, entries)
    found = _readers.get(key)
    if found is not None and found[1].size <= len(data):
        names, reader, counted, entry = found
        values = reader.unpack_from(data)
        end = reader.size + (0 if counted is None else values[counted] * entry)
        if end <= len(data):
            return dict(zip(names, values)), end
    out: dict[str, object] = {}
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise Truncated(f"{n} bytes wanted at {at} of {len(data)}")
        part = data[at : at + n]
        at += n
        return part

    def value(kind: str) -> object:
        nonlocal at
        if kind == "V":
            kind = "u64" if version else "u32"
        elif kind == "S":
            kind = "i64" if version else "i32"
        if kind[0] in "ui" and kind[1:].isdigit():
            return int.from_bytes(take(int(kind[1:]) // 8), "big", signed=kind[0] == "i")
        if kind == "F16":
            return int.from_bytes(take(4), "big", signed=True) / 65536
        if kind == "F8":
            return int.from_bytes(take(2), "big", signed=True) / 256
        if kind == "4cc":
            return take(4).decode("latin-1")
        if kind == "lang":
            raw = int.from_bytes(take(2), "big")
            parts = [raw >> s & 31 for s in (10, 5, 0)]
            return "und" if raw == 0x7FFF else "```" if 0 in parts else "".join(chr(0x60 + p) for p in parts)
        if kind == "str":
            end = data.find(b"\0", at)
            part = data[at : end if end >= 0 else len(data)]
            at = end + 1 if end >= 0 else len(data)
            return part.decode("utf-8", "replace")
        if kind in ("text", "hex"):
            part, at = data[at:], len(data)
            return part.decode("utf-8", "replace").rstrip("\0") if kind == "text" else part.hex()
        return take(int(kind[1:])).hex()

    def met(cond: str | None) -> bool:
        if cond is None:
            return True
        if cond[0] == "v":
            return version >= int(cond[1:])
        if cond[:2] == "0x":
            return bool(flags & int(cond, 16))
        return out.get("colour_type") == cond

    def walk(items: list[tuple], suffix: str) -> None:
        for cond, name, kind in items:
            if not met(cond):
                continue
            if isinstance(kind, list) and not entries and name != "*":
                take(entry_size(kind, version, flags) * int(out.get(name + suffix, 0)))
            elif isinstance(kind, list):
                k, start = 0, at
                while (at < len(data)) if name == "*" else k < int(out.get(name + suffix, 0)):
                    before = at
                    walk(kind, f"{suffix}[{k}]")
                    k += 1
                    if at == before and kind:
                        if name == "*" or k > len(data):
                            break
                del start
            elif kind.startswith("skip"):
                take(int(kind[4:]))
            else:
                out[name + suffix] = value(kind)

    walk(items, "")
    return out, at
