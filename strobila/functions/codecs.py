"""Elementary streams: frames and units of AAC, AC-3, AVC and HEVC, and the bits inside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Sampling frequencies by index in AAC, and in AC-3; AC-3 bit rates in kbit/s by half the frame size code.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
AC3_RATES = [48000, 44100, 32000]
AC3_KBITS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_CHANNELS = [2, 1, 2, 3, 3, 4, 4, 5]


class Bits:
    """Reads bits from the highest down; past the end it raises an error."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise ValueError("bits end early")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def unsigned(self) -> int:
        """An Exp-Golomb code."""
        zeros = 0
        while not self.read(1):
            zeros += 1
        return (1 << zeros) - 1 + self.read(zeros)

    def signed(self) -> int:
        k = self.unsigned()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def adts_frames(data: bytes) -> Iterator[dict]:
    """Frames of an ADTS stream; bytes between frames are skipped."""
    at = 0
    while at + 7 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
            at += 1
            continue
        head = 7 if data[at + 1] & 1 else 9
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        rate = data[at + 2] >> 2 & 15
        if size < head or at + size > len(data) or rate >= len(AAC_RATES):
            at += 1
            continue
        yield {"offset": at, "size": size, "header_size": head, "profile": (data[at + 2] >> 6) + 1, "sample_rate": AAC_RATES[rate], "channels": (data[at + 2] & 1) << 2 | data[at + 3] >> 6, "samples": 1024 * ((data[at + 6] & 3) + 1)}
        at += size


def ac3_frames(data: bytes) -> Iterator[dict]:
    at = 0
    while at + 7 <= len(data):
        if data[at] != 0x0B or data[at + 1] != 0x77:
            at += 1
            continue
        bsid = data[at + 5] >> 3
        if bsid > 10:
            frame = _eac3_frame(data, at)
        else:
            rate, code = data[at + 4] >> 6, data[at + 4] & 63
            frame = None
            if rate < 3 and code // 2 < len(AC3_KBITS):
                words = AC3_KBITS[code // 2] * 96000 // AC3_RATES[rate] + (code & 1 if rate == 1 else 0)
                mode = data[at + 6] >> 5
                bits = Bits(data[at + 6 : at + 9])
                bits.read(3)
                for on in (mode & 1 and mode != 1, mode & 4, mode == 2):
                    if on:
                        bits.read(2)
                lfe = bits.read(1)
                frame = {"offset": at, "size": 2 * words, "bsid": bsid, "sample_rate": AC3_RATES[rate], "channels": AC3_CHANNELS[mode] + lfe, "samples": 1536}
        if frame is None or at + frame["size"] > len(data):
            at += 1
            continue
        yield frame
        at += frame["size"]


def _eac3_frame(data: bytes, at: int) -> dict | None:
    bits = Bits(data[at + 2 : at + 6])
    bits.read(5)
    size = 2 * (bits.read(11) + 1)
    rate = bits.read(2)
    if rate == 3:
        half, blocks = bits.read(2), 6
        if half == 3:
            return None
        hertz = AC3_RATES[half] // 2
    else:
        hertz, blocks = AC3_RATES[rate], (1, 2, 3, 6)[bits.read(2)]
    mode, lfe = bits.read(3), bits.read(1)
    return {"offset": at, "size": size, "bsid": data[at + 5] >> 3, "sample_rate": hertz, "channels": AC3_CHANNELS[mode] + lfe, "samples": 256 * blocks}


def split_units(data: bytes) -> list[bytes]:
    """NAL units between start codes, without trailing zeros."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0:
        nxt = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : nxt if nxt >= 0 else len(data)].rstrip(b"\0")
        if unit:
            out.append(unit)
        at = nxt
    return out


def unescape(unit: bytes) -> bytes:
    """Without the bytes that keep start codes from appearing."""
    out, zeros = bytearray(), 0
    for k, b in enumerate(unit):
        if zeros >= 2 and b == 3 and (k + 1 == len(unit) or unit[k + 1] <= 3):
            zeros = 0
            continue
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


def escape(unit: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for b in unit:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


_CHROMA_PROFILES = frozenset([100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135])


def avc_sequence(unit: bytes) -> dict:
    """The fields of an AVC sequence parameter set that tell the picture's size and order."""
    bits = Bits(unescape(unit)[1:])
    out = {"profile": bits.read(8), "constraints": bits.read(8), "level": bits.read(8), "id": bits.unsigned(), "chroma_format": 1}
    if out["profile"] in _CHROMA_PROFILES:
        out["chroma_format"] = bits.unsigned()
        if out["chroma_format"] == 3:
            bits.read(1)
        out["luma_depth"], out["chroma_depth"] = bits.unsigned() + 8, bits.unsigned() + 8
        bits.read(1)
        if bits.read(1):
            for k in range(8 if out["chroma_format"] != 3 else 12):
                if bits.read(1):
                    last = following = 8
                    for _ in range(16 if k < 6 else 64):
                        if following:
                            following = (last + bits.signed()) % 256
                        last = following or last
    out["frame_number_bits"] = bits.unsigned() + 4
    out["order_type"] = bits.unsigned()
    if out["order_type"] == 0:
        out["order_bits"] = bits.unsigned() + 4
    elif out["order_type"] == 1:
        bits.read(1)
        bits.signed()
        bits.signed()
        for _ in range(bits.unsigned()):
            bits.signed()
    out["reference_frames"] = bits.unsigned()
    bits.read(1)
    wide, high = bits.unsigned() + 1, bits.unsigned() + 1
    out["frames_only"] = bits.read(1)
    if not out["frames_only"]:
        bits.read(1)
    bits.read(1)
    crop = [bits.unsigned() for _ in range(4)] if bits.read(1) else [0] * 4
    step_x = 1 if out["chroma_format"] in (0, 3) else 2
    step_y = (2 if out["chroma_format"] == 1 else 1) * (2 - out["frames_only"])
    out["width"] = 16 * wide - step_x * (crop[0] + crop[1])
    out["height"] = 16 * high * (2 - out["frames_only"]) - step_y * (crop[2] + crop[3])
    return out


def audio_config(data: bytes) -> dict:
    """An AAC decoder's configuration."""
    bits = Bits(data)

    def kind() -> int:
        k = bits.read(5)
        return 32 + bits.read(6) if k == 31 else k

    def rate() -> int:
        k = bits.read(4)
        return bits.read(24) if k == 15 else AAC_RATES[k]

    out = {"object_type": kind(), "sample_rate": rate(), "channels": bits.read(4), "sbr": False, "ps": False}
    if out["object_type"] in (5, 29):
        out["sbr"], out["ps"] = True, out["object_type"] == 29
        out["extension_rate"], out["object_type"] = rate(), kind()
    return out


def descriptors(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of the descriptors of an elementary stream box, those inside others after them."""
    at = 0
    while at < len(data):
        tag, at, size = data[at], at + 1, 0
        while at < len(data):
            b = data[at]
            size, at = size << 7 | b & 127, at + 1
            if not b & 128:
                break
        body = data[at : at + size]
        yield tag, body
        if tag == 3 and len(body) >= 3:
            flags = body[2]
            skip = 3 + (2 if flags & 0x80 else 0)
            if flags & 0x40:
                skip += 1 + (body[skip] if skip < len(body) else 0)
            yield from descriptors(body[skip + (2 if flags & 0x20 else 0) :])
        elif tag == 4:
            yield from descriptors(body[13:])
        at += size


#: Dolby Vision's own name for each coding of its base layer.
_DOLBY_VISION = {"avc1": "dva1", "avc3": "dvav", "hev1": "dvhe", "hvc1": "dvh1"}


def codec_name(coding: str, boxes: dict[str, dict]) -> str:
    """The name that manifests give a sample entry's coding, from the fields of the boxes inside it, by their types."""
    name = coding
    if f := boxes.get("avcC"):
        name = f"{coding}.{int(f['profile']):02X}{int(f['profile_compatibility']):02X}{int(f['level']):02X}"
    elif f := boxes.get("hvcC"):
        space = int(f["profile_space"])
        flags = int(f"{int(f['profile_compatibility'], 16):032b}"[::-1], 2)
        limits = f["constraint"]
        while limits and limits.endswith("00"):
            limits = limits[:-2]
        name = f"{coding}.{chr(64 + space) if space else ''}{f['profile']}.{flags:X}.{'H' if int(f['tier']) else 'L'}{f['level']}.{int(limits or '0', 16):x}"
    elif f := boxes.get("av1C"):
        depth = 8 if not int(f["high_bitdepth"]) else 12 if int(f["twelve_bit"]) else 10
        x, y = int(f["chroma_subsampling_x"]), int(f["chroma_subsampling_y"])
        place = int(f["chroma_sample_position"]) if x and y else 0
        name = f"{coding}.{f['seq_profile']}.{int(f['seq_level_idx_0']):02d}{'H' if int(f['seq_tier_0']) else 'M'}.{depth:02d}.{int(f['monochrome'])}.{x}{y}{place}.01.01.01.0"
    elif f := boxes.get("vpcC"):
        bits = int(f["depth_and_flags"])
        rest = (f["profile"], f["level"], bits >> 4, bits >> 1 & 7, f["colour_primaries"], f["transfer_characteristics"], f["matrix_coefficients"], bits & 1)
        name = ".".join([coding, *(f"{int(x):02d}" for x in rest)])
    elif coding == "mp4a" and (f := boxes.get("esds")):
        found = dict(descriptors(bytes.fromhex(f["descriptors"])))
        kind = found[4][0] if found.get(4) else 0x40
        name = f"mp4a.{kind:02X}"
        if kind == 0x40 and found.get(5):
            own = audio_config(found[5])
            name += f".{29 if own['ps'] else 5 if own['sbr'] else own['object_type']}"
    if f := boxes.get("dvcC") or boxes.get("dvvC"):
        own = f"{_DOLBY_VISION.get(coding, coding)}.{int(f['dv_profile']):02d}.{int(f['dv_level']):02d}"
        name = own if coding in _DOLBY_VISION.values() else f"{name},{own}"
    return name


_FRAME = "path string, frame_index long, offset long, size long, sample_rate long, channels long, samples long"


def audio_frames(files: DataFrame, kind: str = "adts") -> DataFrame:
    """(path, frame_index, offset, size, sample_rate, channels, samples) of elementary audio streams."""
    parse = {"adts": adts_frames, "ac3": ac3_frames}[kind]

    def work(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [(path, k, f["offset"], f["size"], f["sample_rate"], f["channels"], f["samples"]) for k, f in enumerate(parse(bytes(content)))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FRAME.split(", ")])

    return files.select("path", "content").mapInPandas(work, _FRAME)


def units(files: DataFrame, hevc: bool = False) -> DataFrame:
    """(path, unit_index, unit_type, size, unit) of start-code byte streams."""

    def work(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [(path, k, u[0] >> 1 & 63 if hevc else u[0] & 31, len(u), u) for k, u in enumerate(split_units(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "unit_index", "unit_type", "size", "unit"])

    return files.select("path", "content").mapInPandas(work, "path string, unit_index long, unit_type int, size long, unit binary")


def _profile_tier_level(bits: Bits, layers: int) -> dict:
    out = {"profile_space": bits.read(2), "tier": bits.read(1), "profile": bits.read(5), "compatibility": bits.read(32)}
    bits.read(48)
    out["level"] = bits.read(8)
    present = [(bits.read(1), bits.read(1)) for _ in range(layers)]
    if layers:
        bits.read(2 * (8 - layers))
    for profile, level in present:
        if profile:
            bits.read(88)
        if level:
            bits.read(8)
    return out


def hevc_sequence(unit: bytes) -> dict:
    """The first fields of an HEVC sequence parameter set: profile, level, picture size, depths, order bits."""
    bits = Bits(unescape(unit)[2:])
    bits.read(4)
    layers = bits.read(3)
    bits.read(1)
    out = _profile_tier_level(bits, layers)
    out["id"] = bits.unsigned()
    out["chroma_format"] = bits.unsigned()
    if out["chroma_format"] == 3:
        bits.read(1)
    wide, high = bits.unsigned(), bits.unsigned()
    crop = [bits.unsigned() for _ in range(4)] if bits.read(1) else [0] * 4
    step_x, step_y = (2 if out["chroma_format"] in (1, 2) else 1), (2 if out["chroma_format"] == 1 else 1)
    out["width"], out["height"] = wide - step_x * (crop[0] + crop[1]), high - step_y * (crop[2] + crop[3])
    out["luma_depth"], out["chroma_depth"] = bits.unsigned() + 8, bits.unsigned() + 8
    out["order_bits"] = bits.unsigned() + 4
    return out


def slice_type(unit: bytes) -> str | None:
    """``I``, ``P`` or ``B`` of an AVC slice; None for other units."""
    if not unit or unit[0] & 31 not in (1, 2, 5):
        return None
    bits = Bits(unescape(unit[:64])[1:])
    bits.unsigned()
    return "PBIPI"[bits.unsigned() % 5]


def frame_rate_ratio(rate: float) -> tuple[int, int]:
    """A frame rate as a ratio of whole numbers, the closest with a denominator of 100,000 at most."""
    from fractions import Fraction

    f = Fraction(str(rate)).limit_denominator(100_000)
    return f.numerator, f.denominator
