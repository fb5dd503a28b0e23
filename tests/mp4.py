"""Files of boxes for tests, byte by byte."""

import struct


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind.encode("latin-1") + body


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def u64(*values: int) -> bytes:
    return struct.pack(f">{len(values)}Q", *values)


def track(track_id: int, handler: str, timescale: int, stts, ctts, stsc, sizes, offsets, stss, entry: bytes, language: int = 0x55C4) -> bytes:
    duration = sum(c * d for c, d in stts)
    tables = [
        full("stsd", 0, 0, u32(1), entry),
        full("stts", 0, 0, u32(len(stts)), *[u32(*e) for e in stts]),
        *([full("ctts", 0, 0, u32(len(ctts)), *[u32(*e) for e in ctts])] if ctts else []),
        full("stsc", 0, 0, u32(len(stsc)), *[u32(*e) for e in stsc]),
        full("stsz", 0, 0, u32(0, len(sizes)), u32(*sizes)),
        full("stco", 0, 0, u32(len(offsets)), u32(*offsets)),
        *([full("stss", 0, 0, u32(len(stss)), u32(*stss))] if stss else []),
    ]
    mdhd = full("mdhd", 0, 0, u32(0, 0, timescale, duration), struct.pack(">HH", language, 0))
    hdlr = full("hdlr", 0, 0, u32(0), handler.encode(), bytes(12), b"handler\0")
    tkhd = full("tkhd", 0, 7, u32(0, 0, track_id, 0, duration), bytes(8), bytes(8), bytes(36), u32(640 << 16, 360 << 16))
    return box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", full("vmhd", 0, 1, bytes(8)), box("stbl", *tables))))


AVC_ENTRY = box("avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), u32(0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1), box("avcC", bytes([1, 100, 0, 31, 0xFF, 0xE1, 0, 4, 0x67, 100, 0, 31, 1, 0, 2, 0x68, 0xCE])))
AAC_ENTRY = box("mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHH", 2, 16, 0, 0), u32(22050 << 16))


def static_av() -> bytes:
    """54 video samples at 30000 ticks, sync every 12; 78 audio samples at 22050; 3 chunks of video, 2 of audio."""
    ftyp = box("ftyp", b"isom", u32(512), b"isomavc1")
    sizes_v, sizes_a = [100 + k for k in range(54)], [50 + k % 7 for k in range(78)]

    def moov(base: int) -> bytes:
        chunks_v, at = [], base
        for a, b in ((0, 20), (20, 40), (40, 54)):
            chunks_v.append(at)
            at += sum(sizes_v[a:b])
        chunks_a = []
        for a, b in ((0, 50), (50, 78)):
            chunks_a.append(at)
            at += sum(sizes_a[a:b])
        video = track(1, "vide", 30000, [(54, 1001)], [(10, 2002), (44, 1001)], [(1, 20, 1), (3, 14, 1)], sizes_v, chunks_v, [1, 13, 25, 37, 49], AVC_ENTRY)
        audio = track(2, "soun", 22050, [(78, 1024)], [], [(1, 50, 1), (2, 28, 1)], sizes_a, chunks_a, [], AAC_ENTRY)
        mvhd = full("mvhd", 0, 0, u32(0, 0, 1000, 1802), u32(0x10000), struct.pack(">H", 256), bytes(10), bytes(36), bytes(24), u32(3))
        return box("moov", mvhd, video, audio)

    base = len(ftyp) + len(moov(0)) + 8
    payload = bytes(k % 251 for k in range(sum(sizes_v) + sum(sizes_a)))
    return ftyp + moov(base) + box("mdat", payload)


def fragmented() -> bytes:
    """Two fragments of one track: the first with a base time and first-sample flags, the second with neither."""
    ftyp = box("ftyp", b"iso5", u32(1), b"iso5")
    trex = full("trex", 0, 0, u32(1, 1, 500, 77, 0x10000))
    moov = box("moov", full("mvhd", 0, 0, u32(0, 0, 1000, 0), u32(0x10000), struct.pack(">H", 256), bytes(10), bytes(36), bytes(24), u32(2)), track(1, "vide", 1000, [], [], [], [], [], [], AVC_ENTRY), box("mvex", trex))
    traf1 = box("traf", full("tfhd", 0, 0x020000, u32(1)), full("tfdt", 0, 0, u32(9000)), full("trun", 0, 0x205, u32(3, 100, 0), u32(10, 20, 30)))
    moof1 = box("moof", full("mfhd", 0, 0, u32(1)), traf1)
    traf2 = box("traf", full("tfhd", 0, 0x020008, u32(1, 250)), full("trun", 0, 0x800, u32(2), struct.pack(">Ii", 5, 7)[0:8]))
    moof2 = box("moof", full("mfhd", 0, 0, u32(2)), traf2)
    return ftyp + moov + moof1 + box("mdat", bytes(60)) + moof2 + box("mdat", bytes(154))
