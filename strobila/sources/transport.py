"""Transport streams: program tables and packetised samples in packets of 188 bytes, one segment for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Packet size, packet ids that this writer uses, stream types, and ticks of the clock in a second.
PACKET, PMT_PID, PIDS = 188, 0x100, {"audio": 0x101, "video": 0x102}
STREAM_TYPES = {"avc1": 0x1B, "hvc1": 0x24, "mp4a": 0x0F, "ac-3": 0x81, "ec-3": 0x87}
CLOCK = 90_000
_STREAM_IDS = {"audio": 0xC0, "video": 0xE0}


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, all ones at the start, bits not reflected."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


class Muxer:
    """Packets of one program. Continuity counters go on from call to call."""

    def __init__(self, streams: dict[str, str]):
        self.streams = streams  # kind -> coding
        self.counters: dict[int, int] = {}

    def _packet(self, pid: int, payload: bytes, start: bool, pcr: int | None = None, sync: bool = False) -> bytes:
        count = self.counters.get(pid, 0)
        self.counters[pid] = (count + 1) % 16
        room = PACKET - 4
        field = b""
        if pcr is not None or sync or len(payload) < room:
            flags = (0x40 if sync else 0) | (0x10 if pcr is not None else 0)
            body = bytes([flags])
            if pcr is not None:
                base = pcr % (1 << 33)
                body += (base << 15 | 0x7E00).to_bytes(6, "big")
            fill = room - len(payload) - 1 - len(body)
            if fill < 0 and pcr is None and not sync:
                body, fill = b"", room - len(payload) - 1
            field = bytes([len(body) + max(0, fill)]) + body + b"\xff" * max(0, fill)
        head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | count])
        out = head + field + payload[: room - len(field)]
        assert len(out) == PACKET
        return out

    def _table(self, pid: int, body: bytes) -> bytes:
        section = body + crc32_mpeg(body).to_bytes(4, "big")
        return self._packet(pid, (b"\0" + section).ljust(PACKET - 4, b"\xff"), True)

    def tables(self) -> bytes:
        pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
        loop = b"".join(bytes([STREAM_TYPES[c], 0xE0 | PIDS[k] >> 8, PIDS[k] & 255, 0xF0, 0]) for k, c in sorted(self.streams.items()))
        clock = PIDS["video" if "video" in self.streams else "audio"]
        size = 9 + len(loop) + 4
        pmt = bytes([0x02, 0xB0 | size >> 8, size & 255, 0, 1, 0xC1, 0, 0, 0xE0 | clock >> 8, clock & 255, 0xF0, 0]) + loop
        return self._table(0, pat) + self._table(PMT_PID, pmt)

    @staticmethod
    def _stamp(mark: int, t: int) -> bytes:
        t %= 1 << 33
        return bytes([mark << 4 | t >> 29 & 0xE | 1, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])

    def sample(self, kind: str, data: bytes, dts: int, pts: int, sync: bool) -> bytes:
        """One sample as a packetised element; times in ticks of the clock."""
        both = dts != pts
        stamps = self._stamp(3 if both else 2, pts) + (self._stamp(1, dts) if both else b"")
        size = 3 + len(stamps) + len(data)
        if kind != "video" and size > 0xFFFF:
            raise ValueError(f"an element of {size} bytes does not fit; only video may leave its length open")
        pes = b"\0\0\1" + bytes([_STREAM_IDS[kind]]) + (0 if size > 0xFFFF else size).to_bytes(2, "big") + bytes([0x84, 0xC0 if both else 0x80, len(stamps)]) + stamps + data
        clock = kind == "video" or "video" not in self.streams
        out, at, first = [], 0, True
        while at < len(pes):
            special = first and (clock or sync)
            room = PACKET - 4 - ((8 if clock else 2) if special else 0)
            part = pes[at : at + room]
            out.append(self._packet(PIDS[kind], part, first, dts if first and clock else None, first and sync))
            at += len(part)
            first = False
        return b"".join(out)


def packets(data: bytes) -> list[dict]:
    """Headers and payloads of a stream's packets, for checking one."""
    out = []
    for at in range(0, len(data), PACKET):
        p = data[at : at + PACKET]
        if len(p) < PACKET or p[0] != 0x47:
            raise ValueError(f"no packet at {at}")
        body = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        out.append({"pid": (p[1] & 31) << 8 | p[2], "start": bool(p[1] & 0x40), "counter": p[3] & 15, "payload": p[body:] if p[3] & 0x10 else b""})
    return out


def write_segments(samples: DataFrame, streams: dict[str, str]) -> DataFrame:
    """(file, segment_index, content): samples (file, segment_index, kind, dts, pts, is_sync, data, times in clock ticks)
    in order of time, video first on ties.

    Segments are written in parallel, each with counters from 0, and counted; a running sum of the packets of the segments
    before it then gives every segment the counters with which it continues them.
    """
    pids = [0, PMT_PID, *sorted(PIDS.values())]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_k=(pdf["kind"] != "video").astype(int)).sort_values(["dts", "_k"])
        mux = Muxer(streams)
        content = b"".join([mux.tables()] + [mux.sample(r.kind, bytes(r.data), int(r.dts), int(r.pts), bool(r.is_sync)) for r in pdf.itertuples()])
        found = np.bincount(_pids(np.frombuffer(content, np.uint8).reshape(-1, PACKET)), minlength=1 << 13)
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "segment_index": [pdf["segment_index"].iloc[0]], "content": [content], "packets": [[int(found[p]) for p in pids]]})

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content, before in zip(pdf["content"], pdf["before"]):
                rows = np.frombuffer(content, np.uint8).reshape(-1, PACKET).copy()
                add = np.zeros(1 << 13, np.int64)
                add[pids] = before
                rows[:, 3] = rows[:, 3] & 0xF0 | (rows[:, 3] + add[_pids(rows)]) & 15
                out.append(rows.tobytes())
            yield pdf[["file", "segment_index"]].assign(content=out)

    parts = samples.groupBy("file", "segment_index").applyInPandas(build, "file string, segment_index long, content binary, packets array<long>")
    w = Window.partitionBy("file").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum(F.col("packets")[k]).over(w), F.lit(0)) for k in range(len(pids))])
    return parts.withColumn("before", before).drop("packets").mapInPandas(go_on, "file string, segment_index long, content binary")


def _pids(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
