"""From boxes to tracks, sample tables and samples, in static files and in fragments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strobila.functions.codecs import codec_name
from strobila.operators.fragments import NOT_SYNC, TRUN_CTS, TRUN_DATA_OFFSET, TRUN_DURATION, TRUN_FIRST_FLAGS, TRUN_FLAGS, TRUN_SIZE
from strobila.operators.groups import by_group, changes
from strobila.sources.boxes import Pieces, contents, pieces, walk

TRAK = r"^(moov\[0\]/trak\[\d+\])"
_KEYS = ["file", "track_id"]


def _trak(df: DataFrame) -> DataFrame:
    return df.withColumn("_trak", F.regexp_extract("path", TRAK, 1)).filter("_trak <> ''")


def _number(field: str) -> Column:
    return F.col("fields")[field].cast("long")


def track_ids(atoms: DataFrame) -> DataFrame:
    return _trak(atoms).filter("type = 'tkhd'").select("file", "_trak", _number("id").alias("track_id"))


def tracks(atoms: DataFrame) -> DataFrame:
    """(file, track_id, handler, timescale, media_duration, language, width_raw, height_raw, flags, movie_timescale,
    movie_duration): one row for each track."""
    rows = _trak(atoms)
    tkhd = rows.filter("type = 'tkhd'").select("file", "_trak", _number("id").alias("track_id"), _number("width").alias("width_raw"), _number("height").alias("height_raw"), "flags")
    mdhd = rows.filter("type = 'mdhd'").select("file", "_trak", _number("timescale").alias("timescale"), _number("duration").alias("media_duration"), F.col("fields")["language"].alias("language"))
    hdlr = rows.filter(F.col("path").endswith("/mdia[0]/hdlr[0]")).select("file", "_trak", F.col("fields")["handler_type"].alias("handler"))
    mvhd = atoms.filter("type = 'mvhd'").select("file", _number("timescale").alias("movie_timescale"), _number("duration").alias("movie_duration"))
    return tkhd.join(mdhd, ["file", "_trak"], "left").join(hdlr, ["file", "_trak"], "left").join(mvhd, "file", "left").drop("_trak")


def sample_descriptions(atoms: DataFrame) -> DataFrame:
    """(file, track_id, description_index, coding, fields): the sample entries of every track."""
    inside = _trak(atoms).filter(F.col("path").rlike(r"/stsd\[0\]/[^/]+$"))
    return inside.join(track_ids(atoms), ["file", "_trak"]).select(*_KEYS, (F.col("ordinal") + 1).cast("long").alias("description_index"), F.col("type").alias("coding"), "fields")


def codec_names(atoms: DataFrame) -> DataFrame:
    """(file, track_id, description_index, coding, codec): the name of every sample entry's coding; of an encrypted entry
    that of the coding that it was."""
    entries = _trak(atoms).filter(F.col("path").rlike(r"/stsd\[0\]/[^/]+$")).select("file", "_trak", "ordinal", F.col("type").alias("coding"), F.col("path").alias("entry"))
    inner = _trak(atoms).withColumn("entry", F.regexp_extract("path", r"^(.*/stsd\[0\]/[^/]+)/", 1)).filter("entry <> ''")
    inner = inner.groupBy("file", "entry").agg(F.collect_list(F.struct("type", "fields")).alias("boxes"))

    @F.udf("string")
    def name(coding: str, boxes: list | None) -> str:
        own = {}
        for b in boxes or []:
            own.setdefault(b["type"], b["fields"])
        return codec_name(own["frma"]["original_format"] if "frma" in own else coding, own)

    rows = entries.join(inner, ["file", "entry"], "left").join(track_ids(atoms), ["file", "_trak"])
    return rows.select(*_KEYS, (F.col("ordinal") + 1).cast("long").alias("description_index"), "coding", name("coding", "boxes").alias("codec"))


#: Rows that leave a table's payload at a time.
_ROWS = 1 << 18


def _unpacked(boxes: DataFrame, keep: list[str], schema: str, unpack: Callable[[int, int, bytes], list[np.ndarray]]) -> DataFrame:
    """A row for each entry of each box: ``keep`` columns, entry_index and what ``unpack`` (version, flags, payload) gives,
    decoded from the payload as arrays."""
    fields = boxes.select(*keep).schema
    names = [c.split()[0] for c in schema.split(", ")]
    out = fields.add("entry_index", "long")
    for c in schema.split(", "):
        out = out.add(*c.split())
    kinds = to_arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                *own, version, flags, payload = (b.column(k)[i].as_py() for k in range(b.num_columns))
                if payload is None:
                    raise ValueError(f"a table without its payload: {own}")
                try:
                    columns = unpack(version or 0, flags or 0, payload)
                except ValueError as e:
                    raise ValueError(f"{e}: {own}") from e
                n = len(columns[0]) if columns else 0
                for at in range(0, n, _ROWS):
                    m = min(_ROWS, n - at)
                    head = [pa.repeat(pa.scalar(v, kinds.field(k).type), m) for k, v in enumerate(own)]
                    body = [pa.array(c[at : at + m]) if isinstance(c, np.ndarray) else c.slice(at, m) for c in columns]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(at, at + m)), *body], [*keep, "entry_index", *names])

    return boxes.select(*keep, "version", "flags", "payload").mapInArrow(work, out)


def _cells(payload: bytes, at: int, count: int, layout: list[tuple[str, str]]) -> list[np.ndarray]:
    """Columns of ``count`` entries from ``at`` on; a count beyond what the payload holds raises an error."""
    kind = np.dtype([(n, k) for n, k in layout])
    if at + count * kind.itemsize > len(payload):
        raise ValueError("a table has more entries than bytes")
    rows = np.frombuffer(payload, kind, count, at) if count else np.zeros(0, kind)
    return [rows[n].astype(np.int64) for n, _ in layout]


def table(atoms: DataFrame, kind: str, names: list[str], width: int = 4, signed: tuple[str, ...] = ()) -> DataFrame:
    """(file, track_id, entry_index, names): the entries of a table box whose rows are ``names`` of ``width`` bytes each.

    A count beyond what the payload holds, or a row without its payload, raises an error.
    """
    layout = [(n, f">{'i' if n in signed else 'u'}{width}") for n in names]
    boxes = _trak(atoms).filter(F.col("type") == kind).join(track_ids(atoms), ["file", "_trak"])
    return _unpacked(boxes, _KEYS, ", ".join(f"{n} long" for n in names), lambda v, f, p: _cells(p, 8, int.from_bytes(p[4:8], "big"), layout))


def _sizes(payload: bytes, packed: bool) -> list[np.ndarray]:
    fixed, count = int.from_bytes(payload[4:8], "big"), int.from_bytes(payload[8:12], "big")
    if not packed:
        return [np.full(count, fixed, np.int64)] if fixed else _cells(payload, 12, count, [("size", ">u4")])
    if fixed & 255 == 4:
        pairs = _cells(payload, 12, (count + 1) // 2, [("size", "u1")])[0]
        return [np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count]]
    return _cells(payload, 12, count, [("size", f">u{(fixed & 255) // 8}")])


def sample_sizes(atoms: DataFrame) -> DataFrame:
    """(file, track_id, sample_index, size) from full or packed size tables; a fixed size applies to all."""
    boxes = _trak(atoms).join(track_ids(atoms), ["file", "_trak"])
    out = None
    for kind in ("stsz", "stz2"):
        own = _unpacked(boxes.filter(F.col("type") == kind), _KEYS, "size long", lambda v, f, p, packed=kind == "stz2": _sizes(p, packed))
        out = own if out is None else out.unionByName(own)
    return out.withColumnRenamed("entry_index", "sample_index")


#: The boxes of a track that say where its samples are.
_PLACES = ("tkhd", "stts", "ctts", "stsc", "stco", "co64", "stss", "stsz", "stz2")
_STATIC = "file string, track_id long, sample_index long, offset long, size long, duration long, dts long, cts_delta long, description_index long, is_sync boolean, chunk_index long"
_STATIC_NAMES = [c.split()[0] for c in _STATIC.split(", ")]


def _runs_at(counts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places ``k`` in runs of ``counts``: the run, the place in the run, and whether there is such a run."""
    ends = np.cumsum(counts)
    run = np.searchsorted(ends, k, "right")
    there = run < len(counts)
    run = np.where(there, run, 0)
    return run, k - (ends - counts)[run] if len(counts) else k, there


def _track_samples(file: str, boxes: dict[str, bytes]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray | None]]]]:
    """(rows, columns with where they are null) of a track's samples, from the payloads of its tables, ``_ROWS`` at a time."""

    def cells(kind: str, *names: str, width: int = 4) -> list[np.ndarray]:
        if kind not in boxes:
            return [np.zeros(0, np.int64) for _ in names]
        p = boxes[kind]
        layout = [(n, f">{'i' if (kind, n) == ('ctts', 'value') else 'u'}{width}") for n in names]
        return _cells(p, 8, int.from_bytes(p[4:8], "big"), layout)

    kind = "stsz" if "stsz" in boxes else "stz2"
    if kind not in boxes:
        return
    fixed, n = int.from_bytes(boxes[kind][4:8], "big"), int.from_bytes(boxes[kind][8:12], "big")
    sizes = None if kind == "stsz" and fixed else _sizes(boxes[kind], kind == "stz2")[0]
    times, durations = cells("stts", "count", "value")
    starts = np.cumsum(times * durations) - times * durations
    delays, deltas = cells("ctts", "count", "value")
    offsets = np.concatenate([cells("stco", "offset")[0], cells("co64", "offset", width=8)[0]])
    first, per, described = cells("stsc", "first", "per", "description")
    order = np.argsort(first, kind="stable")
    entry = np.searchsorted(first[order], np.arange(1, len(offsets) + 1), "right") - 1
    per, described = (np.where(entry >= 0, x[order][entry], 0) if len(x) else np.zeros(len(offsets), np.int64) for x in (per, described))
    chunk_starts = np.cumsum(per) - per
    sync = np.sort(cells("stss", "sample")[0])
    passed = in_chunk = 0  # bytes before the range, and before the chunk that it begins in
    for at in range(0, n, _ROWS):
        k = np.arange(at, min(at + _ROWS, n))
        size = np.full(len(k), fixed, np.int64) if sizes is None else sizes[at : at + len(k)]
        before = passed + np.cumsum(size) - size
        run, inside, timed = _runs_at(times, k)
        duration, dts = (durations[run], starts[run] + inside * durations[run]) if len(times) else (k, k)
        run, _, delayed = _runs_at(delays, k)
        if "ctts" in boxes and not delayed.all():
            raise ValueError(f"the composition table ends before the samples in {file}")
        delta = deltas[run] if len(deltas) else np.zeros(len(k), np.int64)
        chunk, _, placed = _runs_at(per, k)
        if len(offsets):
            begin = chunk_starts[chunk]
            since = np.where(begin >= at, before[np.clip(begin - at, 0, len(k) - 1)], in_chunk)
            offset, description, in_chunk = offsets[chunk] + before - since, described[chunk], int(since[-1])
        else:
            offset = description = k
        spot = np.searchsorted(sync, k + 1)
        is_sync = sync[np.minimum(spot, len(sync) - 1)] == k + 1 if len(sync) else np.ones(len(k), bool)
        passed += int(size.sum())
        yield len(k), [(k, None), (offset, ~placed), (size, None), (duration, ~timed), (dts, ~timed), (delta, None), (description, ~placed), (is_sync, None), (chunk + 1, ~placed)]


def static_samples(atoms: DataFrame) -> DataFrame:
    """Samples (file, track_id, sample_index, offset, size, duration, dts, cts_delta, description_index, is_sync,
    chunk_index) of static sample tables: the tables of a track meet in one task, which passes on a part of its samples at
    a time, so the boxes are read once and long tracks are not held."""
    kept = _trak(atoms).filter(F.col("type").isin(*_PLACES)).select("file", "_trak", "path", "type", "payload", F.when(F.col("type") == "tkhd", _number("id")).alias("id"))

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        files, kinds, ids = (rows.column(c).to_pylist() for c in ("file", "type", "id"))
        payloads, made, held = rows.column("payload"), [], 0

        def batch() -> pa.RecordBatch:
            counts = [n for _, _, n, _ in made]
            out = [pa.array(np.repeat(np.array([f for f, _, _, _ in made], object), counts), pa.string()), pa.array(np.repeat(np.array([t for _, t, _, _ in made], np.int64), counts))]
            for c in zip(*(columns for _, _, _, columns in made)):
                null = None if all(m is None for _, m in c) else np.concatenate([np.zeros(len(v), bool) if m is None else m for v, m in c])
                out.append(pa.array(np.concatenate([v for v, _ in c]), mask=null))
            return pa.RecordBatch.from_arrays(out, _STATIC_NAMES)

        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            track, boxes = None, {}
            for i in range(a, b):
                if kinds[i] == "tkhd":
                    track = ids[i] if track is None else track
                    continue
                payload = payloads[i].as_py()
                if payload is None:
                    raise ValueError(f"a table without its payload: {files[i]}, {kinds[i]}")
                boxes.setdefault(kinds[i], payload)
            if track is None:
                continue
            try:
                for n, columns in _track_samples(files[a], boxes):
                    made.append((files[a], track, n, columns))
                    held += n
                    if held >= _ROWS:
                        yield batch()
                        made, held = [], 0
            except ValueError as e:
                raise ValueError(f"{e}: {files[a]}, track {track}") from e
        if made:
            yield batch()

    return by_group(kept, ["file", "_trak"], ["path"], work, _STATIC)


_TRAF = "file string, moof_offset long, traf_index int, track_id long, base_data_offset long, description_index long, default_duration long, default_size long, default_flags long, base_dts long"


def _run(version: int, flags: int, payload: bytes) -> list:
    """Columns of a track run; those that it does not have are null."""
    count, at = int.from_bytes(payload[4:8], "big"), 8
    head = []
    for bit, kind in ((TRUN_DATA_OFFSET, ">i4"), (TRUN_FIRST_FLAGS, ">u4")):
        if flags & bit:
            if at + 4 > len(payload):
                raise ValueError("a track run ends early")
            head.append(pa.repeat(pa.scalar(int(np.frombuffer(payload, kind, 1, at)[0]), pa.int64()), count))
            at += 4
        else:
            head.append(pa.nulls(count, pa.int64()))
    bits = {"duration": TRUN_DURATION, "size": TRUN_SIZE, "flags": TRUN_FLAGS, "cts": TRUN_CTS}
    layout = [(n, ">i4" if n == "cts" else ">u4") for n, bit in bits.items() if flags & bit]
    found = dict(zip([n for n, _ in layout], _cells(payload, at, count, layout))) if layout else {}
    return [pa.array(found[n]) if n in found else pa.nulls(count, pa.int64()) for n in bits] + head


def fragments(atoms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traf, trun entries, trex) of all fragments. A traf without header has no samples."""
    inside = atoms.filter(F.col("path").rlike(r"^moof\[\d+\]")).withColumns({"_moof": F.regexp_extract("path", r"^(moof\[\d+\])", 1), "traf_index": F.regexp_extract("path", r"/traf\[(\d+)\]", 1), "_trun": F.regexp_extract("path", r"/trun\[(\d+)\]", 1)})
    moofs = inside.filter("path = _moof").select("file", "_moof", F.col("offset").alias("moof_offset"))
    own = inside.join(moofs, ["file", "_moof"]).filter("traf_index <> ''").withColumn("traf_index", F.col("traf_index").cast("int"))
    key = ["file", "moof_offset", "traf_index"]
    head = own.filter("type = 'tfhd'").select(
        *key, _number("track_id").alias("track_id"), _number("base_data_offset").alias("base_data_offset"), _number("sample_description_index").alias("description_index"),
        _number("default_sample_duration").alias("default_duration"), _number("default_sample_size").alias("default_size"), _number("default_sample_flags").alias("default_flags"),
    )
    base = own.filter("type = 'tfdt'").select(*key, _number("base_media_decode_time").alias("base_dts"))
    # Where the media data begins that follows a fragment.
    top = atoms.filter("depth = 0 and type in ('moof', 'mdat')").select("file", "offset", F.when(F.col("type") == "mdat", F.col("offset") + F.col("header_size")).alias("_data"))
    after = top.withColumn("payload_offset", F.first("_data", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(1, Window.unboundedFollowing)))
    after = after.filter("_data is null").select("file", F.col("offset").alias("moof_offset"), "payload_offset")
    traf = head.join(base, key, "left").join(after, ["file", "moof_offset"], "left")

    runs_ = own.filter("type = 'trun'").select(*key, F.col("_trun").cast("int").alias("trun_index"), "version", "flags", "payload")
    entries = _unpacked(runs_, [*key, "trun_index"], "duration long, size long, flags long, cts long, data_offset long, first_flags long", _run).withColumn("entry_index", F.col("entry_index").cast("int"))
    trex = atoms.filter("type = 'trex'").select("file", _number("track_id").alias("track_id"), _number("default_sample_description_index").alias("default_description_index"), _number("default_sample_duration").alias("default_duration"), _number("default_sample_size").alias("default_size"), _number("default_sample_flags").alias("default_flags"))
    return traf, entries, trex


_MOVING = "file string, track_id long, sample_index long, moof_offset long, offset long, size long, duration long, dts long, cts_delta long, description_index long, is_sync boolean"
_DEFAULTS = {"tfhd": ("track_id", "base_data_offset", "sample_description_index", "default_sample_duration", "default_sample_size", "default_sample_flags"), "trex": ("track_id", "default_sample_description_index", "default_sample_duration", "default_sample_size", "default_sample_flags"), "tfdt": ("base_media_decode_time",)}


_IN_TRAF, _TRAF_OF = r"^moof\[\d+\]/.*traf\[\d+\]", r"/traf\[(\d+)\]"
_CELLS = [(TRUN_DURATION, "duration", ">u4"), (TRUN_SIZE, "size", ">u4"), (TRUN_FLAGS, "flags", ">u4"), (TRUN_CTS, "cts", ">i4")]
#: The entries of a run by the columns that it has.
_LAYOUTS = {bits: np.dtype([(n, k) for bit, n, k in _CELLS if bits & bit]) for bits in range(0, 0x1000, 0x100)}


def _run_head(flags: int, payload: memoryview) -> tuple[int, int | None, int | None, int, int]:
    """(count, data offset, flags of its first sample, its columns, where its entries begin) of a run."""
    count, at, head = int.from_bytes(payload[4:8], "big"), 8, []
    for bit, signed in ((TRUN_DATA_OFFSET, True), (TRUN_FIRST_FLAGS, False)):
        if flags & bit and at + 4 > len(payload):
            raise ValueError("a track run ends early")
        head.append(int.from_bytes(payload[at : at + 4], "big", signed=signed) if flags & bit else None)
        at += 4 if flags & bit else 0
    bits = flags & 0xF00
    if bits and at + count * _LAYOUTS[bits].itemsize > len(payload):
        raise ValueError("a table has more entries than bytes")
    return count, *head, bits, at


_FIELDS = list(dict.fromkeys(f for v in _DEFAULTS.values() for f in v))
#: Where a field is in the numbers of a box.
_AT = {f: k for k, f in enumerate(_FIELDS)}


def _runs(file: str, rows: Iterable[tuple], payload_of: Callable[[int], bytes | pa.Buffer | None]) -> Iterator[tuple]:
    """The runs of a file, at most ``_ROWS`` samples at a time: (track, fragment's place, description, place of its data
    and time if they do not follow what is before, count, columns, entries, flags of the first sample, defaults).

    ``rows``: (number, offset, type, traf, header size, flags, numbers by ``_AT``) of its boxes in file order.
    """
    trex, trafs, moof = {}, [], None
    for i, offset, kind, traf, header_size, flags, f in rows:
        if kind == "trex":
            trex.setdefault(f[_AT["track_id"]], f)
        elif kind == "mdat":
            for t in reversed(trafs):
                if t["data"] is not None:
                    break
                t["data"] = offset + header_size
        elif kind == "moof":
            moof = offset
        elif moof is not None:
            if not trafs or trafs[-1]["moof"] != moof or trafs[-1]["traf"] != traf:
                trafs.append({"moof": moof, "traf": traf, "data": None, "head": None, "base": None, "runs": []})
            if kind == "trun":
                trafs[-1]["runs"].append((i, flags or 0))
            elif kind == "tfhd":
                trafs[-1]["head"] = f
            else:
                trafs[-1]["base"] = f[_AT["base_media_decode_time"]]
    for t in trafs:
        head = t["head"]
        if head is None:
            continue
        track, base, begun, data_base = head[_AT["track_id"]], t["base"], False, head[_AT["base_data_offset"]]
        other = trex.get(track)
        description, *defaults = (
            head[_AT[a]] if head[_AT[a]] is not None else other[_AT[b]] if other is not None and other[_AT[b]] is not None else 0
            for a, b in (("sample_description_index", "default_sample_description_index"), *((f"default_sample_{c}",) * 2 for c in ("size", "duration", "flags")))
        )
        for i, flags in t["runs"]:
            payload = payload_of(i)
            if payload is None:
                raise ValueError(f"a table without its payload: {file}")
            payload = memoryview(payload)
            n, start, first_flags, bits, entries = _run_head(flags, payload)
            place = (t["moof"] if data_base is None else data_base) + (start or 0)
            if place == t["moof"]:
                place = None if begun else t["moof"] if t["data"] is None else t["data"]
            width = _LAYOUTS[bits].itemsize
            for k in range(0, n, _ROWS):
                m = min(_ROWS, n - k)
                yield track, t["moof"], description, place, base, m, bits, payload[entries + k * width : entries + (k + m) * width], first_flags, *defaults
                begun, place, base, first_flags = True, None, None, None


def _resolved(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The samples of runs, each after its file's name as a list of one, which tells files apart by identity."""
    made, held, last, place, clocks = [], 0, None, 0, {}

    def batch() -> pa.RecordBatch:
        nonlocal last, place, clocks
        n = np.array([m[6] for m in made])
        starts, run = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        size, duration, flags = (np.array([m[k] for m in made], np.int64)[run] for k in (10, 11, 12))
        columns = {"size": size, "duration": duration, "flags": flags, "cts": np.zeros(len(run), np.int64)}
        bits = np.array([m[7] for m in made])
        for b in np.unique(bits[bits > 0]).tolist():
            own = np.flatnonzero(bits == b)
            entries = np.frombuffer(b"".join([made[i][8] for i in own.tolist()]), _LAYOUTS[b])
            spots = np.repeat(starts[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(len(entries))
            for name in entries.dtype.names:
                columns[name][spots] = entries[name]
        for i, m in enumerate(made):
            if m[9] is not None:
                flags[starts[i]] = m[9]
        begin = []
        for m, length, lasts in zip(made, np.add.reduceat(size, starts).tolist(), np.add.reduceat(duration, starts).tolist()):
            if m[0] is not last:
                last, clocks = m[0], {}
            index, time = clocks.get(m[1], (0, 0))
            place, time = place if m[4] is None else m[4], time if m[5] is None else m[5]
            begin.append((index, place, time))
            clocks[m[1]], place = (index + m[6], time + lasts), place + length
        index, offset, dts = np.array(begin, np.int64).T
        reach, ends = np.cumsum(size) - size, np.cumsum(duration) - duration
        constant = [pa.array([m[k][0] if not k else m[k] for m in made], pa.string() if not k else pa.int64()).take(pa.array(run)) for k in range(4)]
        varying = [(index - starts)[run] + np.arange(len(run)), (offset - reach[starts])[run] + reach, size, duration, (dts - ends[starts])[run] + ends, columns["cts"], flags & NOT_SYNC == 0]
        index, offset, size, duration, dts, delta, sync = map(pa.array, varying)
        return pa.RecordBatch.from_arrays([constant[0], constant[1], index, constant[2], offset, size, duration, dts, delta, constant[3], sync], [c.split()[0] for c in _MOVING.split(", ")])

    for m in found:
        made.append(m)
        held += m[6]
        if held >= _ROWS:
            yield batch()
            made, held = [], 0
    if made:
        yield batch()


def moving_samples(atoms: DataFrame) -> DataFrame:
    """Samples of fragments by the rules of ``fragment_samples``, in one pass over a file's boxes in file order."""
    inside = F.col("path").rlike(_IN_TRAF) & F.col("type").isin("tfhd", "tfdt", "trun")
    kept = atoms.filter("offset is not null").filter(inside | (F.col("type") == "trex") | (F.col("depth") == 0) & F.col("type").isin("moof", "mdat"))
    fields = F.array(*[_number(f) for f in _FIELDS])
    rows_ = kept.select("file", "offset", "type", F.regexp_extract("path", _TRAF_OF, 1).alias("traf"), "header_size", "flags", F.when(F.col("type") == "trun", F.col("payload")).alias("payload"), F.when(F.col("type").isin(*_DEFAULTS), fields).alias("fields"))

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        payloads, rows = table.column("payload"), [table.column(c).to_pylist() for c in ("offset", "type", "traf", "header_size", "flags", "fields")]
        files = table.column("file").take(pa.array(bounds[:-1])).to_pylist()

        def found() -> Iterator[tuple]:
            for file, a, b in zip(files, bounds[:-1].tolist(), bounds[1:].tolist()):
                group = [file]
                for r in _runs(file, zip(range(a, b), *(c[a:b] for c in rows)), lambda i: payloads[i].as_buffer()):
                    yield group, *r

        yield from _resolved(found())

    return by_group(rows_, ["file"], ["offset"], work, _MOVING)


def file_samples(files: DataFrame) -> DataFrame:
    """``moving_samples`` of the boxes of ``files`` (path, content): a file's runs are resolved where it is walked, so that
    no rows of boxes are made, dealt by file and sorted."""
    kinds = frozenset(["trex", "tfhd", "tfdt", "trun", "moof", "mdat"])
    in_traf, traf_of = re.compile(_IN_TRAF), re.compile(_TRAF_OF)

    def rows(data: bytes | memoryview | Pieces) -> tuple[list[tuple], list[bytes | None]]:
        out, payloads = [], []
        for b in walk(data, payloads=False, kinds=kinds):
            if b.type in ("moof", "mdat"):
                if b.depth:
                    continue
                traf, numbers = "", None
            else:
                if b.type != "trex" and not in_traf.search(b.path):
                    continue
                m = traf_of.search(b.path)
                traf, numbers = m[1] if m else "", None if b.type == "trun" else [None if f not in b.fields else int(b.fields[f]) for f in _FIELDS]
            out.append((len(out), b.offset, b.type, traf, b.header, b.flags, numbers))
            payloads.append(b.payload if b.type == "trun" else None)
        return out, payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for file, data in contents(batches):
                group, (own, payloads) = [file], rows(data)
                for r in _runs(file, own, payloads.__getitem__):
                    yield group, *r

        return _resolved(found())

    return pieces(files).mapInArrow(work, _MOVING)


#: Bytes of samples that leave a task at a time.
_TAKEN = 1 << 26


def sample_data(samples: DataFrame, files: DataFrame) -> DataFrame:
    """``samples`` with ``data``: the bytes at their place in the file.

    A file's samples follow its content, which is read once for each file and not once for each sample; a task holds one
    file's content and a part of its samples.
    """
    columns = samples.columns
    schema = samples.select("*").schema.add("data", "binary")  # of a frame of its own: add() changes a schema in place
    kinds = to_arrow_schema(schema)
    row = samples.select(F.struct(*columns).alias("row")).schema["row"].dataType
    contents = files.select(F.col("path").alias("_file"), F.lit(0).alias("_turn"), "content", F.lit(None).cast(row).alias("_row"))
    wanted = samples.select(F.col("file").alias("_file"), F.lit(1).alias("_turn"), F.lit(None).cast("binary").alias("content"), F.struct(*columns).alias("_row"))
    both = contents.unionByName(wanted).filter("_file is not null").repartition("_file").sortWithinPartitions("_file", "_turn")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, content = None, None
        for b in batches:
            if not b.num_rows:
                continue
            turns, bodies, flat = b.column(1).to_numpy(), b.column(2), dict(zip(columns, b.column(3).flatten()))
            offsets, sizes = (flat[c].fill_null(0).to_numpy() for c in ("offset", "size"))
            absent = pc.or_(flat["offset"].is_null(), flat["size"].is_null()).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], changes([b.column(0)]), [b.num_rows]])
            heads = b.column(0).take(pa.array(bounds[:-1])).to_pylist()
            before = np.concatenate([[0], np.cumsum(turns == 0)])
            rows, parts, held = [], [], 0

            def batch() -> pa.RecordBatch:
                at = pa.array(np.concatenate([k for k, _, _ in rows]))  # noqa: B023
                missing = np.concatenate([m for _, _, m in rows])  # noqa: B023
                ends = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n, _ in rows]))]).astype(np.int32)  # noqa: B023
                valid = None if not missing.any() else pa.py_buffer(np.packbits(~missing, bitorder="little"))
                data = pa.Array.from_buffers(pa.binary(), len(at), [valid, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])  # noqa: B023
                return pa.RecordBatch.from_arrays([*[flat[c].take(at).cast(kinds.field(c).type) for c in columns], data], [*columns, "data"])  # noqa: B023

            for path, a, e in zip(heads, bounds[:-1].tolist(), bounds[1:].tolist()):
                first = a + int(before[e] - before[a])
                if first > a:
                    file, content = path, bodies[first - 1].as_buffer()
                    content = None if content is None else memoryview(content)
                if path != file or first == e:
                    continue
                o, n, missing = offsets[first:e], sizes[first:e], absent[first:e] | (content is None)
                size = 0 if content is None else len(content)
                n = np.where(missing | (o >= size), 0, n)
                if ((n < 0) | (n > 0) & ((o < 0) | (o + n > size))).any():
                    raise IndexError(f"a sample begins before its file or ends beyond it: {path}")
                reach = np.cumsum(n)
                k = 0
                while k < len(n):  # samples that follow each other are taken at once
                    m = max(k + 1, int(np.searchsorted(reach, (reach[k - 1] if k else 0) + _TAKEN - held, "right")))
                    cuts = np.concatenate([[k], k + 1 + np.flatnonzero(o[k + 1 : m] != o[k : m - 1] + n[k : m - 1]), [m]])
                    for s, t in zip(o[cuts[:-1]].tolist(), (o + n)[cuts[1:] - 1].tolist()):
                        if t > s:
                            parts.append(content[s:t])
                    rows.append((np.arange(first + k, first + m), n[k:m], missing[k:m]))
                    held += int(n[k:m].sum())
                    k = m
                    if held >= _TAKEN:
                        yield batch()
                        rows, parts, held = [], [], 0
            if rows:
                yield batch()

    return both.mapInArrow(work, schema)


def _index(version: int, flags: int, payload: bytes) -> list[np.ndarray]:
    """Where the references of a segment index point, from the end of its box on, and how far each reaches."""
    wide = 8 if version else 4
    first = int.from_bytes(payload[12 + wide : 12 + 2 * wide], "big")
    at = 12 + 2 * wide
    count = int.from_bytes(payload[at + 2 : at + 4], "big")
    size = _cells(payload, at + 4, count, [("reference", ">u4"), ("duration", ">u4"), ("sap", ">u4")])[0] & 0x7FFFFFFF
    return [first + np.cumsum(size) - size]


def _access(version: int, flags: int, payload: bytes) -> list[np.ndarray]:
    """Fragment offsets of a random access box."""
    lengths, count = int.from_bytes(payload[8:12], "big"), int.from_bytes(payload[12:16], "big")
    wide = ">u8" if version else ">u4"
    rest = [(f"n{s}", f"V{(lengths >> s & 3) + 1}") for s in (4, 2, 0)]
    kind = np.dtype([("time", wide), ("offset", wide), *rest])
    if 16 + count * kind.itemsize > len(payload):
        raise ValueError("a table has more entries than bytes")
    return [np.frombuffer(payload, kind, count, 16)["offset"].astype(np.int64)] if count else [np.zeros(0, np.int64)]


def index_entries(atoms: DataFrame) -> DataFrame:
    """(file, kind, target): where segment and random access index entries point."""
    tfra = _unpacked(atoms.filter("type = 'tfra'"), ["file"], "target long", _access).select("file", F.lit("tfra").alias("kind"), "target")
    ends = atoms.filter("type = 'sidx'").withColumn("_end", F.col("offset") + F.col("size"))
    sidx = _unpacked(ends, ["file", "_end"], "target long", _index).select("file", F.lit("sidx").alias("kind"), (F.col("_end") + F.col("target")).alias("target"))
    return tfra.unionByName(sidx)


def bad_index_entries(atoms: DataFrame) -> DataFrame:
    """Index entries that do not point at the beginning of a fragment."""
    starts = atoms.filter("depth = 0 and type in ('moof', 'styp', 'sidx', 'emsg', 'prft')").select("file", F.col("offset").alias("target"))
    return index_entries(atoms).join(starts, ["file", "target"], "left_anti")
