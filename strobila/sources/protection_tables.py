"""Per-sample protection tables, protection system boxes and sample groups as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strobila.sources.media import _cells, _trak, _unpacked, table, track_ids

_INFO = "file string, moof_offset long, traf_index int, place long, iv binary, parts array<struct<clear:int,encrypted:long>>"


def sample_info(payload: bytes, iv_size: int) -> list[tuple[bytes, list[dict] | None]]:
    """(iv, parts) of every sample of a sample encryption box's payload; parts are null without sub-samples."""
    flags, count, at, out = int.from_bytes(payload[1:4], "big"), int.from_bytes(payload[4:8], "big"), 8, []
    if flags & 1:  # the box brings its own algorithm, vector size and key id
        iv_size, count, at = payload[7], int.from_bytes(payload[24:28], "big"), 28
    for _ in range(count):
        if at + iv_size > len(payload):
            raise ValueError("sample information ends early")
        iv, at = payload[at : at + iv_size], at + iv_size
        parts = None
        if flags & 2:
            n, at = int.from_bytes(payload[at : at + 2], "big"), at + 2
            if at + 6 * n > len(payload):
                raise ValueError("sample information ends early")
            parts = [{"clear": int.from_bytes(payload[at + 6 * k : at + 6 * k + 2], "big"), "encrypted": int.from_bytes(payload[at + 6 * k + 2 : at + 6 * k + 6], "big")} for k in range(n)]
            at += 6 * n
        out.append((iv, parts))
    return out


def write_sample_info(rows: list[tuple[bytes, list[tuple[int, int]] | None]]) -> bytes:
    """A sample encryption box; sub-samples if any row has some."""
    from strobila.sources.writers import full_box

    some = any(p is not None for _, p in rows)
    body = [len(rows).to_bytes(4, "big")]
    for iv, parts in rows:
        body.append(iv)
        if some:
            body.append(len(parts or []).to_bytes(2, "big") + b"".join(c.to_bytes(2, "big") + s.to_bytes(4, "big") for c, s in parts or []))
    return full_box("senc", 0, 2 if some else 0, *body)


def track_defaults(atoms: DataFrame) -> DataFrame:
    """(file, track_id, scheme, kid, iv_size, constant_iv, crypt, skip): the protection of every protected track."""
    rows = _trak(atoms).join(track_ids(atoms), ["file", "_trak"])
    tenc = rows.filter("type = 'tenc'").select("file", "track_id", F.col("fields")["default_KID"].alias("kid"), F.col("fields")["default_Per_Sample_IV_Size"].cast("int").alias("iv_size"), F.col("fields")["constant_iv"].alias("constant_iv"), F.col("fields")["pattern"].cast("int").alias("_p"))
    schm = rows.filter("type = 'schm'").select("file", "track_id", F.col("fields")["scheme_type"].alias("scheme"))
    return tenc.join(schm, ["file", "track_id"], "left").select("file", "track_id", "scheme", "kid", "iv_size", "constant_iv", F.shiftright("_p", 4).alias("crypt"), F.col("_p").bitwiseAND(F.lit(15)).alias("skip"))


def fragment_sample_info(atoms: DataFrame, defaults: DataFrame) -> DataFrame:
    """(file, moof_offset, traf_index, place, iv, parts): sample information of fragments, for a positional join with
    their samples. ``defaults``: (file, track_id, iv_size)."""
    inside = atoms.filter(F.col("path").rlike(r"^moof\[\d+\]")).withColumns({"_moof": F.regexp_extract("path", r"^(moof\[\d+\])", 1), "traf_index": F.regexp_extract("path", r"/traf\[(\d+)\]", 1)})
    moofs = inside.filter("path = _moof").select("file", "_moof", F.col("offset").alias("moof_offset"))
    own = inside.filter("traf_index <> ''").join(moofs, ["file", "_moof"]).withColumn("traf_index", F.col("traf_index").cast("int"))
    key = ["file", "moof_offset", "traf_index"]
    head = own.filter("type = 'tfhd'").select(*key, F.col("fields")["track_id"].cast("long").alias("track_id"))
    boxes = own.filter("type = 'senc'").select(*key, "payload").join(head, key).join(defaults.select("file", "track_id", "iv_size"), ["file", "track_id"])

    def work(batches):
        for pdf in batches:
            rows = [(f, m, t, k, iv, parts) for f, m, t, p, n in zip(pdf["file"], pdf["moof_offset"], pdf["traf_index"], pdf["payload"], pdf["iv_size"]) for k, (iv, parts) in enumerate(sample_info(bytes(p), int(n)))]
            yield pd.DataFrame(rows, columns=["file", "moof_offset", "traf_index", "place", "iv", "parts"])

    return boxes.select(*key, "payload", "iv_size").mapInPandas(work, _INFO)


def with_sample_info(samples: DataFrame, info: DataFrame) -> DataFrame:
    """``samples`` of fragments with their iv and parts, by place in the fragment; null where there is no information."""
    w = Window.partitionBy("file", "moof_offset", "track_id").orderBy("sample_index")
    placed = samples.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return placed.join(info.drop("traf_index"), ["file", "moof_offset", "place"], "left").drop("place")


def info_sizes(atoms: DataFrame) -> DataFrame:
    """(file, path, total): bytes of auxiliary information that a size table stands for."""
    rows = atoms.filter("type = 'saiz'")
    fixed, count = F.col("fields")["default_sample_info_size"].cast("long"), F.col("fields")["sample_count"].cast("long")
    listed = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int")), lambda k: F.conv(F.substring(F.col("fields")["sizes"], k * 2 + 1, F.lit(2)), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.select("file", "path", F.when(count == 0, 0).when(fixed > 0, fixed * count).otherwise(listed).cast("long").alias("total"))


def systems(atoms: DataFrame) -> DataFrame:
    """(file, atom_id, system_id, kids, data): protection system boxes."""
    n = F.coalesce(F.col("fields")["kid_count"].cast("int"), F.lit(0))
    kids = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.col("fields")[F.concat(F.lit("kid["), k.cast("string"), F.lit("]"))])).otherwise(F.array().cast("array<string>"))
    return atoms.filter("type = 'pssh'").select("file", "atom_id", F.col("fields")["system_id"].alias("system_id"), kids.alias("kids"), F.col("fields")["data"].alias("data"))


def drop_system(atoms: DataFrame, system_id: str) -> DataFrame:
    """The tree without the protection system boxes of one system."""
    gone = (F.col("type") == "pssh") & (F.col("fields")["system_id"] == system_id.lower())
    rest = atoms.filter(~F.coalesce(gone, F.lit(False)))
    w = Window.partitionBy("file", "parent_id").orderBy("ordinal", "offset")
    return rest.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))


def sample_groups(atoms: DataFrame) -> DataFrame:
    """(file, track_id, sample_index, group_description_index): the group of every sample that a group table names.

    An extension: runs of samples to groups, by expanding the runs.
    """
    from strobila.operators.runs import decode_runs

    def unpack(version: int, flags: int, payload: bytes) -> list:
        at = 12 if version else 8
        return _cells(payload, at + 4, int.from_bytes(payload[at : at + 4], "big"), [("sample_count", ">u4"), ("value", ">u4")])

    boxes = _trak(atoms).filter("type = 'sbgp'").join(track_ids(atoms), ["file", "_trak"])
    runs = _unpacked(boxes, ["file", "track_id"], "sample_count long, value long", unpack)
    return decode_runs(runs).withColumnRenamed("value", "group_description_index")


def edit_list(atoms: DataFrame) -> DataFrame:
    """(file, track_id, entry_index, segment_duration, media_time): edits of 32-bit edit lists."""
    return table(atoms.filter("version = 0 or type <> 'elst'"), "elst", ["segment_duration", "media_time", "media_rate"], signed=("media_time",)).drop("media_rate")
