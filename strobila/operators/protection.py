"""Common encryption of samples: sub-sample maps, the four schemes, and per-sample vectors that advance along a track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strobila.functions.codecs import escape, unescape
from strobila.functions.crypto import cbc, cbc_many, ctr, ctr_many

#: Cipher mode, and whether blocks are encrypted by a pattern.
SCHEMES = {"cenc": ("ctr", False), "cbc1": ("cbc", False), "cens": ("ctr", True), "cbcs": ("cbc", True)}
#: Bytes of samples that go through a cipher at a time.
_HELD = 1 << 22
#: NAL units below this many bytes, with their length field, stay clear.
CLEAR_UNIT = 112


def merge_map(clear: list[int], secret: list[int]) -> list[tuple[int, int]]:
    """Pairs of clear and encrypted bytes, with neighbouring clear parts joined and clear parts above 16 bits split."""
    out: list[list[int]] = []
    for c, s in zip(clear, secret):
        if out and out[-1][1] == 0:
            out[-1][0] += c
            out[-1][1] = s
        else:
            out.append([c, s])
    pairs = []
    for c, s in out:
        while c > 0xFFFF:
            pairs.append((0xFFFF, 0))
            c -= 0xFFFF
        pairs.append((c, s))
    return pairs


#: Codings whose NAL unit types are the AVC ones, and those whose types are the HEVC ones.
AVC_CODINGS = frozenset("avc1 avc2 avc3 avc4 dvav dva1".split())
HEVC_CODINGS = frozenset("hev1 hvc1 dvhe dvh1".split())


def is_slice(first: int, coding: str) -> bool:
    """Whether a NAL unit with this first byte holds slice data; of other codings every unit counts as such."""
    if coding in AVC_CODINGS:
        return 1 <= first & 31 <= 5
    return coding not in HEVC_CODINGS or first >> 1 & 63 < 32


def map_units(sample: bytes, length_size: int, whole_blocks: bool = True, coding: str = "avc1") -> list[tuple[int, int]]:
    """The sub-sample map of a sample of length-prefixed NAL units: only slice data above the clear limit is encrypted,
    in whole blocks counted from the end of the unit."""
    clear, secret, at = [], [], 0
    while at + length_size < len(sample):
        n = int.from_bytes(sample[at : at + length_size], "big")
        size = length_size + n
        if at + size > len(sample):
            raise ValueError("a unit ends beyond its sample")
        if size < CLEAR_UNIT or not is_slice(sample[at + length_size], coding):
            body = 0
        else:
            body = (size - 96) // 16 * 16 if whole_blocks else size - 96
        clear.append(size - body)
        secret.append(body)
        at += size
    return merge_map(clear, secret)


def _streams(data: bytes, scheme: str, parts: list[tuple[int, int]] | None, crypt: int, skip: int) -> tuple[list[list[tuple[int, int]]], list[bytes]]:
    """What a sample puts through the cipher: streams that begin with the sample's vector, as stretches (place, bytes) of
    the sample and as bytes."""
    mode, by_pattern = SCHEMES[scheme]
    secret, at = [], 0
    for c, n in parts if parts else [(0, len(data))]:
        at += c
        secret.append((at, min(n, max(0, len(data) - at))))
        at += n
    if by_pattern:
        period = crypt + skip
        every = lambda a, n: [(a, n // 16 * 16)] if not skip or not period else [(a + 16 * k, 16 * min(crypt, n // 16 - k)) for k in range(0, n // 16, period)] if crypt else []
        spots = [every(a, n) for a, n in secret]
        if scheme != "cbcs":  # the vector starts anew in every part of cbcs only
            spots = [[x for s in spots for x in s]]
    elif mode == "ctr":
        spots = [secret]
    else:
        whole, own = sum(n for _, n in secret) // 16 * 16, []
        for a, n in secret:
            own.append((a, min(n, whole)))
            whole -= own[-1][1]
        spots = [own]
    return spots, [b"".join(data[a : a + n] for a, n in s) for s in spots]


def cipher_many(samples: list[bytes | None], scheme: str, key: bytes, ivs: list[bytes], maps: list, crypt: int = 1, skip: int = 9, decrypt: bool = False) -> list[bytes | None]:
    """Samples through a scheme, each by itself, all blocks of them together. Null stays null."""
    spots, streams, vectors = [], [], []
    for data, iv, parts in zip(samples, ivs, maps):
        if data is None:
            spots.append(None)
            continue
        s, own = _streams(data, scheme, parts, crypt, skip)
        spots.append(s)
        streams += own
        vectors += [iv] * len(own)
    done = iter(ctr_many(key, vectors, streams) if SCHEMES[scheme][0] == "ctr" else cbc_many(key, vectors, streams, decrypt))
    result = []
    for data, s in zip(samples, spots):
        if data is None:
            result.append(None)
            continue
        out = bytearray(data)
        for stretches, new in zip(s, done):
            at = 0
            for a, n in stretches:
                out[a : a + n] = new[at : at + n]
                at += n
        result.append(bytes(out))
    return result


def cipher_sample(data: bytes, scheme: str, key: bytes, iv: bytes, parts: list[tuple[int, int]] | None, crypt: int = 1, skip: int = 9, decrypt: bool = False) -> bytes:
    """A sample through its scheme. Without a map the whole of it is one part; a part block stays clear in CBC."""
    return cipher_many([data], scheme, key, [iv], [parts], crypt, skip, decrypt)[0]


def sample_vectors(df: DataFrame, iv: bytes, keys: list[str] = ("file", "track_id")) -> DataFrame:
    """``iv`` of every sample. One of 8 bytes grows by 1 a sample; one of 16 bytes by the blocks that the samples before
    took (``encrypted`` bytes each), a running sum, so that samples need not wait for one another."""
    w = Window.partitionBy(*keys).orderBy("sample_index")
    if len(iv) == 8:
        step = F.row_number().over(w) - 1
    else:
        step = F.coalesce(F.sum(F.ceil(F.col("encrypted") / 16)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start, size = int.from_bytes(iv, "big"), len(iv)

    @F.pandas_udf("binary")
    def advance(step: pd.Series) -> pd.Series:
        return pd.Series([((start + int(k)) % (1 << 8 * size)).to_bytes(size, "big") for k in step])

    return df.withColumn("iv", advance(step.cast("long")))


def cipher_samples(df: DataFrame, scheme: str, key: bytes, decrypt: bool = False, crypt: int = 1, skip: int = 9) -> DataFrame:
    """``data`` of samples (data, iv, parts ARRAY<STRUCT<clear, encrypted>>) through a scheme; each sample by itself. Samples
    go through the cipher and leave the task a few megabytes at a time."""
    schema, names = df.select("*").schema, df.columns
    kinds = to_arrow_schema(schema)
    at = [names.index(c) for c in ("data", "iv", "parts")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at[0])), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < b.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HELD, "right")) - a)
                own = b.slice(a, n)
                data, iv, parts = (own.column(k).to_pylist() for k in at)
                pairs = [None if p is None else [(x["clear"], x["encrypted"]) for x in p] for p in parts]
                new = pa.array(cipher_many(data, scheme, key, iv, pairs, crypt, skip, decrypt), pa.binary())
                yield pa.RecordBatch.from_arrays([new if k == at[0] else own.column(k).cast(kinds.field(k).type) for k in range(len(names))], names)
                a += n

    return df.mapInArrow(work, schema)


def chain_samples(df: DataFrame, key: bytes, iv: bytes, decrypt: bool = False, keys: list[str] = ("file", "track_id")) -> DataFrame:
    """``data`` through CBC whose vector is the last cipher block of the sample before: one task for each track."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, out = pdf.sort_values("sample_index"), iv, []
        for d in pdf["data"]:
            d = bytes(d)
            whole = len(d) // 16 * 16
            new = cbc(key, last, d[:whole], decrypt) + d[whole:]
            source = d if decrypt else new
            last = source[whole - 16 : whole] if whole else last
            out.append(new)
        return pdf.assign(data=out)

    return df.groupBy(*keys).applyInPandas(walk, df.schema)


# Older schemes


def isma_sample(data: bytes, key: bytes, salt: bytes, iv_length: int, key_indicator_length: int = 0, selective: bool = False) -> bytes:
    """A protected sample's clear bytes: an optional flag byte, the offset in the key stream, a key indicator, the data."""
    at = 0
    if selective:
        at = 1
        if not data[0] & 0x80:
            return data[1:]
    offset = int.from_bytes(data[at : at + iv_length], "big")
    return ctr(key, salt, data[at + iv_length + key_indicator_length :], offset)


def protect_isma_sample(data: bytes, key: bytes, salt: bytes, offset: int, iv_length: int, selective: bool = False) -> bytes:
    return (b"\x80" if selective else b"") + offset.to_bytes(iv_length, "big") + ctr(key, salt, data, offset)


def isma_offsets(df: DataFrame, keys: list[str] = ("file", "track_id")) -> DataFrame:
    """``stream_offset``: bytes of all earlier samples of the track, which is where a sample's key stream begins."""
    w = Window.partitionBy(*keys).orderBy("sample_index").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("stream_offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


#: Encryption methods of a protected content object.
CLEAR, CONTENT_CBC, CONTENT_CTR = 0, 1, 2


def content_object(data: bytes, method: int, key: bytes, iv: bytes = b"", decrypt: bool = True) -> bytes:
    """The payload of a content object: the vector first, then the data, padded in CBC."""
    if method == CLEAR:
        return data
    if decrypt:
        iv, body = data[:16], data[16:]
        return cbc(key, iv, body, decrypt=True, pad=True) if method == CONTENT_CBC else ctr(key, iv, body)
    return iv + (cbc(key, iv, data, pad=True) if method == CONTENT_CBC else ctr(key, iv, data))


def content_objects(df: DataFrame, key: bytes, decrypt: bool = True) -> DataFrame:
    """``data`` of whole objects (method, data, iv) through their method."""

    @F.pandas_udf("binary")
    def run(method: pd.Series, data: pd.Series, iv: pd.Series) -> pd.Series:
        return pd.Series([content_object(bytes(d), int(m), key, bytes(i) if i is not None else b"", decrypt) for m, d, i in zip(method, data, iv)])

    return df.withColumn("data", run("method", "data", "iv"))


def segment_aes(df: DataFrame, key: bytes, iv: bytes | None = None) -> DataFrame:
    """``content`` of playlist segments (segment_index, content) as one padded CBC stream each; without ``iv`` the
    segment's number is the vector."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([cbc(key, iv if iv is not None else int(k).to_bytes(16, "big"), bytes(c), pad=True) for c, k in zip(content, index)])

    return df.withColumn("content", run("content", "segment_index"))


#: Fixed values of sample encryption in playlists: clear bytes before the first block of a unit and of an audio frame, the
#: least size of a unit that is encrypted, and the blocks from one that is to the next.
_UNIT_LEAD, _FRAME_LEAD, _UNIT_LEAST, _UNIT_STEP = 32, 16, 48, 10


def sample_aes_unit(unit: bytes, key: bytes, iv: bytes, decrypt: bool = False) -> bytes:
    """An AVC unit through playlist sample encryption: of slices of types 1 and 5 every tenth block after a clear lead,
    a last part of up to a block stays clear; start codes are kept from appearing in what is encrypted."""
    plain = unescape(unit) if decrypt else unit
    if len(plain) <= _UNIT_LEAST or not plain or plain[0] & 31 not in (1, 5):
        return unit
    whole = -(-(len(plain) - _UNIT_LEAD) // 16) - 1  # a last whole block stays clear too
    places = [_UNIT_LEAD + 16 * k for k in range(0, whole, _UNIT_STEP)]
    body = cbc(key, iv, b"".join(plain[a : a + 16] for a in places), decrypt)
    out = bytearray(plain)
    for k, a in enumerate(places):
        out[a : a + 16] = body[16 * k : 16 * k + 16]
    return bytes(out) if decrypt else escape(bytes(out))


def sample_aes(data: bytes, kind: str, key: bytes, iv: bytes, length_size: int = 4, decrypt: bool = False) -> bytes:
    """A sample through playlist sample encryption: units of video, or whole blocks after a clear lead of an audio frame."""
    if kind != "video":
        end = _FRAME_LEAD + max(0, len(data) - _FRAME_LEAD) // 16 * 16
        return data[:_FRAME_LEAD] + cbc(key, iv, data[_FRAME_LEAD:end], decrypt) + data[end:]
    out, at = [], 0
    while at + length_size < len(data):
        n = int.from_bytes(data[at : at + length_size], "big")
        if at + length_size + n > len(data):
            break
        unit = sample_aes_unit(data[at + length_size : at + length_size + n], key, iv, decrypt)
        out.append(len(unit).to_bytes(length_size, "big") + unit)
        at += length_size + n
    return b"".join(out)


def sample_aes_samples(df: DataFrame, key: bytes, iv: bytes, length_size: int = 4, decrypt: bool = False) -> DataFrame:
    """``data`` of samples (kind ``video`` or other, data) through playlist sample encryption."""

    @F.pandas_udf("binary")
    def run(kind: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([sample_aes(bytes(d), k, key, iv, length_size, decrypt) for k, d in zip(kind, data)])

    return df.withColumn("data", run("kind", "data"))


def cipher_tracks(df: DataFrame, decrypt: bool = False) -> DataFrame:
    """``data`` of samples (data, iv, parts, scheme, key, crypt, skip) each through its own track's scheme, key and
    pattern; a sample without scheme or key stays as it is."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, iv: pd.Series, parts: pd.Series, scheme: pd.Series, key: pd.Series, crypt: pd.Series, skip: pd.Series) -> pd.Series:
        out = []
        for d, i, p, s, k, c, n in zip(data, iv, parts, scheme, key, crypt, skip):
            if s not in SCHEMES or k is None:
                out.append(d)
                continue
            pairs = None if p is None else [(int(x["clear"]), int(x["encrypted"])) for x in p]
            out.append(cipher_sample(bytes(d), s, bytes(k), bytes(i), pairs, int(c or 0), int(n or 0), decrypt))
        return pd.Series(out)

    return df.withColumn("data", run("data", "iv", "parts", "scheme", "key", F.coalesce("crypt", F.lit(1)), F.coalesce("skip", F.lit(9))))


def random_bytes(n: int = 16) -> Column:
    """``n`` random bytes for each row, such as a key or a vector: new at every evaluation, so write them before use."""
    parts = [F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))) for _ in range(-(-n // 8))]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 512)), 1, n) if n <= 64 else F.concat(random_bytes(64), random_bytes(n - 64))
