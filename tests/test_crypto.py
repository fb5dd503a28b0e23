import os

import pytest

from strobila.functions import codecs, crypto
from strobila.operators import protection

KEY = bytes(range(16))


def test_known_answers():
    assert crypto.ecb(KEY, bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.cbc(KEY, bytes.fromhex("00112233445566778899aabbccddeeff"), bytes.fromhex("00112233445566778899aabbccddee"), pad=True).hex() == "62cc02dafc6482edf9f2adca6abbb3d2"
    assert crypto.wrap_key(KEY, bytes.fromhex("00112233445566778899AABBCCDDEEFF")).hex().upper() == "1FA68B0A8112B447AEF34BD8FB5A7B829D3E862371D2CFE5"
    # NIST SP 800-38A, F.5.1
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    assert crypto.ctr(key, iv, bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")).hex() == "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 100, 1000])
def test_round_trips(size):
    data, iv = os.urandom(size), os.urandom(16)
    assert crypto.ctr(KEY, iv, crypto.ctr(KEY, iv, data)) == data
    assert crypto.cbc(KEY, iv, crypto.cbc(KEY, iv, data, pad=True), decrypt=True, pad=True) == data
    if size > 20:
        assert crypto.ctr(KEY, iv, data)[19:] == crypto.ctr(KEY, iv, data[19:], offset=19)
    for mode in ("ctr", "cbc"):
        assert crypto.pattern(KEY, iv, crypto.pattern(KEY, iv, data, 1, 9, mode), 1, 9, mode, decrypt=True) == data


def test_counter_wraps():
    data, iv = bytes(64), b"\xff" * 16
    assert crypto.ctr(KEY, iv, data) == b"".join(crypto.ecb(KEY, ((2**128 - 1 + k) % 2**128).to_bytes(16, "big")) for k in range(4))


def test_wrap_round_trip():
    key, kek = os.urandom(32), os.urandom(16)
    wrapped = crypto.wrap_key(kek, key)
    assert crypto.wrap_key(kek, wrapped, unwrap=True) == key
    with pytest.raises(ValueError):
        crypto.wrap_key(kek, wrapped[:-1] + bytes([wrapped[-1] ^ 1]), unwrap=True)


def unit(kind, size):
    return size.to_bytes(4, "big") + bytes([kind]) + os.urandom(size - 1)


def test_maps():
    sample = unit(6, 20) + unit(1, 107) + unit(5, 108) + unit(5, 1000) + unit(7, 300)
    parts = protection.map_units(sample, 4)
    assert sum(c + s for c, s in parts) == len(sample) and all(s % 16 == 0 for _, s in parts)
    assert parts[0] == (24 + 111 + 96, 16)  # 108 + 4 bytes are the first to be encrypted
    assert protection.merge_map([70000], [32]) == [(65535, 0), (4465, 32)]


@pytest.mark.parametrize("scheme", list(protection.SCHEMES))
def test_schemes(spark, scheme):
    rows = []
    for k in range(5):
        data = unit(5, 200 + 37 * k) + unit(6, 30)
        rows.append(("f", 1, k, data, protection.map_units(data, 4)))
    df = spark.createDataFrame(rows, "file string, track_id long, sample_index long, data binary, parts array<struct<clear:int, encrypted:long>>")
    df = df.selectExpr("*", "aggregate(parts, 0L, (a, x) -> a + x.encrypted) encrypted")
    df = protection.sample_vectors(df, bytes(15) + b"\1")
    secret = protection.cipher_samples(df, scheme, KEY)
    back = {r["sample_index"]: bytes(r["data"]) for r in protection.cipher_samples(secret, scheme, KEY, decrypt=True).collect()}
    assert back == {k: d for _, _, k, d, _ in rows}
    assert all(bytes(r["data"]) != rows[r["sample_index"]][3] for r in secret.collect())
    ivs = [int.from_bytes(bytes(r["iv"]), "big") for r in df.orderBy("sample_index").collect()]
    blocks = [-(-sum(s for _, s in p) // 16) for *_, p in rows]
    assert ivs == [1 + sum(blocks[:k]) for k in range(5)]


def test_chained_samples(spark):
    rows = [("f", 1, k, os.urandom(16 * k + 5)) for k in range(6)]
    df = spark.createDataFrame(rows, "file string, track_id long, sample_index long, data binary")
    secret = protection.chain_samples(df, KEY, bytes(16))
    back = protection.chain_samples(secret, KEY, bytes(16), decrypt=True)
    assert sorted((r["sample_index"], bytes(r["data"])) for r in back.collect()) == [(k, d) for _, _, k, d in rows]


def test_headers():
    assert crypto.protection_header(bytes(16), b"ab").hex() == "0000002270737368" + "00000000" + "00" * 16 + "00000002" + "6162"
    assert crypto.tagged_fields([(1, 300), (2, b"xy")]) == b"\x08\xac\x02\x12\x02xy"
    assert len(crypto.derive_content_key(os.urandom(30), os.urandom(16))) == 16


def test_elementary_streams(spark):
    from strobila.sources.writers import adts_header, to_annex_b

    frames = b"".join(adts_header(2, 4, 2, n) + bytes(n) for n in (10, 20, 30))
    got = list(codecs.adts_frames(b"junk" + frames))
    assert [(f["offset"], f["size"], f["sample_rate"], f["channels"]) for f in got] == [(4, 17, 44100, 2), (21, 27, 44100, 2), (48, 37, 44100, 2)]
    assert codecs.split_units(to_annex_b(unit(5, 30)[:4] + b"\x65" * 30, 4)) == [b"\x65" * 30]
    for x in (b"", b"\0\0\1", b"\0\0\0\0\3\0\0\2", os.urandom(500) + bytes(50)):
        assert codecs.unescape(codecs.escape(x)) == x and b"\0\0\1" not in codecs.escape(x)
    bits = codecs.Bits(bytes([0b10100110, 0b01000010, 0b10000000]))
    assert [bits.unsigned() for _ in range(5)] == [0, 1, 2, 3, 4]
    assert codecs.audio_config(bytes([0x12, 0x10])) == {"object_type": 2, "sample_rate": 44100, "channels": 2, "sbr": False, "ps": False}
    df = spark.createDataFrame([("a", bytearray(frames))], "path string, content binary")
    assert codecs.audio_frames(df).count() == 3


def test_many_chains_at_once():
    """Streams side by side are those one by one, whatever their lengths, in a time that long single chains would not have."""
    import time

    sizes = [16 * k for k in (0, 1, 2, 63, 64, 65, 200)] * 4 + [16 * 3000]
    streams, ivs = [os.urandom(n) for n in sizes], [os.urandom(16) for _ in sizes]
    made = crypto.cbc_many(KEY, ivs, streams)
    assert made == [crypto.cbc(KEY, iv, d) for iv, d in zip(ivs, streams)]
    assert crypto.cbc_many(KEY, ivs, made, decrypt=True) == streams
    assert crypto.ctr_many(KEY, [b"\xff" * 16, *ivs[1:]], streams) == [crypto.ctr(KEY, iv, d) for iv, d in zip([b"\xff" * 16, *ivs[1:]], streams)]
    many, began = [bytes(1600)] * 600, time.thread_time()
    crypto.cbc_many(KEY, [bytes(16)] * 600, many)
    together, began = time.thread_time() - began, time.thread_time()
    for d in many[:60]:
        crypto.cbc(KEY, bytes(16), d)
    assert together < 5 * (time.thread_time() - began)  # all of them in less than the time of half of them


@pytest.mark.parametrize("scheme", list(protection.SCHEMES))
def test_samples_leave_a_part_at_a_time(spark, scheme, monkeypatch):
    """A batch of samples above what is held leaves in parts, null stays null, and a scheme runs once for each step."""
    monkeypatch.setattr(protection, "_HELD", 5000)
    rows = [(k, bytearray(os.urandom(37 * k)) if k != 3 else None, bytearray(16), None) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, data binary, iv binary, parts array<struct<clear:int, encrypted:long>>")
    secret = protection.cipher_samples(df, scheme, KEY).selectExpr("*", "length(data) n")
    back = protection.cipher_samples(secret, scheme, KEY, decrypt=True)
    assert back._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = {r["k"]: (r["data"], r["n"]) for r in back.collect()}
    assert got == {k: (d, None if d is None else len(d)) for k, d, *_ in rows}
