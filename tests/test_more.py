import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strobila.functions import codecs
from strobila.operators import manifests, protection, sets
from strobila.sources import hints, transport

KEY = bytes(range(16))


def constructor(kind, *parts):
    return (bytes([kind]) + b"".join(parts)).ljust(16, b"\0")


def test_hint_packets(spark):
    head = lambda n: (100).to_bytes(4, "big") + bytes([0, 0x80 | 96]) + n.to_bytes(2, "big")
    sample = lambda number, start, size: constructor(2, b"\0", size.to_bytes(2, "big"), number.to_bytes(4, "big"), start.to_bytes(4, "big"))
    data = (2).to_bytes(2, "big") + b"\0\0"
    data += head(7) + b"\0\0" + (2).to_bytes(2, "big") + constructor(1, b"\3abc") + sample(1, 2, 4)
    data += head(8) + b"\0\4" + (1).to_bytes(2, "big") + (8).to_bytes(4, "big") + b"\0\0\0\0" + sample(9, 0, 4)
    h = spark.createDataFrame([("f", 2, 0, 1000, 1, bytearray(data))], "file string, track_id long, sample_index long, rtp_time long, media_track_id long, data binary")
    m = spark.createDataFrame([("f", 1, 0, bytearray(b"0123456789"))], "file string, track_id long, sample_index long, data binary")
    got = hints.numbered(hints.packets(h, m, ssrc=5)).orderBy("position").collect()
    assert bytes(got[0]["content"]).hex() == "80e00007" + (1100).to_bytes(4, "big").hex() + "00000005" + (b"abc" + b"2345").hex()
    assert got[1]["content"] is None


def test_older_schemes(spark):
    for selective in (False, True):
        data = os.urandom(77)
        secret = protection.protect_isma_sample(data, KEY, b"saltsalt", 1003, 4, selective)
        assert protection.isma_sample(secret, KEY, b"saltsalt", 4, selective=selective) == data
    assert protection.isma_sample(b"\0plain", KEY, b"saltsalt", 4, selective=True) == b"plain"
    rows = [(m, bytearray(os.urandom(50)), bytearray(os.urandom(16))) for m in (0, 1, 2)]
    df = spark.createDataFrame(rows, "method int, data binary, iv binary")
    back = protection.content_objects(protection.content_objects(df, KEY, decrypt=False), KEY)
    assert {r["method"]: bytes(r["data"]) for r in back.collect()} == {m: bytes(d) for m, d, _ in rows}
    segs = spark.createDataFrame([(3, bytearray(b"x" * 20))], "segment_index long, content binary")
    from strobila.functions.crypto import cbc

    assert cbc(KEY, (3).to_bytes(16, "big"), bytes(protection.segment_aes(segs, KEY).first()["content"]), decrypt=True, pad=True) == b"x" * 20


def bits(*parts):
    text = "".join(parts) + "1"
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def ue(n):
    return f"{n + 1:b}".rjust(2 * (n + 1).bit_length() - 1, "0")


def test_parameter_sets():
    sps = bytes([0x67]) + bits("01000010", "00000000", "00011110", ue(0), ue(0), ue(0), ue(2), ue(1), "0", ue(39), ue(22), "1", "1", "1", ue(0), ue(0), ue(0), ue(4), "0")
    got = codecs.avc_sequence(codecs.escape(sps))
    assert (got["profile"], got["level"], got["width"], got["height"]) == (66, 30, 640, 360)
    hevc = bytes([0x42, 1]) + bits("0000", "000", "1", "00", "0", "00001", "0" * 32, "0" * 48, f"{93:08b}", ue(0), ue(1), ue(1920), ue(1088), "1", ue(0), ue(0), ue(0), ue(4), ue(0), ue(0), ue(4))
    got = codecs.hevc_sequence(codecs.escape(hevc))
    assert (got["profile"], got["level"], got["width"], got["height"], got["luma_depth"], got["order_bits"]) == (1, 93, 1920, 1080, 8, 8)
    assert codecs.slice_type(bytes([0x65]) + bits(ue(0), ue(7))) == "I" and codecs.slice_type(b"\x06\x05") is None
    assert codecs.frame_rate_ratio(29.97) == (2997, 100) and codecs.codec_name("avc1", {"avcC": {"profile": 100, "profile_compatibility": 0, "level": 31}}) == "avc1.64001F"


def test_counters_go_on_over_segments(spark):
    rows = [("f", k // 3, "video" if k % 3 else "audio", 1000 * k, 1000 * k, k % 3 == 1, bytes(400 + k)) for k in range(12)]
    df = spark.createDataFrame(rows, "file string, segment_index long, kind string, dts long, pts long, is_sync boolean, data binary")
    out = transport.write_segments(df, {"video": "avc1", "audio": "mp4a"}).orderBy("segment_index").collect()
    last = {}
    for p in transport.packets(b"".join(bytes(r["content"]) for r in out)):
        assert p["counter"] == (last.get(p["pid"], -1) + 1) % 16
        last[p["pid"]] = p["counter"]
    assert len(out) == 4 and len(last) == 4
    with pytest.raises(ValueError):
        transport.Muxer({"audio": "mp4a"}).sample("audio", bytes(70000), 0, 0, True)


def test_manifests_lose_no_track(spark):
    audio = spark.createDataFrame([("p", "audio", "en", "en", True, "a.m3u8"), ("p", "audio", "x", None, False, "b.m3u8")], "presentation string, audio_group string, name string, language string, is_default boolean, url string")
    variants = spark.createDataFrame([("p", "v1", 100, None, "avc1", 640, 360, "audio"), ("p", "v2", 200, 150, None, None, None, None)], "presentation string, name string, bandwidth long, average long, codecs string, width int, height int, audio_group string")
    text = manifests.master_playlist(variants, audio).first()["text"]
    assert text.count("#EXT-X-MEDIA:") == 2 and text.count("#EXT-X-STREAM-INF:") == 2
    assert '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="x",AUTOSELECT=YES,DEFAULT=NO,URI="b.m3u8"' in text
    assert "#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=150,BANDWIDTH=200\nv2.m3u8" in text
    tracks = spark.createDataFrame([("p", "v", "video/mp4", "v1", None, 100, 20.0, 1000, "0123"), ("p", "a", "audio/mp4", "a1", "mp4a", 10, 25.0, 1000, None)], "presentation string, set_name string, mime string, track string, codecs string, bandwidth long, seconds double, timescale long, default_kid string")
    lines = spark.createDataFrame([("p", "a1", 0, 25000, None)], "presentation string, track string, entry_index int, d long, r int")
    text = manifests.dash_manifest(tracks, lines).first()["text"]
    assert text.count("<Representation") == 2 and 'mediaPresentationDuration="PT20' in text and text.count("<ContentProtection") == 1 and text.count("<SegmentTimeline>") == 1
    segments = spark.createDataFrame([("f", 0, 4.0)], "file string, segment_index long, seconds double")
    found = [r["line"] for r in manifests.media_playlist(segments, ["file"], F.lit("s.ts"), key_uri="k", iv="00", map_uri="init.mp4").orderBy("position").collect()]
    assert '#EXT-X-MAP:URI="init.mp4"' in found and '#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x00' in found and found[0] == "#EXTM3U" and found[-1] == "#EXT-X-ENDLIST"


def test_sets(spark):
    rows = [("p", 0, "audio", "en", "a", "a", "", 100), ("p", 1, "audio", "en", "a", "a", "", 105), ("p", 2, "audio", "en", "a", "a", "x", 105), ("p", 3, "video", None, "v", "v", "", 1), ("p", 4, "video", None, "w", "v", "", 2), ("p", 5, "subtitles", "en", "s", "s", "", 0), ("p", 6, "subtitles", "en", "s", "s", "", 0), ("p", 7, "hint", "en", "s", "s", "", 0)]
    df = spark.createDataFrame(rows, "presentation string, ordinal int, type string, language string, codec string, codec_family string, label string, bandwidth long")
    got = [(r["ordinal"], "/".join(r["set_key"]), r["order_index"]) for r in sets.adaptation_sets(df, ["presentation"]).orderBy("ordinal").collect()]
    assert got == [(0, "audio/en/a/1", 1), (2, "audio/en/a/2", 1), (3, "video/v", 1), (4, "video/v", 2), (5, "subtitles/en/s", 1)]
    groups = spark.createDataFrame([("p", 0, "en", "a", None), ("p", 1, "fr", "b", None), ("p", 2, "fr", "b", "own"), ("q", 0, "en", "a", None), ("q", 1, "en", "b", None), ("r", 0, "en", "a", None)], "presentation string, ordinal int, language string, codec string, audio_group string")
    assert [r["audio_group"] for r in sets.audio_groups(groups, ["presentation"]).orderBy("presentation", "ordinal").collect()] == ["audio/a", "audio/b", "own", "audio/1", "audio/2", "audio"]
    asked = spark.createDataFrame([("p", 0, False), ("p", 1, None), ("p", 2, None), ("p", 3, True), ("q", 0, True), ("q", 1, None)], "g string, ordinal int, asked_default boolean")
    assert [r["is_default"] for r in sets.with_defaults(asked, ["g"]).orderBy("g", "ordinal").collect()] == [False, True, False, True, True, False]


def test_unit_maps_by_coding():
    unit = lambda first, n: (n + 1).to_bytes(4, "big") + bytes([first]) + bytes(n)
    slice_ = unit(0x02, 300)  # type 1 of HEVC, type 2 of AVC
    other = unit(0x42, 300)  # type 33 of HEVC: a parameter set; type 2 of AVC
    assert sum(s for _, s in protection.map_units(slice_ + other, 4, coding="hvc1")) == sum(s for _, s in protection.map_units(slice_, 4, coding="hvc1")) > 0
    assert sum(s for _, s in protection.map_units(other, 4, coding="avc1")) > 0
    assert sum(s for _, s in protection.map_units(unit(0x06, 300), 4, coding="avc1")) == 0 < sum(s for _, s in protection.map_units(unit(0x06, 300), 4, coding="av01"))


def test_codec_names(spark):
    from strobila.sources import boxes, media
    from tests import mp4

    hevc = {"profile_space": 0, "tier": 0, "profile": 2, "profile_compatibility": "20000000", "constraint": "900000000000", "level": 93}
    name = codecs.codec_name
    assert name("hvc1", {"hvcC": hevc}) == "hvc1.2.4.L93.90" and name("hev1", {"hvcC": hevc | {"profile_space": 1, "tier": 1, "constraint": "000000000000"}}) == "hev1.A2.4.H93.0"
    vision = {"dv_profile": 5, "dv_level": 6}
    assert name("dvh1", {"hvcC": hevc, "dvcC": vision}) == "dvh1.05.06" and name("hvc1", {"hvcC": hevc, "dvvC": vision}) == "hvc1.2.4.L93.90,dvh1.05.06"
    av1 = {"seq_profile": 0, "seq_level_idx_0": 4, "seq_tier_0": 0, "high_bitdepth": 1, "twelve_bit": 0, "monochrome": 0, "chroma_subsampling_x": 1, "chroma_subsampling_y": 1, "chroma_sample_position": 0}
    assert name("av01", {"av1C": av1}) == "av01.0.04M.10.0.110.01.01.01.0"
    assert name("vp09", {"vpcC": {"profile": 2, "level": 10, "depth_and_flags": 0xA2, "colour_primaries": 1, "transfer_characteristics": 1, "matrix_coefficients": 1}}) == "vp09.02.10.10.01.01.01.01.00"
    config = b"\x40\x15" + bytes(11) + b"\x05\x02\x12\x10"
    stream = bytes(3) + b"\x04" + bytes([len(config)]) + config + b"\x06\x01\x02"
    assert name("ec-3", {}) == "ec-3" and name("mp4a", {"esds": {"descriptors": (b"\x03\x80" + bytes([len(stream)]) + stream).hex()}}) == "mp4a.40.2"
    files = spark.createDataFrame([("a", bytearray(mp4.static_av()))], "path string, content binary")
    assert [r["codec"] for r in media.codec_names(boxes.atoms(files)).orderBy("track_id").collect()] == ["avc1.64001F", "mp4a"]


def test_chained_blocks_equal_the_vector_way():
    from strobila.functions import crypto

    key, iv, data = os.urandom(16), os.urandom(16), os.urandom(16 * 50)
    last, want = np.frombuffer(iv, np.uint8)[None], b""
    for block in np.frombuffer(data, np.uint8).reshape(-1, 1, 16):
        last = crypto.encrypt_blocks(crypto.expand_key(key), block ^ last)
        want += last.tobytes()
    assert crypto.cbc(key, iv, data) == want and crypto.cbc(key, iv, want, decrypt=True) == data
