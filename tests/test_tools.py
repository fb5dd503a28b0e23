import os

from pyspark.sql import functions as F

from strobila.functions import codecs
from strobila.operators import tools
from strobila.sources import boxes, media, packages, transport
from tests import mp4


def test_transport_stream(spark):
    rows = [("f", 0, "video", 3000 * k, 3000 * k + (3000 if k % 2 else 0), k == 0, os.urandom(400 + k)) for k in range(4)] + [("f", 0, "audio", 2000 * k, 2000 * k, True, os.urandom(100 + 83 * k)) for k in range(5)]
    df = spark.createDataFrame(rows, "file string, segment_index long, kind string, dts long, pts long, is_sync boolean, data binary")
    content = bytes(transport.write_segments(df, {"video": "avc1", "audio": "mp4a"}).first()["content"])
    got = transport.packets(content)
    assert [p["pid"] for p in got[:2]] == [0, transport.PMT_PID]
    for table in got[:2]:
        section = table["payload"][1:]
        size = 3 + ((section[1] & 15) << 8 | section[2])
        assert transport.crc32_mpeg(section[:size]) == 0
    for kind, pid in transport.PIDS.items():
        own = [p for p in got if p["pid"] == pid]
        assert [p["counter"] for p in own] == [k % 16 for k in range(len(own))]
        elements, current = [], b""
        for p in own:
            if p["start"] and current:
                elements.append(current)
                current = b""
            current += p["payload"]
        elements.append(current)
        assert [e[9 + e[8] :] for e in elements] == [r[6] for r in rows if r[2] == kind]


def test_manifests_and_templates(spark):
    text = """<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT10S"><Period><AdaptationSet>
    <SegmentTemplate timescale="10" initialization="$RepresentationID$/i.mp4" media="$RepresentationID$/$Number%03d$-$Time$.m4s"><SegmentTimeline><S t="5" d="40" r="1"/><S d="20"/></SegmentTimeline></SegmentTemplate>
    <Representation id="v" bandwidth="9"/></AdaptationSet><AdaptationSet><Representation id="a" bandwidth="1"><SegmentTemplate timescale="1" duration="4" startNumber="0" media="$$a$Number$"/></Representation>
    <Representation id="l" bandwidth="2"><SegmentList><Initialization sourceURL="x"/><SegmentURL media="y"/></SegmentList></Representation></AdaptationSet></Period></MPD>"""
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = [(r["representation"], r["number"], r["url"]) for r in packages.read_manifests(df).collect()]
    assert got == [("v", -1, "v/i.mp4"), ("v", 1, "v/001-5.m4s"), ("v", 2, "v/002-45.m4s"), ("v", 3, "v/003-85.m4s"), ("a", 0, "$a0"), ("a", 1, "$a1"), ("a", 2, "$a2"), ("l", -1, "x"), ("l", 1, "y")]


def test_specs_and_subtitles(spark):
    assert packages.parse_spec("[+language=fr,type=audio,x]a[1].mp4") == ({"language": "fr", "type": "audio", "x": None}, "a[1].mp4")
    assert packages.parse_spec("plain.mp4") == ({}, "plain.mp4")
    vtt = "WEBVTT\n\n1\n00:01.500 --> 00:02.000 line:0\nHello\nthere\n\nNOTE no cue\n\n01:00:00.000 --> 01:00:01.000\nEnd"
    ttml = '<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="00:00:01.000" end="00:00:02.5">A<br/>B</p><p begin="3s" dur="500ms">C</p></div></body></tt>'
    df = spark.createDataFrame([("v", vtt), ("t", ttml), ("n", "nothing")], "path string, text string")
    got = [tuple(r)[2:] for r in packages.read_subtitles(df).orderBy(F.desc("path"), "cue_index").collect()]
    assert got == [("webvtt", 1500, 2000, "Hello\nthere"), ("webvtt", 3600000, 3601000, "End"), ("ttml", 1000, 2500, "AB"), ("ttml", 3000, 3500, "C")]


def test_mux_clip_and_export(spark):
    files = spark.createDataFrame([("a", bytearray(mp4.static_av()))], "path string, content binary")
    samples = media.sample_data(media.static_samples(boxes.atoms(files)), files).cache()
    about = spark.createDataFrame([("a", 1, "vide", bytearray(mp4.AVC_ENTRY)), ("a", 2, "soun", bytearray(mp4.AAC_ENTRY))], "file string, track_id long, handler string, entry binary")
    scales = spark.createDataFrame([("a", 1, 30000), ("a", 2, 22050)], "file string, track_id long, timescale long")
    again = tools.mux(samples.drop("chunk_index"), about, scales).withColumnRenamed("file", "path")
    atoms = boxes.atoms(again)
    got = media.sample_data(media.static_samples(atoms), again)
    cols = ["track_id", "sample_index", "dts", "duration", "cts_delta", "size", "is_sync", "data"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, samples.select(*cols).collect()))
    assert {r["track_id"]: r["timescale"] for r in media.tracks(atoms).collect()} == {1: 30000, 2: 22050}
    part = tools.clip(samples.filter("track_id = 2"), 1500, 3000).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["dts"]) for r in part] == [(0, 0), (1, 1024), (2, 2048), (3, 3072)]
    stream = b"".join(bytes(r["data"]) for r in tools.export_aac(samples.filter("track_id = 2"), 2, 7, 2).orderBy("sample_index").collect())
    assert [f["size"] - 7 for f in codecs.adts_frames(stream)] == [50 + k % 7 for k in range(78)]
    unit = spark.createDataFrame([("a", 1, 0, True, bytearray(b"\0\0\0\2\x65\1\0\0\0\1\x06"))], "file string, track_id long, sample_index long, is_sync boolean, data binary")
    assert bytes(tools.export_units(unit, 4, [b"\x67"]).first()["data"]) == b"\0\0\0\1\x67\0\0\0\1\x65\1\0\0\0\1\x06"
    assert [(r["unit_type"], r["size"]) for r in tools.list_units(unit, 4).collect()] == [(5, 2), (6, 1)]


def test_playlist_sample_encryption(spark):
    import os

    from strobila.operators import protection

    key, iv = os.urandom(16), os.urandom(16)
    for n in (0, 10, 16, 31, 32, 100):
        frame = os.urandom(n)
        secret = protection.sample_aes(frame, "audio", key, iv)
        assert len(secret) == n and secret[:16] == frame[:16] and protection.sample_aes(secret, "audio", key, iv, decrypt=True) == frame
    for n in (20, 48, 49, 64, 65, 200, 352, 353, 1000):
        unit = bytes([0x65]) + bytes(os.urandom(n - 1)).replace(b"\0", b"\1")
        secret = protection.sample_aes_unit(unit, key, iv)
        assert protection.sample_aes_unit(secret, key, iv, decrypt=True) == unit and secret[:32] == unit[:32]
        assert (secret != unit) == (n > 48) and b"\0\0\1" not in secret
    other = b"\x67" + os.urandom(300)
    assert protection.sample_aes_unit(other, key, iv) == other
    sample = b"".join(len(u).to_bytes(4, "big") + u for u in (unit, other))
    df = spark.createDataFrame([("video", bytearray(sample)), ("audio", bytearray(frame))], "kind string, data binary")
    back = protection.sample_aes_samples(protection.sample_aes_samples(df, key, iv), key, iv, decrypt=True)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted([sample, frame])


def test_each_track_its_scheme(spark):
    from pyspark.sql import functions as F

    from strobila.operators import protection

    rows = [(k, s, bytearray(bytes([k]) * 16) if s else None, bytearray(bytes(range(100))), bytearray(16)) for k, s in enumerate(["cenc", "cbcs", "cens", "cbc1", None])]
    df = spark.createDataFrame(rows, "track_id long, scheme string, key binary, data binary, iv binary").withColumn("parts", F.lit(None).cast("array<struct<clear:int,encrypted:long>>")).withColumns({"crypt": F.lit(1), "skip": F.lit(9)})
    secret = protection.cipher_tracks(df).cache()
    assert len({bytes(r["data"]) for r in secret.collect()}) == 5
    assert {bytes(r["data"]) for r in protection.cipher_tracks(secret, decrypt=True).collect()} == {bytes(range(100))}
    found = spark.range(50).select(protection.random_bytes(16).alias("a"), protection.random_bytes(100).alias("b")).collect()
    assert len({bytes(r["a"]) for r in found}) == 50 and {(len(r["a"]), len(r["b"])) for r in found} == {(16, 100)}


def test_long_runs_and_many_groups(spark):
    from strobila.operators import merge, runs

    df = spark.createDataFrame([("f", 1, 0, 20_000_000, 5), ("f", 1, 1, 0, 6), ("f", 1, 2, 3, 7)], "file string, track_id long, entry_index int, sample_count long, value long")
    row = runs.decode_runs(df).selectExpr("count(*) n", "max(sample_index) last", "sum(value) s").first()
    assert tuple(row) == (20_000_003, 20_000_002, 100_000_021)
    groups = spark.range(50).selectExpr("concat('g', id) `group`")
    tracks = spark.createDataFrame([(1, ["*"]), (2, ["g3", "g7", "nope"]), (3, ["-"]), (4, ["*", "g1"])], "track long, match array<string>")
    found = merge.matches(groups, tracks).groupBy("track").count().collect()
    assert {r["track"]: r["count"] for r in found} == {1: 50, 2: 2, 4: 50}


def test_files_and_fields(spark):
    files = spark.createDataFrame([("a", bytearray(mp4.static_av())), ("b", bytearray(mp4.box("mdat", b"12")))], "path string, content binary")
    atoms = boxes.atoms(files)
    got = {r["file"]: r for r in boxes.files_of(atoms).collect()}
    assert got["a"]["length"] == len(mp4.static_av()) and got["a"]["moov_before_mdat"] is True and got["a"]["brands"] and got["b"]["major_brand"] is None and got["b"]["moov_before_mdat"] is None
    assert [r["id"] for r in boxes.project(atoms, "tkhd", ["id"]).orderBy("id").collect()] == ["1", "2"]


def test_commands(spark, tmp_path, capsys):
    from strobila.__main__ import main
    from strobila.sources import writers

    (tmp_path / "in.mp4").write_bytes(mp4.static_av())
    run = lambda *args: (main(list(args), spark), capsys.readouterr().out)[1]
    path = str(tmp_path / "in.mp4")
    assert "[moov] size=8+" in run("dump", path) and '"name":"moov"' in run("dump", path, "--json")
    shown = run("info", path)
    assert "avc1.64001F" in shown and "vide" in shown
    assert len(run("samples", path).splitlines()) == 1 + 54 + 78
    assert '"id":"2"' in run("find", path, "moov/trak[1]/tkhd").replace('\\', "")
    (tmp_path / "free").write_bytes(mp4.box("free", b"x"))
    run("edit", path, "--remove", "moov/trak[0]", "--insert", f"moov/udta:{tmp_path}/free", "--out", str(tmp_path / "out"))
    again = boxes.atoms(spark.createDataFrame([("o", bytearray((tmp_path / "out" / "in.mp4").read_bytes()))], "path string, content binary"))
    assert boxes.find(again, "moov/udta/free").count() == 1 and boxes.find(again, "moov/trak[1]").count() == 0
    assert len(run("fragment", path, "--seconds", "1", "--out", str(tmp_path / "parts")).splitlines()) >= 4
    frames = b"".join(writers.adts_header(2, 4, 2, n) + bytes(n) for n in (50, 60, 70))
    (tmp_path / "a.aac").write_bytes(frames)
    run("aac2mp4", str(tmp_path / "a.aac"), "--out", str(tmp_path / "audio"))
    found = boxes.atoms(spark.createDataFrame([("o", bytearray((tmp_path / "audio" / "a.mp4").read_bytes()))], "path string, content binary"))
    assert [r["size"] for r in media.static_samples(found).orderBy("sample_index").collect()] == [50, 60, 70]
    assert media.codec_names(found).first()["codec"] == "mp4a.40.2"
