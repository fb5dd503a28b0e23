import pytest
from pyspark.sql import functions as F

from strobila.operators import manifests, segments, tags
from strobila.sources import boxes
from strobila.streaming import live
from tests import mp4

SCHEMA = "file string, track_id long, sample_index long, dts long, duration long, size long, is_sync boolean"


def rows():
    return [("f", t, k, 10 * k, 10, 5 + k, k % (3 + t) == 0) for t in (1, 2) for k in range(40)]


def test_stream_cuts_like_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    for part in range(4):
        df.filter(F.col("sample_index").between(10 * part, 10 * part + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.threshold_segments(live.samples_stream(spark, str(tmp_path / "in"), SCHEMA).repartition(1), 55)
    q = live.write_segments(stream, str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("file", "track_id", "segment_index", "first_sample", "sample_count", "size").collect()))
    batch = segments.threshold_segments(df, 55).groupBy("file", "track_id", "segment_index").agg(F.min("sample_index").alias("first_sample"), F.count("*").alias("sample_count"), F.sum("size").alias("size"))
    want = sorted(map(tuple, batch.collect()))
    last = {t: max(r[2] for r in want if r[1] == t) for t in (1, 2)}
    assert got == [r for r in want if r[2] < last[r[1]]]


def test_playlist(spark):
    s = spark.createDataFrame([("a", k, 4.0 + k) for k in range(3)], "name string, segment_index long, seconds double")
    text = manifests.document(manifests.media_playlist(s, ["name"], F.format_string("seg-%d.ts", "segment_index")), ["name"], ["position"]).first()["text"]
    assert text.split("\n") == ["#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-PLAYLIST-TYPE:VOD", "#EXT-X-TARGETDURATION:6", "#EXT-X-MEDIA-SEQUENCE:0", "#EXTINF:4.000000,", "seg-0.ts", "#EXTINF:5.000000,", "seg-1.ts", "#EXTINF:6.000000,", "seg-2.ts", "#EXT-X-ENDLIST", ""]


def test_manifests_are_xml(spark):
    from xml.etree import ElementTree

    tracks = spark.createDataFrame([("p", "video", "video/mp4", "v1", "avc1.64001F", 1000, 12.5, 1000), ("p", "audio", "audio/mp4", 'a"1', "mp4a.40.2", 100, 12.4, 1000)], "presentation string, set_name string, mime string, track string, codecs string, bandwidth long, seconds double, timescale long")
    times = spark.createDataFrame([("p", "v1", 0, 4000, 2), ("p", "v1", 1, 500, None), ("p", 'a"1', 0, 12400, None)], "presentation string, track string, entry_index long, d long, r long")
    tree = ElementTree.fromstring(manifests.dash_manifest(tracks, times).first()["text"])
    assert tree.attrib["mediaPresentationDuration"] == "PT12.500S"
    assert [r.attrib["id"] for r in tree.iter("{urn:mpeg:dash:schema:mpd:2011}Representation")] == ['a"1', "v1"]
    assert [s.attrib for s in tree.iter("{urn:mpeg:dash:schema:mpd:2011}S")][1:] == [{"d": "4000", "r": "2"}, {"d": "500"}]


def test_tags(spark):
    ilst = mp4.box("ilst", tags.item_bytes("\xa9nam", [(1, b"A name")]), tags.item_bytes("trkn", [(0, bytes(8)), (21, b"\xff\xfe")]), tags.item_bytes("own", [(1, b"x")], namespace="org.example"))
    data = mp4.box("moov", mp4.box("udta", mp4.full("meta", 0, 0, mp4.full("hdlr", 0, 0, bytes(4), b"mdir", bytes(12), b"\0"), ilst)))
    found = tags.read_tags(boxes.atoms(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")))
    got = sorted((r["namespace"], r["key"], r["type_code"], r["value_string"], r["value_long"]) for r in found.collect())
    assert got == [("meta", "trkn", 0, None, None), ("meta", "trkn", 21, None, -2), ("meta", "\xa9nam", 1, "A name", None), ("org.example", "own", 1, "x", None)]
    assert tags.remove_tags(found, found.filter("key = 'trkn'")).count() == 2
    assert tags.add_tags(found, found.filter("key = 'own'").withColumn("value_string", F.lit("y"))).filter("value_string = 'y'").count() == 1


@pytest.mark.parametrize("duration, slack", [(55, 0), (50, 10)])
def test_threshold(spark, duration, slack):
    out = segments.threshold_segments(spark.createDataFrame(rows(), SCHEMA), duration, slack)
    for t in (1, 2):
        want, last, index = [], 0, 0
        for _, _, k, dts, _, _, sync in [r for r in rows() if r[1] == t]:
            if sync and dts - last >= duration - slack:
                last, index = dts, index + 1
            want.append(index)
        assert [r["segment_index"] for r in out.filter(F.col("track_id") == t).orderBy("sample_index").collect()] == want


def slow_bandwidth(size, seconds, buffer):
    rate = 0.0
    for start in range(len(size)):
        room = buffer * rate / 8
        for end in range(start + 1, len(size) + 1):
            need, time = sum(size[start:end]), sum(seconds[start:end])
            if time and need > room + time * rate / 8:
                rate = 8 * (need - room) / time
                break
    return int(rate)


def test_bandwidth(spark):
    import random

    rng = random.Random(1)
    tracks = [([1000, 500, 2000, 1500], [1.0, 0.0, 2.0, 1.0]), ([5], [0.0]), ([0, 0], [1.0, 1.0])]
    tracks += [([rng.randrange(0, 5000) for _ in range(n)], [float(rng.randrange(0, 4)) for _ in range(n)]) for n in (1, 2, 10, 40, 40)]
    rows = [("f", t, k, b, s) for t, (size, seconds) in enumerate(tracks) for k, (b, s) in enumerate(zip(size, seconds))]
    df = spark.createDataFrame(rows, "file string, track_id long, segment_index long, size long, seconds double")
    for buffer in (0.0, 1.0, 20.0):
        got = {r["track_id"]: r["bandwidth"] for r in segments.bandwidth(df, buffer).collect()}
        assert got == {t: slow_bandwidth(*x, buffer) for t, x in enumerate(tracks)}


def test_similar_rates_and_names(spark):
    r = spark.createDataFrame([("g", k, b) for k, b in enumerate([100.0, 105.0, 110.0, 125.0, 300.0])], "grp string, ordinal int, bandwidth double")
    assert sorted(x["bandwidth"] for x in segments.drop_similar_rates(r, ["grp"]).collect()) == [100.0, 110.0, 125.0, 300.0]  # a tenth exactly is another rate
    names = [("p", "en"), ("p", "en-1"), ("p", "en"), ("p", "en"), ("p", "fr"), ("q", "en"), ("q", "en"), ("q", "en"), ("q", None)]
    df = spark.createDataFrame([(g, n, k) for k, (g, n) in enumerate(names)], "grp string, name string, k int")
    got = [x["unique_name"] for x in segments.unique_names(df, ["grp"], "name", ["k"]).orderBy("k").collect()]
    assert got == ["en", "en-1", "en-2", "en-3", "fr", "en", "en-1", "en-2", None]


def test_idle_tracks_end(spark, tmp_path):
    """Without a later sync sample the last segment is emitted once its track falls silent."""
    import time

    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = live.samples_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = live.threshold_segments(stream, 30, idle_ms=1500).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            found = spark.sql("select track_id, sum(sample_count) n from idle group by track_id").collect()
            if {r["track_id"]: r["n"] for r in found} == {t: sum(r[1] == t for r in rows()) for t in (1, 2)}:
                break
            time.sleep(1)
        else:
            raise AssertionError(found)
    finally:
        q.stop()
