"""Boxes, sample tables and fragments against files built byte by byte."""

import pytest

from strobila.operators import seek
from strobila.sources import boxes, layouts, media, writers
from tests import mp4


def load(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


@pytest.fixture(scope="module")
def static(spark):
    files = load(spark, a=mp4.static_av())
    return files, boxes.atoms(files).cache()


def test_tree_and_paths(static):
    _, atoms = static
    assert [r["type"] for r in atoms.filter("depth = 0").orderBy("offset").collect()] == ["ftyp", "moov", "mdat"]
    entry = boxes.find(atoms, "moov/trak[1]/mdia/minf/stbl/stsd/mp4a").first()
    assert entry["fields"]["channel_count"] == "2" and entry["fields"]["sample_rate"] == "22050.0"
    avc = boxes.find(atoms, "moov/trak/mdia/minf/stbl/stsd/avc1/avcC").first()["fields"]
    assert avc["nalu_length_size"] == "4" and avc["sequence_parameter[0]"] == "6764001f" and avc["picture_parameter[0]"] == "68ce"
    assert boxes.find(atoms, "moov/tra").count() == 0 and boxes.find(atoms, "moov/trak[2]").count() == 0


def test_headers():
    data = mp4.u32(1) + b"wide" + (16 + 3).to_bytes(8, "big") + b"abc" + mp4.u32(7) + b"free"
    found = list(boxes.walk(data))
    assert [(b.type, b.header, b.size) for b in found] == [("wide", 16, 19)]
    assert [(b.type, b.size) for b in boxes.walk(mp4.box("free", b"x") + mp4.u32(0) + b"mdat" + bytes(5))] == [("free", 9), ("mdat", 13)]
    inside = mp4.box("hnti", mp4.box("rtp ", b"sdp textmore"))
    assert [b.fields for b in boxes.walk(inside)][1] == {"description_format": "sdp ", "sdp_text": "textmore"}
    assert list(boxes.walk(b"")) == []


def test_truncated_counts():
    bad = mp4.full("stts", 0, 0, mp4.u32(1000000), mp4.u32(1, 1))
    found = list(boxes.walk(bad))
    assert found[0].error and "entry_count" not in found[0].fields


def test_tracks(static):
    _, atoms = static
    got = {r["track_id"]: r for r in media.tracks(atoms).collect()}
    assert got[1]["handler"] == "vide" and got[1]["timescale"] == 30000 and got[1]["language"] == "und" and got[1]["width_raw"] == 640 << 16
    assert got[2]["media_duration"] == 78 * 1024 and got[2]["movie_timescale"] == 1000


def test_static_samples(static):
    files, atoms = static
    samples = media.static_samples(atoms).cache()
    rows = {(r["track_id"], r["sample_index"]): r for r in samples.collect()}
    assert len(rows) == 54 + 78
    at = rows[1, 0]["offset"]
    for k in range(54):
        r = rows[1, k]
        assert (r["offset"], r["size"], r["dts"], r["is_sync"], r["cts_delta"]) == (at, 100 + k, 1001 * k, k % 12 == 0, 2002 if k < 10 else 1001)
        at += r["size"]
    assert all(rows[2, k]["is_sync"] for k in range(78)) and rows[2, 50]["chunk_index"] == 2
    near = {r["sample_index"]: r for r in seek.nearest_sync(samples.filter("track_id = 1")).collect()}
    assert [(near[k]["sync_before"], near[k]["sync_after"]) for k in (0, 1, 12, 52)] == [(0, 0), (0, 12), (0, 12), (48, 54)]
    data = {(r["track_id"], r["sample_index"]): bytes(r["data"]) for r in media.sample_data(samples, files).collect()}
    assert data[1, 1] == bytes(k % 251 for k in range(100, 201))


def test_tables_written_and_read_again(spark, static):
    _, atoms = static
    samples = media.static_samples(atoms)
    one = samples.filter("track_id = 1").toPandas()
    stbl = writers.sample_tables(one, mp4.AVC_ENTRY)
    tkhd = mp4.full("tkhd", 0, 7, mp4.u32(0, 0, 1, 0, 0), bytes(8), bytes(8), bytes(36), mp4.u32(0, 0))
    again = boxes.atoms(load(spark, b=mp4.box("moov", mp4.box("trak", tkhd, mp4.box("mdia", mp4.box("minf", stbl))))))
    cols = ["sample_index", "offset", "size", "duration", "dts", "cts_delta", "is_sync"]
    got = media.static_samples(again).toPandas().sort_values("sample_index")[cols].values.tolist()
    assert got == one.sort_values("sample_index")[cols].values.tolist()


def test_fragments(spark):
    atoms = boxes.atoms(load(spark, f=mp4.fragmented()))
    rows = media.moving_samples(atoms).orderBy("sample_index").collect()
    moofs = [r["offset"] for r in atoms.filter("type = 'moof'").orderBy("offset").collect()]
    assert [(r["dts"], r["duration"], r["size"], r["is_sync"], r["cts_delta"]) for r in rows] == [
        (9000, 500, 10, True, 0), (9500, 500, 20, False, 0), (10000, 500, 30, False, 0), (10500, 250, 77, False, 5), (10750, 250, 77, False, 7)]
    assert [r["offset"] for r in rows[:3]] == [moofs[0] + 100, moofs[0] + 110, moofs[0] + 130]
    data = [r["offset"] + 8 for r in atoms.filter("type = 'mdat'").orderBy("offset").collect()]
    assert [r["offset"] for r in rows[3:]] == [data[1], data[1] + 77]  # a run without an offset begins with the media data


def test_fragments_written_and_read_again(spark, static):
    files, atoms = static
    samples = media.sample_data(media.static_samples(atoms), files).filter("track_id = 1").selectExpr("*", "cast(sample_index div 12 as long) segment_index")
    out = writers.write_fragments(samples, 30000).orderBy("segment_index").collect()
    data = b"".join(bytes(r["content"]) for r in out)
    init = mp4.box("moov", mp4.track(1, "vide", 30000, [], [], [], [], [], [], mp4.AVC_ENTRY), mp4.box("mvex", mp4.full("trex", 0, 0, mp4.u32(1, 1, 0, 0, 0))))
    again = load(spark, g=init + data)
    cols = ["sample_index", "size", "duration", "dts", "cts_delta", "is_sync"]
    got = media.moving_samples(boxes.atoms(again)).orderBy("sample_index")
    want = samples.orderBy("sample_index")
    assert [tuple(r) for r in got.select(*cols).collect()] == [tuple(r) for r in want.select(*cols).collect()]
    bytes_of = lambda s, f: [bytes(r["data"]) for r in media.sample_data(s, f).orderBy("sample_index").collect()]
    assert bytes_of(got, again) == [bytes(r["data"]) for r in want.collect()]


def test_index_check(spark):
    moof = mp4.box("moof", mp4.full("mfhd", 0, 0, mp4.u32(1)))
    mdat = mp4.box("mdat", bytes(10))
    size = len(moof) + len(mdat)
    sidx = writers.segment_index(1, 1000, 0, [(size, 10, True), (size, 10, True)])
    body = sidx + moof + mdat + moof + mdat
    good = body + writers.random_access(1, [(0, len(sidx)), (10, len(sidx) + size)])
    wrong = body + writers.random_access(1, [(0, len(sidx) + 1)])
    bad = media.bad_index_entries(boxes.atoms(load(spark, good=good, wrong=wrong))).collect()
    assert [(r["file"], r["kind"]) for r in bad] == [("wrong", "tfra")]


@pytest.mark.parametrize("width", [4, 8, 16])
def test_packed_sizes(width):
    sizes = [3, 15, 0, 7, 9]
    assert boxes.unpack_sizes(boxes.pack_sizes(sizes, width), width, 5) == sizes
    with pytest.raises(ValueError):
        boxes.pack_sizes([1 << width], width)


def test_edits(spark, static):
    files, atoms = static
    left = boxes.remove(atoms, "moov/trak[0]").cache()
    assert left.filter("path like 'moov[0]/trak[1]%'").count() == 0
    assert boxes.find(left, "moov/trak[0]/tkhd").first()["fields"]["id"] == "2"  # the second track has moved up
    trak = boxes.find(atoms, "moov/trak[0]").first()["size"]
    assert boxes.find(left, "moov").first()["size"] == boxes.find(atoms, "moov").first()["size"] - trak
    changed = boxes.replace(atoms, "ftyp", mp4.box("ftyp", b"mp42", mp4.u32(0)))
    assert boxes.find(changed, "ftyp").first()["size"] == 16
    put = boxes.insert(atoms, "moov/udta", mp4.box("free", b"xy"), 0)
    assert boxes.find(put, "moov/udta/free").first()["size"] == 10 and boxes.find(put, "moov/udta").first()["size"] == 18
    assert boxes.edit(atoms, [("remove", "moov/nope"), ("replace", "bad path", b"")]).count() == atoms.count()
    lines = boxes.dump_text(atoms).filter("atom_id = 0").first()["line"]
    assert lines.startswith("[ftyp] size=8+16 ")
    assert '"name":"ftyp"' in boxes.dump_json(atoms).filter("atom_id = 0").first()["line"]


def test_trees_are_written_and_read_again(spark, static):
    files, atoms = static
    assert bytes(boxes.write_tree(atoms, files).first()["content"]) == bytes(files.first()["content"])
    steps = [("remove", "moov/trak[0]"), ("insert", "", mp4.box("free", b"1234"), 1), ("insert", "moov/trak/mdia/minf/stbl/stsd", mp4.AVC_ENTRY)]
    new = boxes.edit(atoms, steps)
    written = boxes.write_tree(new, files).withColumnRenamed("file", "path")
    again = boxes.atoms(written)
    cols = ["path", "ordinal", "depth", "type", "header_size", "size", "fields"]
    shown = lambda df: sorted(str(r) for r in df.select(*cols).collect())
    assert shown(again) == shown(new)
    assert boxes.find(again, "moov/trak/mdia/minf/stbl/stsd").first()["fields"]["entry_count"] == "2"


def test_uuid_paths(spark):
    one, two = bytes(range(16)), bytes(range(16, 32))
    data = mp4.box("moov", mp4.box("uuid", one, b"a"), mp4.box("uuid", two, b"b"), mp4.box("uuid", one, b"c"))
    atoms = boxes.atoms(load(spark, u=data)).cache()
    payload = lambda path: [bytes(r["payload"]) for r in boxes.find(atoms, path).collect()]
    assert payload(f"moov/{two.hex()}") == [b"b"] and payload(f"moov/{one.hex()}[1]") == [b"c"] and payload(f"moov/{one.hex().upper()}") == [b"a"]
    assert payload("moov/uuid[1]") == [b"b"] and payload(f"moov/{two.hex()}[1]") == []
    left = boxes.remove(atoms, f"moov/{one.hex()}[1]")
    assert left.count() == 3 and boxes.find(left, f"moov/{two.hex()}").count() == 1


def test_many_samples(spark):
    """Tables are decoded as arrays: a million samples take seconds."""
    n = 1_000_000
    entry = mp4.AVC_ENTRY
    sizes = mp4.full("stsz", 0, 0, mp4.u32(0, n), b"\0\0\0\7" * n)
    stbl = mp4.box("stbl", mp4.full("stsd", 0, 0, mp4.u32(1), entry), mp4.full("stts", 0, 0, mp4.u32(1, n, 10)), mp4.full("stsc", 0, 0, mp4.u32(1, 1, 1000, 1)), sizes, mp4.full("stco", 0, 0, mp4.u32(n // 1000), b"".join(mp4.u32(k * 7000) for k in range(n // 1000))))
    tkhd = mp4.full("tkhd", 0, 7, mp4.u32(0, 0, 1, 0, 0), bytes(8), bytes(8), bytes(36), mp4.u32(0, 0))
    atoms = boxes.atoms(load(spark, m=mp4.box("moov", mp4.box("trak", tkhd, mp4.box("mdia", mp4.box("minf", stbl))))))
    row = media.static_samples(atoms).selectExpr("count(*) n", "max(offset) at", "max(dts) dts", "sum(size) size").first()
    assert tuple(row) == (n, 7 * (n - 1), 10 * (n - 1), 7 * n)


def test_tables_that_end_early(spark):
    tkhd = mp4.full("tkhd", 0, 7, mp4.u32(0, 0, 1, 0, 0), bytes(8), bytes(8), bytes(36), mp4.u32(0, 0))
    tables = [mp4.full("stts", 0, 0, mp4.u32(1, 3, 10)), mp4.full("ctts", 0, 0, mp4.u32(1, 2, 5)), mp4.full("stsc", 0, 0, mp4.u32(1, 1, 3, 1)), mp4.full("stsz", 0, 0, mp4.u32(4, 3)), mp4.full("stco", 0, 0, mp4.u32(1, 100))]
    whole = lambda t: boxes.atoms(load(spark, m=mp4.box("moov", mp4.box("trak", tkhd, mp4.box("mdia", mp4.box("minf", mp4.box("stbl", *t)))))), payloads=False)
    assert [r["dts"] for r in media.static_samples(whole(tables[:1] + tables[2:])).orderBy("sample_index").collect()] == [0, 10, 20]
    with pytest.raises(Exception, match="composition table ends"):
        media.static_samples(whole(tables)).collect()


def test_layout_notation():
    assert layouts.decode("a:u8 ?0x1 b:u16 n:u8 n*[x:u8 y:i8] rest:hex", b"\1\0\2\2\1\xff\3\4\5", flags=1)[0] == {"a": 1, "b": 2, "n": 2, "x[0]": 1, "y[0]": -1, "x[1]": 3, "y[1]": 4, "rest": "05"}
    with pytest.raises(layouts.Truncated):
        layouts.decode("a:u32", b"\0")
    assert layouts.decode("l:lang", b"\x55\xc4")[0] == {"l": "und"} and layouts.decode("l:lang", b"\x7f\xff")[0] == {"l": "und"}
