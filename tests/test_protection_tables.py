import json

from strobila.operators import tools
from strobila.sources import boxes, media
from strobila.sources import protection_tables as pt
from tests import mp4


def test_sample_info_of_fragments(spark):
    tenc = mp4.full("tenc", 1, 0, bytes([0, 0x19, 1, 8]), bytes(range(16)))
    entry = mp4.box("encv", bytes(6), b"\0\1", bytes(70), mp4.box("sinf", mp4.box("frma", b"avc1"), mp4.full("schm", 0, 0, b"cens", mp4.u32(0x10000)), mp4.box("schi", tenc)))
    init = mp4.box("moov", mp4.track(1, "vide", 1000, [], [], [], [], [], [], entry), mp4.box("mvex", mp4.full("trex", 0, 0, mp4.u32(1, 1, 10, 5, 0))))
    rows = [(bytes([k]) * 8, [(1, 2), (3, k)]) for k in range(3)]
    senc = pt.write_sample_info(rows)
    traf = mp4.box("traf", mp4.full("tfhd", 0, 0x020000, mp4.u32(1)), mp4.full("tfdt", 0, 0, mp4.u32(0)), mp4.full("trun", 0, 0x1, mp4.u32(3, 0)), senc)
    files = spark.createDataFrame([("f", bytearray(init + mp4.box("moof", mp4.full("mfhd", 0, 0, mp4.u32(1)), traf)))], "path string, content binary")
    atoms = boxes.atoms(files).cache()
    d = pt.track_defaults(atoms)
    r = d.first()
    assert (r["scheme"], r["kid"], r["iv_size"], r["crypt"], r["skip"]) == ("cens", bytes(range(16)).hex(), 8, 1, 9)
    out = pt.with_sample_info(media.moving_samples(atoms), pt.fragment_sample_info(atoms, d)).orderBy("sample_index").collect()
    assert [(bytes(x["iv"]), [tuple(p) for p in x["parts"]]) for x in out] == rows


def test_groups_systems_and_sizes(spark):
    sbgp = mp4.full("sbgp", 0, 0, b"seig", mp4.u32(2, 3, 1, 2, 0))
    tkhd = mp4.full("tkhd", 0, 7, mp4.u32(0, 0, 4, 0, 0), bytes(8), bytes(8), bytes(36), mp4.u32(0, 0))
    pssh = [mp4.full("pssh", 1, 0, bytes([k]) * 16, mp4.u32(2), b"a" * 16, b"b" * 16, mp4.u32(1), b"x") for k in (1, 2)]
    saiz = mp4.full("saiz", 0, 0, b"\0", mp4.u32(3), bytes([5, 6, 7]))
    elst = mp4.full("elst", 0, 0, mp4.u32(1, 100, 0xFFFFFFFF, 0x10000))
    data = mp4.box("moov", *pssh, mp4.box("trak", tkhd, mp4.box("edts", elst), mp4.box("mdia", mp4.box("minf", mp4.box("stbl", sbgp, saiz)))))
    atoms = boxes.atoms(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"))
    assert [(r["sample_index"], r["group_description_index"]) for r in pt.sample_groups(atoms).orderBy("sample_index").collect()] == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    assert [(r["system_id"], r["kids"], r["data"]) for r in pt.systems(atoms).orderBy("system_id").collect()] == [("01" * 16, ["61" * 16, "62" * 16], "78"), ("02" * 16, ["61" * 16, "62" * 16], "78")]
    left = pt.drop_system(atoms, "01" * 16)
    assert pt.systems(left).count() == 1 and [r["ordinal"] for r in left.filter("depth = 1").orderBy("offset").collect()] == [0, 1]
    assert pt.info_sizes(atoms).first()["total"] == 18
    assert tuple(pt.edit_list(atoms).first()) == ("f", 4, 0, 100, -1)


def test_hooks_and_names(spark):
    df = spark.createDataFrame([("f", 1, 1, 5), ("f", 1, 0, 7)], "file string, track_id long, sample_index long, size long")
    out = tools.process(df, lambda p: p.assign(size=p["size"].cumsum()), df.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted((r["sample_index"], r["size"]) for r in out.collect()) == [(0, 7), (1, 12)]
    assert tools.speaker_count(0xF801) == 6 and tools.speaker_names(0xA000) == "L R"
    t = spark.createDataFrame([("p", "b", "audio", "x", 2, 3, "u"), ("p", "a", "video", "y", 1, 2, "v")], "presentation string, name string, kind string, codecs string, bandwidth long, segment_count long, url string")
    assert [x["name"] for x in json.loads(tools.json_manifest(t).first()["text"])["tracks"]] == ["a", "b"]
    s = spark.createDataFrame([("p", "en", 6, False), ("p", "en", 6, True)], "presentation string, set_name string, channels int, objects boolean")
    assert sorted(r["set_name"] for r in tools.regroup_by_channels(s).collect()) == ["en/6ch", "en/objects"]
    files = spark.createDataFrame([("x", bytearray(mp4.box("abcd", b"123")))], "path string, content binary")
    assert boxes.atoms(files, decoders={"abcd": lambda body: {"n": len(body)}}).first()["fields"] == {"n": "3"}
