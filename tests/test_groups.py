"""Steps that work on many groups or large files a part at a time."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strobila.operators import tools
from strobila.operators.groups import by_group
from strobila.sources import boxes, media, writers
from tests import mp4


def steps(df):
    """Python steps in a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(x) for x in ("MapInArrow", "MapInPandas", "FlatMapGroupsIn", "FlatMapCoGroupsIn"))


def test_groups_are_whole(spark):
    """Groups longer than a batch, null keys and many small groups."""
    df = spark.range(60_000).selectExpr("case when id < 25000 then 'a' when id < 25003 then null else concat('k', id % 9000) end k", "id")

    def work(rows, bounds):
        import pyarrow as pa

        keys = rows.column("k").to_pylist()
        ids = rows.column("id").to_numpy()
        made = [(keys[a], int(b - a), bool((np.diff(ids[a:b]) > 0).all())) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.string()) for k, c in enumerate(zip(*made))], ["k", "n", "sorted"])

    got = by_group(df, ["k"], ["id"], work, "k string, n long, sorted boolean").collect()
    want = {r["k"]: r["n"] for r in df.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert len(got) == len(want) and {r["k"]: r["n"] for r in got} == want and all(r["sorted"] for r in got)


def test_static_samples_read_the_boxes_once(spark):
    files = spark.createDataFrame([("a", bytearray(mp4.static_av()))], "path string, content binary")
    assert steps(media.static_samples(boxes.atoms(files))) == 2  # the walk, and the tables of a track


def test_tracks_are_made_by_themselves(spark):
    """A file's tracks are written by many tasks, and only joined by one."""
    rows = [("f", t, k, k + 1, 0, k % 3 == 0, 1, bytearray(b"%d:%d" % (t, k))) for t in range(1, 40) for k in range(t % 7 + 1)]
    samples = spark.createDataFrame(rows, "file string, track_id long, sample_index long, duration long, cts_delta long, is_sync boolean, description_index long, data binary").withColumn("size", F.length("data").cast("long"))
    about = samples.select("file", "track_id").distinct()
    files = tools.mux(samples, about.selectExpr("*", "'vide' handler", f"X'{mp4.AVC_ENTRY.hex()}' entry"), about.selectExpr("*", "1000L timescale"), 2)
    assert steps(files) == 2
    files = files.withColumnRenamed("file", "path")
    got = media.sample_data(media.static_samples(boxes.atoms(files)), files).collect()
    assert sorted((r["track_id"], r["sample_index"], r["duration"], r["is_sync"], bytes(r["data"])) for r in got) == sorted((r[1], r[2], r[3], r[5], bytes(r[7])) for r in rows)


def test_fragments_are_packed_together():
    """Fragments made many at a time are those made one by one, and are read again whatever the parts they leave in."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 6, 300)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    pick = lambda hi, low=0: np.concatenate([np.full(n, rng.integers(low, hi)) if rng.random() < 0.5 else rng.integers(low, hi, n) for n in counts])
    duration, size, delta, sync = pick(1000), pick(20), pick(2, -1), pick(2).astype(bool)
    data = [rng.bytes(int(size[a:b].sum())) for a, b in zip(bounds[:-1], bounds[1:])]
    numbers, tracks, begins = list(range(300)), [k % 7 for k in range(300)], [k << 33 for k in range(300)]
    by_start = dict(zip(bounds[:-1].tolist(), data))
    got = list(writers.packed_fragments(numbers, tracks, begins, duration, size, delta, sync, bounds, lambda a, b: by_start[a]))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert got[k] == writers.packed_fragment(numbers[k], tracks[k], begins[k], duration[a:b], size[a:b], delta[a:b], sync[a:b], data[k])
        rows = {r[6]: r for r in boxes.rows_of("f", got[k])}
        assert rows["trun"][12]["sample_count"] == str(b - a) and rows["tfdt"][12]["base_media_decode_time"] == str(begins[k])
        assert int(rows["trun"][12]["data_offset"]) == rows["mdat"][7] + 8 and rows["mdat"][9] == len(data[k]) + 8


def test_segment_sizes_write_fragments_once(spark):
    from strobila.plans import catalog

    plan = catalog.QUERIES["segment_sizes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the events, and their kinds


def test_sample_data_of_any_place(spark):
    """Samples that overlap, lie beyond the file, or have no place; one that ends beyond it is an error."""
    content = bytes(range(200))
    places = [(0, 10), (10, 10), (20, 0), (5, 10), (15, 3), (None, 3), (4, None), (200, 5), (190, 10), (900, 0)]
    files = spark.createDataFrame([("f", bytearray(content)), ("g", None)], "path string, content binary")
    samples = spark.createDataFrame([(f, o, n, k) for f in "fgh" for k, (o, n) in enumerate(places)], "file string, offset long, size long, k long")
    got = {(r["file"], r["k"]): r["data"] for r in media.sample_data(samples, files).collect()}
    want = {(f, k): None if f == "g" or o is None or n is None else content[o : o + n] for f in "fg" for k, (o, n) in enumerate(places)}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == want
    with pytest.raises(Exception, match="ends beyond"):
        media.sample_data(samples.selectExpr("file", "195L offset", "10L size"), files).collect()


def test_a_walk_holds_one_box():
    """Containers are not copied while they are walked."""
    data = mp4.box("moov", mp4.box("trak", mp4.box("mdia", mp4.box("free", bytes(1000)) * 8000)))
    tracemalloc.start()
    n = sum(1 for _ in boxes.rows_of("f", data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8003 and peak < len(data) // 4


def test_a_walk_reads_a_file_where_it_is():
    """A file is walked in the buffer that brought it, and boxes of which nothing is known leave no bytes unless asked."""
    data = mp4.static_av() + mp4.box("moov", mp4.box("trak", mp4.box("free", bytes(1000)) * 4000))
    assert list(boxes.rows_of("f", memoryview(data))) == list(boxes.rows_of("f", data))
    tracemalloc.start()
    n = sum(1 for _ in boxes.rows_of("f", memoryview(data), payloads=False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 4000 and peak < 200_000


def test_a_wide_tree_is_edited_as_arrays(spark):
    """Numbers, paths and sizes of a tree with many boxes after edits are those of its bytes."""
    traks = [mp4.box("trak", *[mp4.box("free", b"%d" % (k * j)) for j in range(k % 5)]) for k in range(3000)]
    files = spark.createDataFrame([("f", bytearray(mp4.box("moov", *traks)))], "path string, content binary")
    new = boxes.edit(boxes.atoms(files), [("remove", "moov/trak[2]"), ("insert", "moov/trak[2]", mp4.box("free", b"new"), 0), ("replace", "moov/trak[7]", mp4.box("skip", b"x") * 2)])
    left = traks[:2] + [mp4.box("trak", mp4.box("free", b"new"), traks[3][8:])] + traks[4:8] + [mp4.box("skip", b"x") * 2] + traks[9:]
    want = mp4.box("moov", *left)
    assert bytes(boxes.write_tree(new, files).first()["content"]) == want
    again = boxes.atoms(spark.createDataFrame([("f", bytearray(want))], "path string, content binary"))
    cols = ["path", "ordinal", "depth", "type", "header_size", "size", "payload"]
    assert sorted(str(r) for r in new.select(*cols).collect()) == sorted(str(r) for r in again.select(*cols).collect())


def test_samples_of_fragments_come_from_one_step(spark):
    """They are those of the boxes' table, whatever else a file holds, and no table of boxes is dealt by file."""
    data = mp4.fragmented()
    late = mp4.box("free", b"x") + data[data.index(b"moof") - 4 :] + data[: data.index(b"moof") - 4]  # defaults after fragments
    many = [("a", data), ("b", mp4.static_av()), ("c", late), ("d", b""), ("e", data[:-9]), ("f", mp4.box("meta", bytes(4), data))]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in many], "path string, content binary")
    got, want = media.file_samples(files), media.moving_samples(boxes.atoms(files, payloads=False))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15
    assert got.columns == want.columns and steps(got) == 1


def cut(data, *at):
    ends = [*sorted(at), len(data)]
    parts = [memoryview(data)[a:b] for a, b in zip([0, *ends], ends)]
    return boxes.Pieces(len(data), parts[0], iter(parts[1:]))


def test_a_walk_of_pieces():
    """Boxes are the same wherever a file is cut."""
    uuid = mp4.box("uuid", bytes(range(16)), b"of its own")
    for data in (mp4.static_av(), mp4.fragmented(), uuid + mp4.box("free", bytes(50)) + uuid, mp4.fragmented()[:-7], mp4.u32(1) + b"free" + mp4.u64(20) + b"abcd" + mp4.u32(0) + b"mdat" + bytes(5)):
        want = list(boxes.rows_of("f", data))
        for k in range(1, min(len(data), 300)):
            assert list(boxes.rows_of("f", cut(data, k))) == want
        for width in (1, 7, 64):
            assert list(boxes.rows_of("f", cut(data, *range(width, len(data), width)))) == want
        assert [r[6] for r in boxes.rows_of("f", cut(data, 40), moov_only=True)] == [r[6] for r in boxes.rows_of("f", data, moov_only=True)]


def test_a_walk_holds_a_piece():
    """Of a file of 64 MB that comes in pieces, no more than a few pieces are held."""
    part = mp4.box("free", bytes(1000)) * 1000
    moov = (8 + 64 * len(part)).to_bytes(4, "big") + b"moov"
    data = boxes.Pieces(8 + 64 * len(part), memoryview(moov), (memoryview(bytes(part)) for _ in range(64)))
    tracemalloc.start()
    n = sum(1 for _ in boxes.walk(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64_001 and peak < 8 << 20


def test_files_reach_a_walk_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(boxes, "_PIECE", 100)
    many = [("a", mp4.static_av()), ("b", b""), ("c", mp4.fragmented()), ("d", mp4.box("free", bytes(92))), ("e", mp4.box("free", bytes(93))), ("f", mp4.static_av())]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in many], "path string, content binary")
    assert boxes.pieces(files).groupBy("path").count().filter("path = 'a'").first()["count"] == -(-len(mp4.static_av()) // 100)
    assert [tuple(r) for r in boxes.atoms(files).orderBy("file", "atom_id").collect()] == [r for p, c in many for r in boxes.rows_of(p, c)]
    first = boxes.atoms(files, moov_only=True).groupBy("file").count()  # what is left of a file is passed over
    assert {r["file"]: r["count"] for r in first.collect()} == {p: n for p, c in many if (n := sum(1 for _ in boxes.rows_of(p, c, moov_only=True)))}
    with pytest.raises(Exception, match="a file without content"):
        boxes.atoms(spark.createDataFrame([("a", None)], "path string, content binary")).count()


def test_boxes_at_a_path_leave_the_walk(spark):
    files = spark.createDataFrame([("a", bytearray(mp4.static_av())), ("b", bytearray(mp4.fragmented()))], "path string, content binary")
    atoms = boxes.atoms(files)
    for path in ("moov/trak[1]/mdia", "moof[1]/traf/tfhd", "moov", "free", "no/path", "00" * 16):
        assert sorted(map(str, boxes.find_in(files, path).collect())) == sorted(map(str, boxes.find(atoms, path).collect()))
    assert boxes.find_in(files, "moov")._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # nothing is filtered after it
