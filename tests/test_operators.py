"""Operators against plain Python on small made-up tracks."""

import random

import pytest
from pyspark.sql import functions as F

from strobila.functions import scalars
from strobila.operators import fragments, merge, runs, seek, segments

SCHEMA = "file string, track_id long, sample_index long, dts long, duration long, size long, cts_delta long, description_index long, is_sync boolean, offset long"


def tracks(seed=1, n=60):
    random.seed(seed)
    out = []
    for t in (1, 2, 3):
        dts = 0
        for k in range(n):
            d = random.choice([10, 10, 10, 20])
            out.append(("f", t, k, dts, d, random.randrange(1, 300), random.choice([0, 5]), random.choice([1, 1, 2]), k == 0 or random.random() < 0.2, random.randrange(10**6)))
            dts += d
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(tracks(), SCHEMA).cache()


@pytest.mark.parametrize("value", ["duration", "cts_delta", "description_index", "size"])
def test_runs_round_trip(df, value):
    out = runs.decode_runs(runs.encode_runs(df, value)).withColumnRenamed("value", "v")
    assert sorted((r["track_id"], r["sample_index"], r["v"]) for r in out.collect()) == sorted((r["track_id"], r["sample_index"], r[value]) for r in df.collect())


def test_a_count_out_of_bounds_is_refused(spark):
    bad = spark.createDataFrame([("f", 1, 0, 1 << 40, 5)], "file string, track_id long, entry_index long, sample_count long, value long")
    with pytest.raises(Exception, match="out of bounds"):
        runs.decode_runs(bad, most=1 << 24).collect()


def test_constant_composition_delta_is_kept(spark):
    same = spark.createDataFrame([("f", 1, k, 512) for k in range(5)] + [("f", 2, k, 0) for k in range(5)], "file string, track_id long, sample_index long, cts_delta long")
    assert [tuple(r) for r in runs.composition_table(same).collect()] == [("f", 1, 0, 5, 512)]


def test_chunks(df):
    got = {(r["track_id"], r["sample_index"]): r["chunk_index"] for r in runs.assign_chunks(df, 4).collect()}
    for t in (1, 2, 3):
        chunk, held, last = 0, 0, None
        for r in [r for r in tracks() if r[1] == t]:
            if r[7] != last or held == 4:
                chunk, held, last = chunk + 1, 0, r[7]
            held += 1
            assert got[t, r[2]] == chunk


def test_greedy_merge(df):
    got = [(r["track_id"], r["sample_index"]) for r in merge.greedy_interleave(df).orderBy("position").collect()]
    queues = {t: [r for r in tracks() if r[1] == t] for t in (1, 2, 3)}
    want = []
    while any(queues.values()):
        t = min((q[0][9], t) for t, q in queues.items() if q)[1]
        want.append((t, queues[t].pop(0)[2]))
    assert got == want
    assert merge.not_monotonic(df).count() == 3


def test_nearest_sync_without_any(spark):
    none = spark.createDataFrame([("f", 1, k, False) for k in range(4)], "file string, track_id long, sample_index long, is_sync boolean")
    assert {(r["sync_before"], r["sync_after"]) for r in seek.nearest_sync(none).collect()} == {(0, 4)}


def test_sync_interval(spark):
    rows = [("f", 1, k, k % 12 == 0) for k in range(54)] + [("f", 2, k, True) for k in range(5)] + [("f", 3, k, k in (0, 3)) for k in range(10)]
    got = seek.sync_interval(spark.createDataFrame(rows, "file string, track_id long, sample_index long, is_sync boolean"))
    assert {r["track_id"]: r["interval"] for r in got.collect()} == {1: 12, 2: 1, 3: 0}


def test_seek_across_tracks(spark):
    entries = spark.createDataFrame([("f", 1, 0, 100), ("f", 1, 50, 300), ("f", 2, 0, 200), ("f", 2, 40, 400)], "file string, track_id long, time long, moof_offset long")
    probes = spark.createDataFrame([("f", 1, 45), ("f", 2, 60), ("f", 3, 0)], "file string, probe_id long, time long")
    assert {r["probe_id"]: r["moof_offset"] for r in seek.seek_fragment(entries, probes).collect()} == {1: 100, 2: 300, 3: 100}


def test_times_continue(spark):
    rows = [("f", 1, k, 10, b) for k, b in enumerate([None, None, 100, None, 500])]
    out = fragments.continue_times(spark.createDataFrame(rows, "file string, track_id long, sample_index long, duration long, base_dts long"))
    assert [r["decode_time"] for r in out.orderBy("sample_index").collect()] == [0, 10, 100, 110, 500]


def test_fragment_plan_covers_all_samples(df):
    anchor = df.filter("track_id = 1").select("file", "track_id").distinct()
    plan = segments.plan_fragments(df, 2, 50, anchor).orderBy("track_id", "fragment_index").collect()
    for t in (1, 2, 3):
        own = [r for r in plan if r["track_id"] == t]
        assert sum(r["sample_count"] for r in own) == 60
        assert [r["first_sample"] for r in own] == [sum(r["sample_count"] for r in own[:k]) for k in range(len(own))]


def test_variant_groups(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "group string")
    wanted = spark.createDataFrame([(1, ["*"]), (2, ["b"]), (3, ["-"]), (4, ["a", "*"])], "track long, match array<string>")
    assert sorted(map(tuple, merge.matches(groups, wanted).collect())) == [(1, "a"), (1, "b"), (2, "b"), (4, "a"), (4, "b")]


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.convert_time(F.lit(1), F.lit(3), F.lit(1000)).alias("a"), scalars.convert_time(F.lit(2), F.lit(3), F.lit(1000)).alias("b"), scalars.convert_time(F.lit(9), F.lit(0), F.lit(5)).alias("c"),
        scalars.convert_time_exact(F.lit(2**60 + 1), F.lit(3), F.lit(3)).alias("d"), scalars.fourcc_text(F.lit(0x72747020)).alias("e"), scalars.fourcc_code(F.lit("rtp ")).alias("f"),
        scalars.language_code(scalars.language_pack(F.lit("eng"))).alias("g"), scalars.language_code(F.lit(0x7FFF)).alias("h"), scalars.iso_duration(F.lit(3725.5)).alias("i"), scalars.iso_duration(F.lit(5.25)).alias("j"),
        scalars.uint(F.lit(bytearray(b"\x00\x01\x02\x03\xff")), 2, 4).alias("k"), scalars.target_duration_rounded(F.lit(4.5)).alias("l"), scalars.target_duration_ceiling(F.lit(4.2)).alias("m"), scalars.truthy(F.lit("Yes")).alias("n"),
    ).first()
    assert tuple(one) == (333, 667, 0, 2**60 + 1, "rtp ", 0x72747020, "eng", "und", "PT1H2M5.500S", "PT5.250S", 0x010203FF, 5, 5, True)


def test_chunks_sort_a_track_once(df):
    plan = runs.chunk_layout(runs.assign_chunks(df.selectExpr("*", "1L size") if "size" not in df.columns else df, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1
