"""Registered queries over the driver's tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobila.functions import scalars as fn
from strobila.operators import merge, runs, seek, segments, sets
from strobila.operators.adapter import SAMPLES_SQL, TIMESCALE, event_samples, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A day in ticks, for the fixed segments of the adapter's long tracks.
DAY = 86_400 * TIMESCALE
KEYS = ["file", "track_id"]
OVER = "OVER (PARTITION BY file, track_id ORDER BY sample_index)"


def query(name: str, sql: str | None = None, samples: bool = True) -> Callable[[Query], Query]:
    """Registers a query with its SQL, which begins with the CTE ``s`` of the adapter's samples if ``samples``."""
    head = SAMPLES_SQL.replace("WITH", "WITH RECURSIVE", 1)

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (head if samples else "") + sql
        return f

    return put


@query("media_scan", """
SELECT *, CASE WHEN millis = 0 THEN 0 ELSE CAST(floor(total_size * 8000 / millis) AS BIGINT) END AS bitrate FROM (
  SELECT file, track_id, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS total_size, CAST(sum(duration) AS BIGINT) AS total_duration,
         CAST(floor(0.5::DOUBLE + CAST(sum(duration) AS DOUBLE) * (1000.0::DOUBLE / 1000000.0::DOUBLE)) AS BIGINT) AS millis
  FROM s GROUP BY file, track_id)""")
def media_scan(spark, d):
    return segments.media_scan(event_samples(spark, d), TIMESCALE)


@query("frame_rate", """
SELECT file, track_id, count(*) AS sample_count, CAST(sum(duration) AS BIGINT) AS total_duration,
       CASE WHEN sum(duration) = 0 THEN 0.0::DOUBLE ELSE count(*)::DOUBLE / (CAST(sum(duration) AS DOUBLE) / 1000000.0::DOUBLE) END AS frame_rate
FROM s GROUP BY file, track_id""")
def frame_rate(spark, d):
    return segments.rates(event_samples(spark, d), TIMESCALE)


@query("time_convert", """
SELECT event_id, CAST(floor(0.5::DOUBLE + CAST(dts AS DOUBLE) * (90000.0::DOUBLE / 1000000.0::DOUBLE)) AS BIGINT) AS ticks_90k,
       CAST(floor(0.5::DOUBLE + CAST(duration AS DOUBLE) * (30000.0::DOUBLE / 1000000.0::DOUBLE)) AS BIGINT) AS ticks_30k,
       CAST(floor((CAST(duration AS HUGEINT) * 44100 * 2 + 1000000) // 2000000) AS BIGINT) AS exact_44k FROM s""")
def time_convert(spark, d):
    s = event_samples(spark, d)
    one, to = F.lit(TIMESCALE), F.lit
    return s.select("event_id", fn.convert_time(F.col("dts"), one, to(90000)).alias("ticks_90k"), fn.convert_time(F.col("duration"), one, to(30000)).alias("ticks_30k"), fn.convert_time_exact(F.col("duration"), one, to(44100)).alias("exact_44k"))


RUNS_SQL = f""", t AS (SELECT *, CASE WHEN lag(description_index) {OVER} = description_index OR sample_index = 0 THEN 0 ELSE 1 END AS turn FROM s),
r AS (SELECT *, sum(turn) {OVER} AS entry_index FROM t)"""


@query("stts_rle_encode", RUNS_SQL + """
SELECT file, track_id, CAST(entry_index AS BIGINT) AS entry_index, count(*) AS sample_count, min(description_index) AS value FROM r GROUP BY 1, 2, 3""")
def rle_encode(spark, d):
    return runs.encode_runs(event_samples(spark, d), "description_index")


@query("rle_roundtrip", "SELECT file, track_id, sample_index, description_index AS value FROM s")
def rle_roundtrip(spark, d):
    return runs.decode_runs(runs.encode_runs(event_samples(spark, d), "description_index"))


@query("rle_time_decode", f"""
SELECT file, track_id, sample_index, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY file, track_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM s""")
def rle_time_decode(spark, d):
    return runs.decode_times(runs.encode_runs(event_samples(spark, d), "duration"))


@query("dts_prefix_sum", """
SELECT file, track_id, sample_index, CAST(coalesce(sum(duration) OVER (PARTITION BY file, track_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS media_time FROM s""")
def dts_prefix_sum(spark, d):
    return runs.sum_before(event_samples(spark, d), "duration", "media_time").select(*KEYS, "sample_index", "media_time")


CHUNK_SQL = RUNS_SQL + f""", c AS (SELECT *, row_number() OVER (PARTITION BY file, track_id, entry_index ORDER BY sample_index) - 1 AS in_run FROM r),
k AS (SELECT *, CAST(sum(CASE WHEN in_run % 4 = 0 THEN 1 ELSE 0 END) {OVER} AS BIGINT) AS chunk_index FROM c),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file, track_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset FROM k),
l AS (SELECT *, min(sample_offset) OVER (PARTITION BY file, track_id, chunk_index) AS chunk_offset FROM o)"""


def _chunks(spark, d):
    return runs.assign_chunks(event_samples(spark, d), 4)


@query("chunk_assign", CHUNK_SQL + "SELECT file, track_id, sample_index, chunk_index FROM l")
def chunk_assign(spark, d):
    return _chunks(spark, d).select(*KEYS, "sample_index", "chunk_index")


@query("chunk_offset_layout", CHUNK_SQL + "SELECT file, track_id, sample_index, chunk_index, chunk_offset, sample_offset FROM l")
def chunk_offset_layout(spark, d):
    return runs.chunk_layout(_chunks(spark, d)).select(*KEYS, "sample_index", "chunk_index", "chunk_offset", F.col("offset").alias("sample_offset"))


@query("stsc_encode", CHUNK_SQL + """
SELECT file, track_id, chunk_index - 1 AS entry_index, chunk_index AS first_chunk, count(*) AS samples_per_chunk, min(description_index) AS description_index FROM l GROUP BY file, track_id, chunk_index""")
def stsc_encode(spark, d):
    return runs.encode_chunk_map(_chunks(spark, d))


@query("stsc_range_join", CHUNK_SQL + """
SELECT file, track_id, chunk_index, min(chunk_offset) AS chunk_offset, count(*) AS samples_per_chunk, min(description_index) AS description_index, min(sample_index) AS first_sample FROM l GROUP BY file, track_id, chunk_index""")
def stsc_range_join(spark, d):
    laid = runs.chunk_layout(_chunks(spark, d))
    chunks = laid.groupBy(*KEYS, "chunk_index").agg(F.min("chunk_offset").alias("offset"))
    return runs.expand_chunk_map(runs.encode_chunk_map(laid, merge=True), chunks).withColumnRenamed("offset", "chunk_offset")


@query("stss_table", """
SELECT file, track_id, sample_index + 1 AS sample_number FROM (SELECT *, bool_and(is_sync) OVER (PARTITION BY file, track_id) AS all_of, bool_or(is_sync) OVER (PARTITION BY file, track_id) AS any_of FROM s) WHERE is_sync AND any_of AND NOT all_of""")
def stss_table(spark, d):
    return runs.sync_table(event_samples(spark, d))


@query("stco_choice", CHUNK_SQL + """
SELECT file, track_id, CASE WHEN max_by(chunk_offset, chunk_index) <= 4294967295 THEN 'stco' ELSE 'co64' END AS kind, count(DISTINCT chunk_index) AS chunk_count FROM l GROUP BY file, track_id""")
def stco_choice(spark, d):
    return runs.offset_table(runs.chunk_layout(_chunks(spark, d)))


@query("ctts_table", f""", n AS (SELECT *, max(CASE WHEN cts_delta <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file, track_id) AS any_of FROM s),
t AS (SELECT *, CASE WHEN lag(cts_delta) {OVER} = cts_delta OR sample_index = 0 THEN 0 ELSE 1 END AS turn FROM n WHERE any_of = 1),
r AS (SELECT *, sum(turn) {OVER} AS entry_index FROM t)
SELECT file, track_id, CAST(entry_index AS BIGINT) AS entry_index, count(*) AS sample_count, min(cts_delta) AS value FROM r GROUP BY 1, 2, 3""")
def ctts_table(spark, d):
    return runs.composition_table(event_samples(spark, d))


@query("seek_asof", """, p AS (SELECT o_orderkey AS probe_id, 'f' || CAST(u % 16 AS VARCHAR) AS file, u AS track_id, probe_time FROM (
  SELECT o_orderkey, o_custkey % (SELECT max(user_id) + 1 FROM events) AS u, (SELECT min(epoch_us(ts)) FROM events) + (o_orderkey * 7919 * 1000003) % (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events) AS probe_time FROM orders))
SELECT p.file, p.track_id, p.probe_id, p.probe_time, s.sample_index AS found_sample_index, s.dts AS found_dts
FROM p ASOF LEFT JOIN s ON p.track_id = s.track_id AND p.probe_time >= s.dts""")
def seek_asof(spark, d):
    span = table(spark, d, "events").agg((F.max("user_id") + 1).alias("_u"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_hi"))
    orders = table(spark, d, "orders").crossJoin(F.broadcast(span))  # one row
    probes = orders.select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % F.col("_u")).alias("track_id"), (F.col("_lo") + (F.col("o_orderkey") * 7919 * 1000003) % (F.col("_hi") - F.col("_lo") + 1)).alias("dts"))
    probes = probes.withColumn("file", F.concat(F.lit("f"), F.col("track_id") % 16))
    return seek.seek_asof(probes, event_samples(spark, d), KEYS)


def _near(inclusive):
    end = "CURRENT ROW" if inclusive else "1 PRECEDING"
    return f"""
SELECT file, track_id, sample_index,
  coalesce(max(CASE WHEN is_sync THEN sample_index END) OVER (PARTITION BY file, track_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 0) AS sync_before,
  coalesce(min(CASE WHEN is_sync THEN sample_index END) OVER (PARTITION BY file, track_id ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY file, track_id)) AS sync_after
FROM s"""


@query("nearest_sync_strict", _near(False))
def nearest_sync_strict(spark, d):
    return seek.nearest_sync(event_samples(spark, d)).select(*KEYS, "sample_index", "sync_before", "sync_after")


@query("nearest_sync_inclusive", _near(True))
def nearest_sync_inclusive(spark, d):
    return seek.nearest_sync(event_samples(spark, d), inclusive=True).select(*KEYS, "sample_index", "sync_before", "sync_after")


@query("sync_interval", """, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM s),
c AS (SELECT file, track_id, n, sample_index AS k FROM n WHERE is_sync AND sample_index > 0),
g AS (SELECT c.track_id, c.k, bool_and(x.is_sync) AS good FROM c JOIN n x ON x.track_id = c.track_id AND x.sample_index % c.k = 0 GROUP BY c.track_id, c.k)
SELECT t.file, t.track_id, coalesce(min(g.k), 0) AS interval FROM (SELECT DISTINCT file, track_id FROM s) t LEFT JOIN g ON g.track_id = t.track_id AND g.good GROUP BY t.file, t.track_id""")
def sync_interval(spark, d):
    return seek.sync_interval(event_samples(spark, d))


@query("closest_sync", f""", b AS (SELECT file, track_id, min(dts) AS lo, max(dts) AS hi FROM s GROUP BY file, track_id),
t AS (SELECT file, track_id, unnest(generate_series(0, (hi - lo) // {7 * DAY})) AS segment_index, lo FROM b),
c AS (SELECT t.file, t.track_id, t.segment_index, lo + t.segment_index * {7 * DAY} AS target, s.sample_index, row_number() OVER (PARTITION BY t.track_id, t.segment_index ORDER BY abs(s.dts - lo - t.segment_index * {7 * DAY}), s.sample_index) AS k
  FROM t JOIN s ON s.track_id = t.track_id AND s.is_sync)
SELECT file, track_id, segment_index, target, sample_index FROM c WHERE k = 1""")
def closest_sync(spark, d):
    return seek.closest_sync(event_samples(spark, d), 7 * DAY)


@query("interleave_merge", "SELECT file, track_id, sample_index, row_number() OVER (PARTITION BY file ORDER BY dts, track_id, sample_index) - 1 AS position FROM s")
def interleave_merge(spark, d):
    return merge.interleave(event_samples(spark, d)).select(*KEYS, "sample_index", "position")


@query("interleave_last_wins", "SELECT file, track_id, sample_index, row_number() OVER (PARTITION BY file ORDER BY dts, track_id DESC, sample_index) - 1 AS position FROM s")
def interleave_last_wins(spark, d):
    return merge.interleave(event_samples(spark, d), last_wins=True).select(*KEYS, "sample_index", "position")


@query("greedy_merge", """, m AS (SELECT *, max(size) OVER (PARTITION BY file, track_id ORDER BY sample_index) AS reach FROM s)
SELECT file, track_id, sample_index, row_number() OVER (PARTITION BY file ORDER BY reach, track_id, sample_index) - 1 AS position FROM m""")
def greedy_merge(spark, d):
    return merge.greedy_interleave(event_samples(spark, d), "size").select(*KEYS, "sample_index", "position")


MERGE_SQL = """, p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY dts, track_id, sample_index) - 1 AS position FROM s)"""


@query("track_switch_runs", MERGE_SQL + """, w AS (SELECT *, CASE WHEN track_id <> lag(track_id) OVER (PARTITION BY file ORDER BY position) THEN 1 ELSE 0 END AS turn FROM p)
SELECT file, track_id, sample_index, position, CAST(sum(turn) OVER (PARTITION BY file ORDER BY position) AS BIGINT) AS run, CAST(sum(turn) OVER (PARTITION BY file ORDER BY position) % 2 AS INTEGER) AS switch FROM w""")
def track_switch_runs(spark, d):
    return merge.switch_runs(merge.interleave(event_samples(spark, d))).select(*KEYS, "sample_index", "position", "run", "switch")


@query("buffer_peak", MERGE_SQL + """, h AS (SELECT *, size - coalesce(lag(size) OVER (PARTITION BY file, track_id ORDER BY position), 0) AS held FROM p),
f AS (SELECT file, sum(held) OVER (PARTITION BY file ORDER BY position) AS fullness FROM h) SELECT file, CAST(max(fullness) AS BIGINT) AS peak FROM f GROUP BY file""")
def buffer_peak(spark, d):
    return merge.buffer_peak(merge.interleave(event_samples(spark, d)))


@query("gop_reorder", f""", g AS (SELECT *, CAST(sum(CASE WHEN is_sync THEN 1 ELSE 0 END) {OVER} AS BIGINT) AS gop FROM s)
SELECT file, track_id, sample_index, gop, row_number() OVER (PARTITION BY file, track_id, gop ORDER BY cts_delta, sample_index) AS display_rank,
 row_number() OVER (PARTITION BY file, track_id, gop ORDER BY sample_index) - row_number() OVER (PARTITION BY file, track_id, gop ORDER BY cts_delta, sample_index) AS reorder FROM g""")
def gop_reorder(spark, d):
    return segments.display_order(event_samples(spark, d)).select(*KEYS, "sample_index", "gop", "display_rank", "reorder")


@query("gop_max_reorder", f""", g AS (SELECT *, CAST(sum(CASE WHEN is_sync THEN 1 ELSE 0 END) {OVER} AS BIGINT) AS gop FROM s),
x AS (SELECT file, track_id, row_number() OVER (PARTITION BY file, track_id, gop ORDER BY sample_index) - row_number() OVER (PARTITION BY file, track_id, gop ORDER BY cts_delta, sample_index) AS reorder FROM g)
SELECT file, track_id, max(reorder) AS max_reorder FROM x GROUP BY file, track_id""")
def gop_max_reorder(spark, d):
    return segments.display_order(event_samples(spark, d)).groupBy(*KEYS).agg(F.max("reorder").alias("max_reorder"))


SEG_SQL = f""", g AS (SELECT *, (dts - min(dts) OVER (PARTITION BY file, track_id)) // {DAY} AS segment_index FROM s)"""
ROLL_SQL = SEG_SQL + """, u AS (SELECT file, track_id, segment_index, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS size, CAST(sum(duration) AS BIGINT) AS duration,
  CASE WHEN sum(duration) = 0 THEN 0 ELSE CAST(floor(CAST(sum(size) AS HUGEINT) * 8000000 // sum(duration)) AS BIGINT) END AS bitrate FROM g GROUP BY file, track_id, segment_index)"""


def _segments(spark, d):
    return segments.fixed_segments(event_samples(spark, d), DAY)


def _rolled(spark, d):
    return segments.roll_up_segments(_segments(spark, d), TIMESCALE)


@query("segment_fixed", SEG_SQL + "SELECT file, track_id, sample_index, segment_index FROM g")
def segment_fixed(spark, d):
    return _segments(spark, d).select(*KEYS, "sample_index", "segment_index")


@query("segment_rollup", ROLL_SQL + "SELECT * FROM u")
def segment_rollup(spark, d):
    return _rolled(spark, d)


@query("track_rollup_trim", ROLL_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY file, track_id) AS n, row_number() OVER (PARTITION BY file, track_id ORDER BY segment_index) AS k FROM u)
SELECT file, track_id, count(*) AS segment_count, CAST(sum(CASE WHEN n <= 2 OR k <= n - 2 THEN duration END) AS DOUBLE) / count(CASE WHEN n <= 2 OR k <= n - 2 THEN 1 END) AS mean_duration,
 max(CASE WHEN n <= 1 OR k <= n - 1 THEN bitrate END) AS max_bitrate FROM n GROUP BY file, track_id""")
def track_rollup_trim(spark, d):
    return segments.roll_up_tracks(_rolled(spark, d))


@query("iframe_index", SEG_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY file, track_id, segment_index ORDER BY sample_index) AS k FROM g)
SELECT file, track_id, segment_index, sample_index, dts FROM f WHERE k = 1 AND is_sync""")
def iframe_index(spark, d):
    return segments.first_sync_of_fragment(_segments(spark, d)).select(*KEYS, "segment_index", "sample_index", "dts")


@query("iframe_index_every", SEG_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY file, track_id, segment_index ORDER BY sample_index) AS k FROM g WHERE is_sync)
SELECT file, track_id, segment_index, sample_index, dts FROM f WHERE k = 1""")
def iframe_index_every(spark, d):
    return segments.first_sync_of_fragment(_segments(spark, d), every=True).select(*KEYS, "segment_index", "sample_index", "dts")


@query("iframe_durations", """, e AS (SELECT *, max(dts + duration) OVER (PARTITION BY file, track_id) AS fin FROM s)
SELECT file, track_id, sample_index, dts, coalesce(lead(dts) OVER (PARTITION BY file, track_id ORDER BY sample_index), fin) - dts AS sync_duration FROM e WHERE is_sync""")
def iframe_durations(spark, d):
    return segments.sync_durations(event_samples(spark, d))


@query("timeline_rle", ROLL_SQL + """, b AS (SELECT file, track_id, segment_index, sample_count AS d FROM u),
t AS (SELECT *, CASE WHEN lag(d) OVER (PARTITION BY file, track_id ORDER BY segment_index) IS NULL OR lag(d) OVER (PARTITION BY file, track_id ORDER BY segment_index) = d THEN 0 ELSE 1 END AS turn FROM b),
r AS (SELECT *, sum(turn) OVER (PARTITION BY file, track_id ORDER BY segment_index) AS entry_index FROM t)
SELECT file, track_id, CAST(entry_index AS BIGINT) AS entry_index, min(d) AS d, CASE WHEN count(*) > 1 THEN count(*) - 1 END AS r FROM r GROUP BY file, track_id, entry_index""")
def timeline_rle(spark, d):
    return runs.timeline(_rolled(spark, d), KEYS, "segment_index", "sample_count")


@query("target_durations", ROLL_SQL + """, l AS (SELECT file, max(CAST(duration AS DOUBLE) / 1000000.0::DOUBLE) AS longest FROM u GROUP BY file)
SELECT file, CAST(floor(longest + 0.5::DOUBLE) AS BIGINT) AS rounded, CAST(ceil(longest) AS BIGINT) AS ceiling FROM l""")
def target_durations(spark, d):
    longest = _rolled(spark, d).groupBy("file").agg(F.max(F.col("duration").cast("double") / F.lit(float(TIMESCALE))).alias("longest"))
    return longest.select("file", fn.target_duration_rounded(F.col("longest")).alias("rounded"), fn.target_duration_ceiling(F.col("longest")).alias("ceiling"))


@query("alike_flags", SEG_SQL + """, f AS (SELECT *, sample_index = min(sample_index) OVER (PARTITION BY file, track_id, segment_index) AS is_first FROM g)
SELECT file, track_id, segment_index, min(duration) = max(duration) AS same_duration, min(size) = max(size) AS same_size, bool_and(is_sync) AS all_sync, bool_and(is_sync = is_first) AS only_first_sync FROM f GROUP BY file, track_id, segment_index""")
def alike_flags(spark, d):
    return segments.alike_flags(_segments(spark, d), [*KEYS, "segment_index"])


@query("max_per_set", """SELECT p_brand AS set_brand, p_type AS set_type, max(p_size) AS max_size, max(p_retailprice) AS max_price, count(*) AS members FROM part GROUP BY p_brand, p_type""", samples=False)
def max_per_set(spark, d):
    tracks = table(spark, d, "part").select(F.col("p_brand").alias("set_brand"), F.col("p_type").alias("set_type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return sets.max_per_set(tracks, ["set_brand", "set_type"], ["size", "price"])


#: Parts as tracks of presentations by size: three types, languages and families from their fields.
TRACKS_SQL = """WITH RECURSIVE t AS (SELECT p_size AS presentation, p_partkey AS ordinal, CASE WHEN p_partkey % 5 < 3 THEN 'audio' WHEN p_partkey % 5 = 3 THEN 'video' ELSE 'subtitles' END AS type,
  chr(CAST(97 + p_partkey % 3 AS INTEGER)) AS language, p_type AS codec, substr(p_brand, 1, 7) AS codec_family, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE '' END AS label, CAST(floor(p_retailprice) AS BIGINT) AS bandwidth FROM part),
lb AS (SELECT presentation, label, dense_rank() OVER (PARTITION BY presentation ORDER BY min(ordinal)) AS n FROM t GROUP BY presentation, label),
k AS (SELECT t.*, CASE type WHEN 'audio' THEN 'audio/' || language || '/' || codec || '/' || CAST(n AS VARCHAR) WHEN 'video' THEN 'video/' || codec_family ELSE 'subtitles/' || language || '/' || codec_family END AS set_key FROM t JOIN lb USING (presentation, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY presentation, set_key ORDER BY ordinal) AS i FROM k),
w AS (SELECT presentation, set_key, ordinal, type, i, true AS keep, [bandwidth] AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.presentation, r.set_key, r.ordinal, r.type, r.i,
   CASE r.type WHEN 'video' THEN true WHEN 'audio' THEN len(list_filter(w.kept, lambda x: abs((x - r.bandwidth) / CAST(x AS DOUBLE)) < 0.1)) = 0 ELSE false END,
   CASE WHEN len(list_filter(w.kept, lambda x: abs((x - r.bandwidth) / CAST(x AS DOUBLE)) < 0.1)) = 0 THEN list_append(w.kept, r.bandwidth) ELSE w.kept END
  FROM w JOIN r ON r.presentation = w.presentation AND r.set_key = w.set_key AND r.i = w.i + 1)
SELECT presentation, set_key, ordinal, row_number() OVER (PARTITION BY presentation, set_key ORDER BY ordinal) AS order_index FROM w WHERE keep"""


@query("adaptation_sets", TRACKS_SQL, samples=False)
def adaptation_sets(spark, d):
    n = F.col("p_partkey")
    tracks = table(spark, d, "part").select(
        F.col("p_size").alias("presentation"), n.alias("ordinal"), F.when(n % 5 < 3, "audio").when(n % 5 == 3, "video").otherwise("subtitles").alias("type"), F.char(97 + n % 3).alias("language"),
        F.col("p_type").alias("codec"), F.substring("p_brand", 1, 7).alias("codec_family"), F.when(n % 7 == 0, F.col("p_brand")).otherwise("").alias("label"), F.floor("p_retailprice").cast("long").alias("bandwidth"),
    )
    return sets.adaptation_sets(tracks, ["presentation"]).select("presentation", F.array_join("set_key", "/").alias("set_key"), "ordinal", "order_index")


@query("set_prefix_simplify", """SELECT o_custkey, o_orderstatus, o_orderpriority, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1 THEN CAST(o_custkey AS VARCHAR) || '/' || o_orderstatus
 ELSE CAST(o_custkey AS VARCHAR) || '/' || o_orderstatus || '/' || o_orderpriority END AS name FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)""", samples=False)
def set_prefix_simplify(spark, d):
    sets = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()
    return segments.simplify_sets(sets, ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("unique_names", """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN k = 1 THEN o_orderstatus ELSE o_orderstatus || '-' || CAST(k - 1 AS VARCHAR) END AS unique_name FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)""", samples=False)
def unique_names(spark, d):
    return segments.unique_names(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "unique_name")


@query("group_rates", ROLL_SQL + """, a AS (SELECT file, track_id, floor(avg(bitrate)) AS mean_rate, max(bitrate) AS peak_rate FROM u GROUP BY file, track_id),
f AS (SELECT file, track_id, min(kind) AS codec FROM s GROUP BY file, track_id),
la AS (SELECT file, count(DISTINCT track_id % 3) AS n_languages, count(*) AS n_tracks FROM f GROUP BY file),
gr AS (SELECT a.*, f.codec, CASE WHEN n_languages > 1 THEN 'audio/' || f.codec WHEN n_tracks = 1 THEN 'audio' ELSE 'audio/' || CAST(row_number() OVER (PARTITION BY a.file ORDER BY a.track_id) AS VARCHAR) END AS audio_group
  FROM a JOIN f USING (file, track_id) JOIN la ON la.file = a.file)
SELECT file, audio_group, CAST(max(mean_rate) AS BIGINT) AS mean_rate, max(peak_rate) AS peak_rate, string_agg(DISTINCT codec, ',' ORDER BY codec) AS codecs FROM gr GROUP BY file, audio_group""")
def group_rates(spark, d):
    rates = _rolled(spark, d).groupBy(*KEYS).agg(F.floor(F.avg("bitrate")).cast("long").alias("mean_rate"), F.max("bitrate").alias("peak_rate"))
    codecs = event_samples(spark, d).groupBy(*KEYS).agg(F.min("kind").alias("codec"))
    tracks = rates.join(codecs, KEYS).select("file", F.col("track_id").alias("ordinal"), (F.col("track_id") % 3).cast("string").alias("language"), "codec", F.lit(None).cast("string").alias("audio_group"), "mean_rate", "peak_rate")
    return sets.group_rates(sets.audio_groups(tracks, ["file"]), ["file", "audio_group"])


@query("default_tracks", """SELECT p_size, p_partkey, CASE WHEN asked IS NOT NULL THEN asked ELSE NOT EXISTS (
  SELECT 1 FROM part q WHERE q.p_size = t.p_size AND q.p_partkey < t.p_partkey AND q.p_partkey % 3 <> 1) END AS is_default
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS asked FROM part) t""", samples=False)
def default_tracks(spark, d):
    n = F.col("p_partkey")
    tracks = table(spark, d, "part").select("p_size", n, n.alias("ordinal"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("asked_default"))
    return sets.with_defaults(tracks, ["p_size"]).select("p_size", "p_partkey", "is_default")


@query("defaults_cascade", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) END, CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END, 0) AS size
FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey""", samples=False)
def defaults_cascade(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    size = merge.cascade(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")), F.when(F.col("o_orderstatus") == "O", F.floor("o_totalprice").cast("long")), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("long")), 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", size.cast("long").alias("size"))


@query("dts_continuation", f""", a AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN dts END AS base FROM s),
b AS (SELECT *, count(base) {OVER} AS era FROM a)
SELECT file, track_id, sample_index, CAST(coalesce(max(base) OVER (PARTITION BY file, track_id, era), 0) + coalesce(sum(duration) OVER (PARTITION BY file, track_id, era ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM b""")
def dts_continuation(spark, d):
    from strobila.operators.fragments import continue_times

    rows = event_samples(spark, d).withColumn("base_dts", F.when(F.col("event_id") % 10 == 0, F.col("dts")))
    return continue_times(rows).select(*KEYS, "sample_index", "decode_time")


@query("index_anti_join", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)", samples=False)
def index_anti_join(spark, d):
    target = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.dangling(table(spark, d, "orders").select("o_orderkey", "o_custkey"), target, ["o_orderkey"])


@query("sync_semi_join", "SELECT e.event_id, e.user_id FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 50)", samples=False)
def sync_semi_join(spark, d):
    ev = table(spark, d, "events")
    return sets.tracks_with(ev, ev.filter("event_type = 'error' and value > 50"), ["user_id"]).select("event_id", "user_id")


DIFF_SQL = """, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY track_id, sample_index) - 1 AS place FROM s WHERE event_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY track_id, sample_index) - 1 AS place FROM s WHERE event_id % 3 = 0)
SELECT coalesce(a.file, b.file) AS file, coalesce(a.place, b.place) AS place, CASE WHEN b.place IS NULL THEN 'left_only' WHEN a.place IS NULL THEN 'right_only' ELSE 'differs' END AS status,
 a.kind AS l_kind, b.kind AS r_kind, a.description_index AS l_description_index, b.description_index AS r_description_index
FROM a {join} JOIN b ON a.file = b.file AND a.place = b.place WHERE a.place IS NULL OR b.place IS NULL OR a.kind <> b.kind OR a.description_index <> b.description_index"""


def _diff(spark, d, full):
    s = event_samples(spark, d)
    return merge.positional_diff(s.filter("event_id % 2 = 0"), s.filter("event_id % 3 = 0"), ["file"], ["track_id", "sample_index"], ["kind", "description_index"], full)


@query("positional_diff", DIFF_SQL.format(join="INNER"))
def positional_diff(spark, d):
    return _diff(spark, d, False)


@query("compare_tracks", DIFF_SQL.format(join="FULL"))
def compare_tracks(spark, d):
    return _diff(spark, d, True)


@query("edit_renumber", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem WHERE l_returnflag <> 'R'""", samples=False)
def edit_renumber(spark, d):
    left = table(spark, d, "lineitem").filter("l_returnflag <> 'R'")
    return sets.renumbered(left, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ordinal")


@query("meta_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", samples=False)
def meta_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("compact_width", "SELECT file, track_id, CASE WHEN max(size) < 256 THEN 8 WHEN max(size) < 65536 THEN 16 ELSE 32 END AS field_width, CAST(count(*) * 4 - ceil(count(*) * CASE WHEN max(size) < 256 THEN 8 WHEN max(size) < 65536 THEN 16 ELSE 32 END / 8.0) AS BIGINT) AS saved FROM s GROUP BY file, track_id")
def compact_width(spark, d):
    g = event_samples(spark, d).groupBy(*KEYS).agg(fn.field_width(F.max("size")).alias("field_width"), F.count("*").alias("n"))
    return g.select(*KEYS, "field_width", (F.col("n") * 4 - F.ceil(F.col("n") * F.col("field_width") / 8)).cast("long").alias("saved"))


@query("distinct_first", f"SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type", samples=False)
def distinct_first(spark, d):
    return sets.first_of(table(spark, d, "events"), ["user_id", "event_type"], "event_id")


@query("hash_digest", "SELECT doc_id, sha256(text) AS digest, strlen(text) AS n_bytes FROM documents", samples=False)
def hash_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("key_lookup", """SELECT o_orderkey AS track_id, o_custkey, coalesce(c.c_name, n.n_name) AS key FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0
LEFT JOIN nation n ON n.n_nationkey = o_orderkey""", samples=False)
def key_lookup(spark, d):
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), "o_custkey", F.hex("o_custkey").alias("kid"))
    by_kid = table(spark, d, "customer").filter("c_acctbal > 0").select(F.lit(None).cast("long").alias("track_id"), F.lower(F.hex("c_custkey")).alias("kid"), F.col("c_name").alias("key"))
    by_track = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("track_id"), F.lit(None).cast("string").alias("kid"), F.col("n_name").alias("key"))
    return sets.lookup_keys(tracks, by_kid.unionByName(by_track)).select("track_id", "o_custkey", "key")


@query("union_tracks", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier", samples=False)
def union_tracks(spark, d):
    return sets.union_of(customer=table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), supplier=table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("composition_times", "SELECT file, track_id, sample_index, dts + cts_delta AS cts FROM s")
def composition_times(spark, d):
    return sets.composition_times(event_samples(spark, d)).select(*KEYS, "sample_index", "cts")


@query("variant_groups", """SELECT p_partkey AS track, r_name AS "group" FROM part, region WHERE p_size % 6 = 0 OR (p_size % 6 = r_regionkey + 1)""", samples=False)
def variant_groups(spark, d):
    regions = table(spark, d, "region").select(F.col("r_name").alias("group"), "r_regionkey")
    names = regions.select(F.array_sort(F.collect_list(F.struct((F.col("r_regionkey") + 1).alias("k"), "group"))).alias("names"))
    tracks = table(spark, d, "part").crossJoin(F.broadcast(names))  # one row
    pattern = F.when(F.col("p_size") % 6 == 0, F.array(F.lit("*"))).otherwise(F.transform(F.filter("names", lambda x: x["k"] == F.col("p_size") % 6), lambda x: x["group"]))
    return merge.matches(regions.select("group"), tracks.select(F.col("p_partkey").alias("track"), pattern.alias("match")))


@query("index_override", ROLL_SQL + """, m AS (SELECT file, track_id, segment_index, segment_index * 100 + 7 AS moof_offset, duration FROM u),
e AS (SELECT file, track_id, segment_index AS entry_index, segment_index * 1000 AS time, moof_offset FROM m WHERE segment_index % 5 <> 3),
st AS (SELECT file, track_id, moof_offset, lead(moof_offset) OVER (PARTITION BY file, track_id ORDER BY entry_index) AS nxt, lead(time) OVER (PARTITION BY file, track_id ORDER BY entry_index) - time AS gap FROM e),
ow AS (SELECT *, lead(moof_offset) OVER (PARTITION BY file, track_id ORDER BY segment_index) AS aft FROM m)
SELECT ow.file, ow.track_id, ow.segment_index, ow.moof_offset, CASE WHEN st.nxt = ow.aft THEN st.gap ELSE ow.duration END AS duration FROM ow LEFT JOIN st ON st.track_id = ow.track_id AND st.moof_offset = ow.moof_offset AND st.nxt IS NOT NULL""")
def index_override(spark, d):
    m = _rolled(spark, d).select(*KEYS, "segment_index", (F.col("segment_index") * 100 + 7).alias("moof_offset"), "duration")
    e = m.filter("segment_index % 5 <> 3").select(*KEYS, F.col("segment_index").alias("entry_index"), (F.col("segment_index") * 1000).alias("time"), "moof_offset")
    return segments.override_durations(m, e).select(*KEYS, "segment_index", "moof_offset", "duration")


@query("language_codes", """SELECT p_partkey, CASE WHEN v = 32767 THEN 'und' WHEN (v >> 10) & 31 = 0 OR (v >> 5) & 31 = 0 OR v & 31 = 0 THEN '```' ELSE chr(CAST(((v >> 10) & 31) + 96 AS INTEGER)) || chr(CAST(((v >> 5) & 31) + 96 AS INTEGER)) || chr(CAST((v & 31) + 96 AS INTEGER)) END AS code
FROM (SELECT p_partkey, (p_partkey * 131) % 27000 AS v FROM part)""", samples=False)
def language_codes(spark, d):
    packed = ((F.col("p_partkey") * 131) % 27000).cast("int")
    return table(spark, d, "part").select("p_partkey", fn.language_code(packed).alias("code"))


@query("fourcc_codes", "SELECT p_partkey, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4)) AS fourcc, ((ascii(substr(c, 1, 1)) * 256 + ascii(substr(c, 2, 1))) * 256 + ascii(substr(c, 3, 1))) * 256::BIGINT + ascii(substr(c, 4, 1)) AS code FROM (SELECT p_partkey, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4)) AS c FROM part)", samples=False)
def fourcc_codes(spark, d):
    code = fn.fourcc_code(F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 4)))
    return table(spark, d, "part").select("p_partkey", code.alias("code")).select("p_partkey", fn.fourcc_text(F.col("code")).alias("fourcc"), "code")


@query("track_filter", "SELECT c_custkey, c_nationkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) WHERE k = 2 AND c_mktsegment = 'BUILDING'", samples=False)
def track_filter(spark, d):
    return sets.nth_of_kind(table(spark, d, "customer"), "BUILDING", 2, ["c_nationkey"], "c_mktsegment", "c_custkey").select("c_custkey", "c_nationkey", "c_name")


@query("track_ids", "SELECT file, track_id, count(*) AS samples FROM s WHERE track_id IN (1, 3, 8) GROUP BY file, track_id")
def track_ids(spark, d):
    return sets.tracks_of(event_samples(spark, d), [1, 3, 8]).groupBy(*KEYS).agg(F.count("*").alias("samples"))


@query("language_names", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'x-pirate' WHEN 3 THEN 'ja' ELSE 'qqq' END AS language,
CASE n_nationkey % 5 WHEN 0 THEN 'French' WHEN 1 THEN 'German' WHEN 2 THEN 'x-pirate' WHEN 3 THEN 'Japanese' ELSE 'qqq' END AS language_name FROM nation""", samples=False)
def language_names(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("fre", "deu", "eng", "jpn", "qqq")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return sets.with_language(table(spark, d, "nation").select("n_nationkey", code.alias("language")), remap={"en": "x-pirate"})


@query("threshold_segments", f""", c AS (SELECT file, track_id, 0::BIGINT AS k, sample_index, dts FROM s WHERE sample_index = 0
  UNION ALL SELECT c.file, c.track_id, c.k + 1, min(s.sample_index), arg_min(s.dts, s.sample_index) FROM c JOIN s ON s.track_id = c.track_id AND s.is_sync AND s.sample_index > c.sample_index AND s.dts - c.dts >= {DAY} GROUP BY c.file, c.track_id, c.k)
SELECT s.file, s.track_id, s.sample_index, s.dts, s.is_sync, max(c.k) AS segment_index FROM s JOIN c ON c.track_id = s.track_id AND c.sample_index <= s.sample_index GROUP BY ALL""")
def threshold_segments(spark, d):
    rows = event_samples(spark, d).select(*KEYS, "sample_index", "dts", "is_sync")
    return segments.threshold_segments(rows, DAY)


@query("bandwidth", ROLL_SQL + """, r AS (SELECT file, track_id, row_number() OVER (PARTITION BY file, track_id ORDER BY segment_index) AS k, count(*) OVER (PARTITION BY file, track_id) AS n, CAST(size AS DOUBLE) AS size, CAST(duration AS DOUBLE) / 1000000.0::DOUBLE AS seconds FROM u),
w AS (SELECT file, track_id, n, 1::BIGINT AS i, 1::BIGINT AS j, 0.0::DOUBLE AS taken, 0.0::DOUBLE AS passed, 0.0::DOUBLE AS rate FROM r WHERE k = 1
  UNION ALL SELECT x.file, x.track_id, x.n, CASE WHEN x.over OR x.j = x.n THEN x.i + 1 ELSE x.i END, CASE WHEN x.over OR x.j = x.n THEN x.i + 1 ELSE x.j + 1 END,
    CASE WHEN x.over OR x.j = x.n THEN 0.0::DOUBLE ELSE x.taken END, CASE WHEN x.over OR x.j = x.n THEN 0.0::DOUBLE ELSE x.passed END,
    CASE WHEN x.over THEN 8.0::DOUBLE * (x.taken - 3600.0::DOUBLE * x.rate / 8.0::DOUBLE) / x.passed ELSE x.rate END
  FROM (SELECT w.file, w.track_id, w.n, w.i, w.j, w.rate, w.taken + r.size AS taken, w.passed + r.seconds AS passed,
      (w.taken + r.size > 3600.0::DOUBLE * w.rate / 8.0::DOUBLE + (w.passed + r.seconds) * w.rate / 8.0::DOUBLE AND w.passed + r.seconds <> 0) AS over FROM w JOIN r ON r.track_id = w.track_id AND r.k = w.j) x)
SELECT file, track_id, CAST(trunc(rate) AS BIGINT) AS bandwidth FROM w WHERE i = n + 1""")
def bandwidth(spark, d):
    rows = _rolled(spark, d).select(*KEYS, "segment_index", "size", (F.col("duration") / TIMESCALE).alias("seconds"))
    return segments.bandwidth(rows, 3600.0)


@query("similar_rates", """, z AS (SELECT file, track_id AS ordinal, CAST(floor(0.5::DOUBLE + CAST(sum(duration) AS DOUBLE) * (1000.0::DOUBLE / 1000000.0::DOUBLE)) AS BIGINT) AS millis, sum(size) AS total FROM s GROUP BY file, track_id),
r AS (SELECT file, ordinal, CAST(CASE WHEN millis = 0 THEN 0 ELSE floor(total * 8000 / millis) END AS DOUBLE) AS bandwidth, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS k FROM z),
w AS (SELECT file, k, ordinal, bandwidth, true AS keep, [bandwidth] AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.file, r.k, r.ordinal, r.bandwidth, len(list_filter(w.kept, lambda x: x <> 0 AND abs((x - r.bandwidth) / x) < 0.1)) = 0,
    CASE WHEN len(list_filter(w.kept, lambda x: x <> 0 AND abs((x - r.bandwidth) / x) < 0.1)) = 0 THEN list_append(w.kept, r.bandwidth) ELSE w.kept END FROM w JOIN r ON r.file = w.file AND r.k = w.k + 1)
SELECT file, ordinal, bandwidth FROM w WHERE keep""")
def similar_rates(spark, d):
    rates = segments.media_scan(event_samples(spark, d), TIMESCALE).select("file", F.col("track_id").alias("ordinal"), F.col("bitrate").cast("double").alias("bandwidth"))
    return segments.drop_similar_rates(rates, ["file"])


@query("fragment_plan", f""", a AS (SELECT s.* FROM s JOIN (SELECT file, min(track_id) AS track_id FROM s GROUP BY file) USING (file, track_id)),
b AS (SELECT file, min(dts) AS lo, max(dts) AS hi FROM a GROUP BY file),
t AS (SELECT file, unnest(generate_series(0, (hi - lo) // {7 * DAY})) AS seg, lo FROM b),
c AS (SELECT t.file, a.sample_index, row_number() OVER (PARTITION BY t.file, t.seg ORDER BY abs(a.dts - lo - t.seg * {7 * DAY}), a.sample_index) AS k FROM t JOIN a ON a.file = t.file AND a.is_sync),
cut AS (SELECT DISTINCT file, sample_index FROM c WHERE k = 1),
g AS (SELECT a.file, a.sample_index, any_value(a.dts) AS dts, greatest(count(cut.sample_index) - 1, 0) AS seg FROM a LEFT JOIN cut ON cut.file = a.file AND cut.sample_index <= a.sample_index GROUP BY a.file, a.sample_index),
m AS (SELECT file, seg, min(dts) AS at FROM g GROUP BY file, seg),
p AS (SELECT s.file, s.track_id, s.sample_index, coalesce(max(m.seg), 0) AS fragment_index FROM s LEFT JOIN m ON m.file = s.file AND m.at <= s.dts GROUP BY s.file, s.track_id, s.sample_index)
SELECT file, track_id, fragment_index, min(sample_index) AS first_sample, count(*) AS sample_count FROM p GROUP BY file, track_id, fragment_index""")
def fragment_plan(spark, d):
    s = event_samples(spark, d)
    anchor = s.groupBy("file").agg(F.min("track_id").alias("track_id"))
    return segments.plan_fragments(s, 7 * 86_400, TIMESCALE, anchor)


MILLIS_SQL = SAMPLES_SQL + """, m AS (SELECT file, track_id, sample_index, dts // 1000 AS dts, coalesce(lead(dts // 1000) OVER (PARTITION BY track_id ORDER BY sample_index) - dts // 1000, 0) AS duration, size % 50 AS size, cts_delta, is_sync, dts // 1000 // 604800000 AS week FROM s)
"""


def _millis(spark, d):
    """Samples at a thousand ticks a second, small enough to be written with data."""
    w = Window.partitionBy(*KEYS).orderBy("sample_index")
    s = event_samples(spark, d).withColumn("dts", F.floor(F.col("dts") / 1000).cast("long"))
    s = s.withColumns({"duration": F.coalesce(F.lead("dts").over(w) - F.col("dts"), F.lit(0)).cast("long"), "size": F.col("size") % 50})
    return s.withColumns({"segment_index": F.floor(F.col("dts") / 604_800_000).cast("long"), "data": F.unhex(F.repeat(F.lit("A5"), F.col("size").cast("int")))})


@query("fragment_roundtrip", MILLIS_SQL + "SELECT file, track_id, sample_index, dts, duration, size, cts_delta, is_sync FROM m", samples=False)
def fragment_roundtrip(spark, d):
    """Fragments written, joined to files of one track, and read again."""
    from strobila.sources import media, writers

    out = writers.write_fragments(_millis(spark, d), 1000)
    files = writers.assemble(out, KEYS, "segment_index").select(F.concat_ws("/", "file", F.col("track_id").cast("string")).alias("path"), "content")
    found = media.file_samples(files)
    return found.select(F.split("file", "/")[0].alias("file"), "track_id", "sample_index", "dts", "duration", "size", "cts_delta", "is_sync")


@query("segment_sizes", MILLIS_SQL + "SELECT file, track_id, week AS segment_index, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS media_bytes, CAST(sum(duration) AS BIGINT) AS duration FROM m GROUP BY file, track_id, week", samples=False)
def segment_sizes(spark, d):
    """Fragments written, and their sizes and durations read from their boxes."""
    from strobila.sources import boxes, media, writers

    out = writers.write_fragments(_millis(spark, d), 1000)
    files = out.select(F.concat_ws("/", "file", F.col("track_id").cast("string"), F.col("segment_index").cast("string")).alias("path"), "content")
    found = media.file_samples(files)
    g = found.groupBy("file", "track_id").agg(F.count("*").alias("sample_count"), F.sum("size").alias("media_bytes"), F.sum("duration").alias("duration"))
    key = F.split("file", "/")
    return g.select(key[0].alias("file"), "track_id", key[2].cast("long").alias("segment_index"), "sample_count", "media_bytes", "duration")


@query("cenc_roundtrip", "SELECT doc_id, sha256(text) AS digest FROM documents", samples=False)
def cenc_roundtrip(spark, d):
    """Texts as samples through the counter mode scheme and back."""
    from strobila.operators import protection

    key = bytes(range(16))
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("iv"), F.lit(None).cast("array<struct<clear:int,encrypted:long>>").alias("parts"))
    out = protection.cipher_samples(protection.cipher_samples(rows, "cenc", key), "cenc", key, decrypt=True)
    return out.select("doc_id", F.sha2("data", 256).alias("digest"))


@query("playlist_lines", ROLL_SQL + """, g2 AS (SELECT file, track_id, segment_index, duration // 1000000 AS seconds FROM u),
l AS (SELECT file, track_id, max(seconds) AS longest FROM g2 GROUP BY file, track_id)
SELECT file, track_id, -5 AS position, '#EXTM3U' AS line FROM l UNION ALL SELECT file, track_id, -4, '#EXT-X-VERSION:3' FROM l UNION ALL SELECT file, track_id, -3, '#EXT-X-PLAYLIST-TYPE:VOD' FROM l
UNION ALL SELECT file, track_id, -2, '#EXT-X-TARGETDURATION:' || CAST(longest AS VARCHAR) FROM l UNION ALL SELECT file, track_id, -1, '#EXT-X-MEDIA-SEQUENCE:0' FROM l
UNION ALL SELECT file, track_id, segment_index * 2, '#EXTINF:' || CAST(seconds AS VARCHAR) || '.000000,' FROM g2 UNION ALL SELECT file, track_id, segment_index * 2 + 1, 'seg-' || CAST(segment_index AS VARCHAR) || '.ts' FROM g2
UNION ALL SELECT file, track_id, 4611686018427387904, '#EXT-X-ENDLIST' FROM l""")
def playlist_lines(spark, d):
    from strobila.operators.manifests import media_playlist

    rows = _rolled(spark, d).select(*KEYS, "segment_index", F.floor(F.col("duration") / TIMESCALE).cast("double").alias("seconds"))
    return media_playlist(rows, KEYS, F.format_string("seg-%d.ts", "segment_index"))


@query("scalar_formats", "SELECT doc_id, substr(hex(encode(text)), 1, 24) AS head, base64(encode(md5(text))) AS coded FROM documents", samples=False)
def scalar_formats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.hex(F.substring(F.col("text").cast("binary"), 1, 12)).alias("head"), F.base64(F.md5("text").cast("binary")).alias("coded"))


@query("windowed_rates", "SELECT file, track_id, epoch_us(date_trunc('day', make_timestamp(dts))) AS start, count(*) AS samples, CAST(sum(size) AS BIGINT) AS size FROM s GROUP BY 1, 2, 3")
def windowed_rates(spark, d):
    from strobila.streaming.live import windowed_rates as rates

    rows = event_samples(spark, d).withColumn("ts", F.timestamp_micros("dts"))
    return rates(rows).select(*KEYS, F.unix_micros("start").alias("start"), "samples", "size")


#: Orders as boxes below their customers' boxes below their nations', one file for each nation.
BOXES_SQL = """WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ci FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS oi FROM orders),
b AS (SELECT c.c_nationkey, ci, oi, o_orderkey, CAST(o_orderkey AS VARCHAR) AS body FROM c JOIN o ON c.c_custkey = o.o_custkey)
"""


def _box_files(spark, d):
    """(path, content): a file of nested boxes for each nation."""
    from strobila.sources import writers

    def boxed(kind: str, body):
        return F.concat(F.unhex(F.lpad(F.hex(F.length(body) + 8), 8, "0")), F.lit(kind.encode()), body)

    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", boxed("free", F.col("o_orderkey").cast("string").cast("binary")).alias("content"))
    traks = writers.assemble(orders, ["c_custkey"], "o_orderkey").select("c_custkey", boxed("trak", F.col("content")).alias("content"))
    own = traks.join(table(spark, d, "customer"), "c_custkey").select("c_nationkey", "c_custkey", "content")
    return writers.assemble(own, ["c_nationkey"], "c_custkey").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), boxed("moov", F.col("content")).alias("content"))


def _payload(rows):
    return rows.select("file", F.col("payload").cast("string").alias("body"), "ordinal", "size")


@query("box_tree", BOXES_SQL + """SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file, 'moov[0]/trak[' || CAST(ci AS VARCHAR) || ']/free[' || CAST(oi AS VARCHAR) || ']' AS path, oi AS ordinal, strlen(body) + 8 AS size, body FROM b""", samples=False)
def box_tree(spark, d):
    """Boxes walked: places, paths and payloads."""
    from strobila.sources import boxes

    rows = boxes.atoms(_box_files(spark, d)).filter("type = 'free'")
    return rows.select("file", "path", F.col("ordinal").cast("long").alias("ordinal"), "size", F.col("payload").cast("string").alias("body"))


@query("path_query", BOXES_SQL + "SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file, body FROM b WHERE ci = 1 AND oi = 2", samples=False)
def path_query(spark, d):
    from strobila.sources import boxes

    return _payload(boxes.find_in(_box_files(spark, d), "moov/trak[1]/free[2]")).select("file", "body")


@query("tree_edit", BOXES_SQL + """, e AS (SELECT c_nationkey, ci - 1 AS ci, CASE WHEN ci = 2 THEN oi + 1 ELSE oi END AS oi, body FROM b WHERE ci > 0
  UNION ALL SELECT c_nationkey, 1, 0, 'new' FROM b WHERE ci = 2 AND oi = 0)
SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file, 'moov[0]/trak[' || CAST(ci AS VARCHAR) || ']/free[' || CAST(oi AS VARCHAR) || ']' AS path, strlen(body) + 8 AS size, body FROM e""", samples=False)
def tree_edit(spark, d):
    """A subtree removed and a box put in, written as bytes and walked again."""
    from strobila.sources import boxes, writers

    files = _box_files(spark, d)
    trees = boxes.atoms(files)
    new = boxes.edit(trees, [("remove", "moov/trak[0]"), ("insert", "moov/trak[1]", writers.box("free", b"new"), 0)])
    again = boxes.atoms(boxes.write_tree(new, files).withColumnRenamed("file", "path")).filter("type = 'free'")
    return again.select("file", "path", "size", F.col("payload").cast("string").alias("body"))


DATA_SQL = SAMPLES_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, m AS (SELECT s.file, s.track_id, s.sample_index, coalesce(lead(s.dts // 1000) OVER w - s.dts // 1000, 0) AS duration, s.dts // 1000 - first_value(s.dts // 1000) OVER w AS dts, s.cts_delta, s.is_sync, e.event_type || e.props AS body
  FROM s JOIN events e USING (event_id) WINDOW w AS (PARTITION BY s.track_id ORDER BY s.sample_index))
"""


def _with_data(spark, d):
    """Samples at a thousand ticks a second whose data are their events' own fields."""
    w = Window.partitionBy(*KEYS).orderBy("sample_index")
    s = event_samples(spark, d).withColumn("dts", F.floor(F.col("dts") / 1000).cast("long"))
    s = s.withColumn("duration", F.coalesce(F.lead("dts").over(w) - F.col("dts"), F.lit(0)).cast("long"))
    data = table(spark, d, "events").select("event_id", F.concat("event_type", "props").cast("binary").alias("data"))
    return s.drop("size").join(data, "event_id").withColumn("size", F.length("data").cast("long"))


@query("static_roundtrip", DATA_SQL + "SELECT file, track_id, sample_index, dts, duration, cts_delta, is_sync, sha256(body) AS digest FROM m", samples=False)
def static_roundtrip(spark, d):
    """Files of sample tables and media data written, and their samples resolved and read again."""
    from strobila.operators import tools
    from strobila.sources import boxes, media, writers

    rows = _with_data(spark, d).withColumn("description_index", F.lit(1).cast("long"))
    tracks = rows.select(*KEYS).distinct()
    entry = writers.box("mp4s", bytes(6), b"\0\1")
    files = tools.mux(rows, tracks.withColumns({"handler": F.lit("vide"), "entry": F.lit(entry)}), tracks.withColumn("timescale", F.lit(1000).cast("long"))).withColumnRenamed("file", "path")
    found = media.sample_data(media.static_samples(boxes.atoms(files)), files)
    return found.select(*KEYS, "sample_index", "dts", "duration", "cts_delta", "is_sync", F.sha2("data", 256).alias("digest"))


@query("fragment_data", DATA_SQL + "SELECT file || '/' || CAST(track_id AS VARCHAR) AS file, sample_index, duration, sha256(body) AS digest FROM m", samples=False)
def fragment_data(spark, d):
    """Fragments written with their data, and the data read again from where the runs say."""
    from strobila.sources import media, writers

    rows = _with_data(spark, d).withColumn("segment_index", F.floor(F.col("dts") / 604_800_000).cast("long"))
    files = writers.assemble(writers.write_fragments(rows, 1000), KEYS, "segment_index").select(F.concat_ws("/", "file", F.col("track_id").cast("string")).alias("path"), "content")
    found = media.sample_data(media.file_samples(files), files)
    return found.select("file", "sample_index", "duration", F.sha2("data", 256).alias("digest"))


def _ciphered(scheme):
    def run(spark, d):
        """Texts as samples with a clear lead through a scheme and back, and how many bytes it left as they were."""
        from strobila.operators import protection

        key = bytes(range(16))
        data = F.col("text").cast("binary")
        clear = F.least(F.length(data), F.lit(5))
        parts = F.array(F.struct(clear.cast("int").alias("clear"), (F.length(data) - clear).cast("long").alias("encrypted")))
        rows = table(spark, d, "documents").filter("text is not null").select("doc_id", data.alias("data"), F.substring(data, 1, 5).alias("lead"), F.unhex(F.lpad(F.hex("doc_id"), 32, "0")).alias("iv"), parts.alias("parts"))
        secret = protection.cipher_samples(rows, scheme, key)
        secret = secret.withColumn("kept", F.substring("data", 1, 5) == F.col("lead"))
        out = protection.cipher_samples(secret, scheme, key, decrypt=True)
        return out.select("doc_id", "kept", F.sha2("data", 256).alias("digest"))

    return run


for _scheme in ("cenc", "cens", "cbc1", "cbcs"):
    query(f"{_scheme}_parts", "SELECT doc_id, true AS kept, sha256(text) AS digest FROM documents WHERE text IS NOT NULL", samples=False)(_ciphered(_scheme))


@query("adts_frames", DATA_SQL + "SELECT file || '/' || CAST(track_id AS VARCHAR) AS path, sample_index AS frame_index, strlen(body) + 7 AS size FROM m", samples=False)
def adts_frames(spark, d):
    """Samples exported as a stream of framed audio, and the frames found in it."""
    from strobila.functions import codecs
    from strobila.operators import tools
    from strobila.sources import writers

    framed = tools.export_aac(_with_data(spark, d), 2, 4, 2)
    files = writers.assemble(framed, KEYS, "sample_index", "data").select(F.concat_ws("/", "file", F.col("track_id").cast("string")).alias("path"), "content")
    return codecs.audio_frames(files).select("path", "frame_index", "size")


@query("unit_listing", DATA_SQL + "SELECT file, track_id, sample_index, (ascii(substr(body, 1, 1)) & 31) AS unit_type, strlen(body) AS size FROM m", samples=False)
def unit_listing(spark, d):
    """Samples of one length-prefixed unit each, and the units listed."""
    from strobila.operators import tools

    rows = _with_data(spark, d)
    rows = rows.withColumn("data", F.concat(F.unhex(F.lpad(F.hex(F.length("data")), 8, "0")), "data"))
    return tools.list_units(rows, 4).select(*KEYS, "sample_index", "unit_type", "size")


@query("fragment_seek", ROLL_SQL + """, e AS (SELECT file, track_id, segment_index * 1000 AS time, segment_index * 100 + track_id % 7 AS moof_offset FROM u),
p AS (SELECT DISTINCT file, unnest([0, 1500, 30250, 999999999]) AS time FROM s),
f AS (SELECT p.file, p.time, e.track_id, arg_max(e.moof_offset, e.time) AS spot FROM p JOIN e ON e.file = p.file AND e.time <= p.time GROUP BY p.file, p.time, e.track_id)
SELECT file, CAST(time AS BIGINT) AS probe_id, min(spot) AS moof_offset FROM f GROUP BY file, time""")
def fragment_seek(spark, d):
    entries = _rolled(spark, d).select(*KEYS, (F.col("segment_index") * 1000).alias("time"), (F.col("segment_index") * 100 + F.col("track_id") % 7).alias("moof_offset"))
    probes = event_samples(spark, d).select("file").distinct().select("file", F.explode(F.array(*[F.lit(t).cast("long") for t in (0, 1500, 30250, 999999999)])).alias("time"))
    return seek.seek_fragment(entries, probes.withColumn("probe_id", F.col("time"))).select("file", "probe_id", "moof_offset")
