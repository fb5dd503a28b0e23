"""Removal of long repeated strings by sorted suffixes, sharded so that equal strings meet.

Every window of ``length`` bytes is known by its minimizer, the smallest hashed k-gram in it, which equal windows share.
A run of windows with one minimizer is a piece of text. Equal windows also share the bytes from their minimizer to half
a window before it or after it: a side. There is one plan at all sizes, in shuffled joins on narrow rows:

1. The places of all pieces are written, counted by minimizer, and those of repeated minimizers stay. Where all pieces
   of a minimizer are one, every window of it is repeated, and there is nothing to sort.
2. Of the others, each different piece is cut out of one text. A piece that shares no side with a different one shares
   no window either and is left out, so a short line in very many contexts makes no shard.
3. The rest is dealt by side. Every shard sorts the suffixes of its pieces by external induced sorting (``induced``),
   about a megabyte at a time or a whole side, and keeps the windows that share ``length`` bytes with a neighbour.
4. The places are joined with what the shards kept, gathered for each text, and cut out.

Strings are judged on the input, matches never cross texts, and a null text is empty. Rows of one id and one text are
so many documents, and share their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.induced import repeated
from strobila.llm.store import cut, fresh, remove, table, written

_GRAM = 32
_POS = 20
_SLICE = (1 << _POS) - 1
#: Bytes of pieces whose suffixes are sorted together, at the end of a side's group.
_SORT_BYTES = 1 << 20
#: Texts of a task that are remembered, so that repeated rows are cut up once.
_SEEN = 100_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def runs(data: np.ndarray, owner_ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end, ending at ``owner_ends``: first window, windows, minimizer, content hash and place of the
    minimizer of each run."""
    n = len(data) - length + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, np.int64))
    gram = data.astype(np.uint64) + np.uint64(1)
    span, power = 1, 0x100000001B3
    while span < _GRAM:
        gram = gram[:-span] * np.uint64(power) + gram[span:]
        span, power = 2 * span, power * power % (1 << 64)
    order = _mix(gram, 7)
    low = (order & np.uint64(~_SLICE & (1 << 64) - 1)) | np.arange(len(order), dtype=np.uint64)
    width, span = length - _GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & np.uint64(_SLICE)).astype(np.int64)
    # Windows that end beyond their text.
    good = np.ones(n, bool)
    for e in owner_ends[:-1].tolist():
        good[max(0, e - length + 1) : e] = False
    head = good.copy()
    head[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
    start = np.flatnonzero(head)
    stop = good.copy()
    stop[:-1] &= (place[1:] != place[:-1]) | ~good[1:]
    windows = np.flatnonzero(stop) - start + 1
    own = _mix(gram, 11)
    s1 = np.r_[np.uint64(0), np.cumsum(own)]
    s2 = np.r_[np.uint64(0), np.cumsum(own * np.arange(len(own), dtype=np.uint64))]
    end = start + windows + length - _GRAM  # one beyond the run's last gram
    a = s1[end] - s1[start]
    b = s2[end] - s2[start] - a * start.astype(np.uint64)
    content = _mix(a ^ _mix(b, 13), 17) + windows.astype(np.uint64)
    return start, windows, order[place[start]], content, place[start] - start


def _slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts laid end to end, their ends, their rows, and how far into its text each begins.

    A text longer than a slice comes in parts that overlap by ``length - 1`` bytes, so every window is in one of them.
    """
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not column.null_count else np.asarray(column.is_valid())
    at = 0
    while at < n:
        if not valid[at] or offsets[at + 1] - offsets[at] < length:
            at += 1
            continue
        if offsets[at + 1] - offsets[at] > _SLICE:
            begin, end = int(offsets[at]), int(offsets[at + 1])
            for s in range(begin, end - length + 1, _SLICE - length + 1):
                part = data[s : min(end, s + _SLICE)]
                yield part, np.array([len(part)]), np.array([at]), np.array([s - begin])
            at += 1
            continue
        to = at
        while to < n and offsets[to + 1] - offsets[at] <= _SLICE:
            to += 1
        rows = np.arange(at, to)
        yield data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], rows, np.zeros(len(rows), np.int64)
        at = to


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, ends, rows, skipped in _slices(b.column(0), length):
            start, windows, m, content, gram = runs(data, ends, length)
            if not len(start):
                continue
            own = np.searchsorted(ends, start, "right")
            at = start - np.r_[0, ends[:-1]][own] + skipped[own]
            take = pa.array(rows[own])
            yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(m.view(np.int64)), pa.array(content.view(np.int64)), pa.array(at), pa.array(windows, pa.int32()), pa.array(gram, pa.int32())], _names(_PLACE))


_PLACE = "id long, mark long, m long, content long, at long, windows int, gram int"
_PIECE = "m long, content long, times long, windows int, left long, right long, piece binary"
_KEPT = "m long, content long, first long, last long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, mark, text, places) to pieces with hashes of their sides; a side that a piece has not whole is 0."""
    half, seen = (length - _GRAM) // 2, set()
    h = xxhash.xxh64_intdigest

    def side(part: bytes, size: int, seed: int) -> int:
        return (h(part, seed) | 1) - (1 << 63) if len(part) == size else 0

    for b in batches:
        rows = []
        for key, mark, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            if (key, mark) in seen:
                continue
            if len(seen) > _SEEN:
                seen.clear()
            seen.add((key, mark))
            text = memoryview(text.as_buffer())
            for x in places.as_py():
                piece = bytes(text[x["at"] : x["at"] + x["windows"] + length - 1])
                g = x["gram"]
                left = side(piece[max(0, g - half) : g + _GRAM], half + _GRAM, 1)
                rows.append((x["m"], x["content"], x["times"], x["windows"], left, side(piece[g : g + _GRAM + half], half + _GRAM, 2), piece))
        if rows:
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _names(_PIECE))


def _sorted_shard(batches: Iterator[pa.RecordBatch], length: int, sort_bytes: int) -> Iterator[pa.RecordBatch]:
    """(side, m, content, times, windows, piece) in order of the first three to the repeated windows of each piece, as
    runs of starts in it. Pieces that occur more than once are sorted for the sake of the others."""
    held: list[tuple[np.ndarray, ...]] = []  # m, content, times, windows, sizes, bytes
    size = 0

    def work() -> pa.RecordBatch:
        m, content, times, windows, sizes, data = (np.concatenate(c) for c in zip(*held))
        # A piece that came by both its sides must not meet itself.
        order = np.lexsort((content, m))
        once = np.ones(len(m), bool)
        once[order[1:]] = (m[order][1:] != m[order][:-1]) | (content[order][1:] != content[order][:-1])
        data = data[np.repeat(once, sizes)]
        m, content, times, windows, sizes = (c[once] for c in (m, content, times, windows, sizes))
        begins = np.cumsum(sizes + 1) - sizes - 1
        text, at = np.zeros(len(data) + len(sizes), np.uint16), 0  # 0 ends a piece
        for to, n in zip(begins.tolist(), sizes.tolist()):
            text[to : to + n] = data[at : at + n]
            text[to : to + n] += 1
            at += n
        del data
        hit = np.r_[repeated(text, length), False]
        inside = np.zeros(len(hit) + 1, np.int8)
        alone = times == 1
        np.add.at(inside, begins[alone], 1)
        np.add.at(inside, (begins + windows)[alone], -1)
        hit &= np.cumsum(inside[:-1], dtype=np.int8) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, hit].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        k = np.searchsorted(begins, first, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(m[k]), pa.array(content[k]), pa.array(first - begins[k]), pa.array(last - begins[k])], _names(_KEPT))

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        side, m, content, times, windows = (b.column(k).to_numpy() for k in range(5))
        new = np.r_[True, (side[1:] != side[:-1]) | (m[1:] != m[:-1]) | (content[1:] != content[:-1])]
        if last is not None:
            new[0] = last != (side[0], m[0], content[0])
        turn = np.r_[last is None or last[0] != side[0], side[1:] != side[:-1]]
        column = b.column(5)
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        cuts = np.flatnonzero(turn)
        for s, e in zip(np.unique(np.r_[0, cuts]), np.r_[cuts[cuts > 0], len(side)]):
            if turn[s] and size >= sort_bytes:
                yield work()
                held, size = [], 0
            k = np.arange(s, e)[new[s:e]]
            if len(k):
                sizes = ends[k + 1] - ends[k]
                at = np.repeat(ends[k] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                held.append((m[k], content[k], times[k], windows[k], sizes, data[at]))
                size += len(at)
        last = (side[-1], m[-1], content[-1])
    if held:
        yield work()


def repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", sort_bytes: int = _SORT_BYTES) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, spans, names): rows are ``docs`` with two columns, named ``names``, an id and a hash of the text; spans are
    (id, mark, spans) by the same id and hash.

    ``spans`` is an array of (first, last): every window that starts in first <= at < last of the text also starts
    elsewhere. A null doc_id counts as the least long.
    """
    if length < _GRAM:
        raise ValueError(f"repeats of fewer than {_GRAM} bytes are not sought")
    spark = docs.sparkSession
    names = [fresh("_key", docs.columns), fresh("_mark", docs.columns)]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.withColumns({names[0]: key, names[1]: F.xxhash64(F.col(text_col))})
    texts = rows.select(F.col(text_col).cast("binary").alias("text"), F.col(names[0]).alias("id"), F.col(names[1]).alias("mark"))

    # Hash joins build on the narrow side; a hint, so that the plan is the same for few rows and for many.
    places, places_path = written(texts.mapInArrow(lambda it: _places(it, length), _PLACE), "places")
    counts = places.groupBy("m").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    # What is summed by a key is written before it is joined by the key, so that the join of a hot key can be split.
    counts, counts_path = written(counts.filter("n > 1").select("m", (F.col("lo") < F.col("hi")).alias("mixed")), "counts")
    again, again_path = written(places.join(counts.hint("shuffle_hash"), "m"), "again")
    remove(spark, places_path, counts_path)
    mixed = again.filter("mixed")
    one = F.min(F.struct("id", "mark", "at", "windows", "gram")).alias("one")
    different, different_path = written(mixed.groupBy("m", "content").agg(F.count("*").alias("times"), one).select("m", "content", "times", "one.*"), "different")

    wanted = different.groupBy("id", "mark").agg(F.collect_list(F.struct("m", "content", "times", "at", "windows", "gram")).alias("places"))
    wanted, wanted_path = written(wanted, "wanted")
    fetched = texts.join(wanted.hint("shuffle_hash"), ["id", "mark"]).select("id", "mark", "text", "places")
    pieces, pieces_path = written(fetched.mapInArrow(lambda it: _cut_out(it, length), _PIECE), "pieces")
    sides = pieces.select("m", "content", F.explode(F.array("left", "right")).alias("side")).filter("side <> 0")
    met = sides.groupBy("side").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo < hi").select("side")
    met, met_path = written(met, "sides")
    live = sides.join(met.hint("shuffle_hash"), "side").distinct()
    dealt = pieces.drop("left", "right").join(live.hint("shuffle_hash"), ["m", "content"]).select("side", "m", "content", "times", "windows", "piece")
    dealt = dealt.repartition("side").sortWithinPartitions("side", "m", "content")
    found, found_path = written(dealt.mapInArrow(lambda it: _sorted_shard(it, length, sort_bytes), _KEPT), "repeated")
    remove(spark, pieces_path, wanted_path, met_path)

    many = different.filter("times > 1").select("m", "content", F.lit(0).cast("long").alias("first"), F.col("windows").cast("long").alias("last"))
    in_mixed = mixed.join(found.unionByName(many).hint("shuffle_hash"), ["m", "content"]).select("id", "mark", F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")).alias("span"))
    in_whole = again.filter("not mixed").select("id", "mark", F.struct(F.col("at").alias("first"), (F.col("at") + F.col("windows")).alias("last")).alias("span"))
    spans = cut(in_mixed.unionByName(in_whole).groupBy("id", "mark").agg(F.collect_set("span").alias("spans")), "spans")
    remove(spark, again_path, different_path, found_path)
    return rows, spans, names


def removed_runs(spans: list[dict] | None, length: int) -> np.ndarray:
    """Maximal runs [begin, end) of the bytes that the windows cover."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.array(sorted((x["first"], x["last"] - 1 + length) for x in spans), np.int64)
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.r_[True, pairs[1:, 0] > reach[:-1]]
    first = np.flatnonzero(head)
    return np.stack([pairs[first, 0], reach[np.r_[first[1:] - 1, len(pairs) - 1]]], axis=1)


def kept_bytes(text: bytes, cuts: np.ndarray) -> bytes:
    edges = np.r_[0, cuts.reshape(-1), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(text: bytes, cuts: np.ndarray) -> np.ndarray:
    """``cuts`` drawn in so that no UTF-8 character is cut apart."""
    out = []
    for a, b in cuts.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _beside(rows: DataFrame, spans: DataFrame, names: list[str], columns: list[str], spans_name: str) -> DataFrame:
    """``columns`` of rows, and the spans of each."""
    spans = spans.select(F.col("id").alias(names[0]), F.col("mark").alias(names[1]), F.col("spans").alias(spans_name))
    joined = rows.join(spans.hint("shuffle_hash"), names, "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], spans_name)


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text, by whole characters, and ``n_removed`` (long, bytes).

    A null text stays null, an empty table empty, and every row stays; other columns, whatever their names, are kept, but
    for one named ``n_removed``, which the result replaces.
    """
    rows, spans, names = repeats(docs, length, text_col=text_col)
    columns = [c for c in docs.columns if c != "n_removed"]
    joined = _beside(rows, spans, names, columns, fresh("_spans", docs.columns))
    at = columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for t, s in zip(b.column(at).cast(pa.binary()), b.column(b.num_columns - 1)):
                t = t.as_py()
                cuts = removed_runs(s.as_py(), length) if s.is_valid else np.zeros((0, 2), np.int64)
                if t is not None and len(cuts):
                    cuts = whole_characters(t, cuts)
                    t = kept_bytes(t, cuts)
                texts.append(t)
                gone.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], [*columns, "n_removed"])

    return joined.mapInArrow(work, docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("n_removed", "long"))


def op7_suffix_array_dedup(spark, sf_dir: str, length: int = 200) -> DataFrame:
    """What is removed from every document, and a digest of what stays.

    Null and empty texts have 0 bytes; equal rows each have a row of the result; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, spans, names = repeats(docs, length)
    joined = _beside(rows, spans, names, docs.columns, "_spans").withColumn("text", F.col("text").cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1), b.column(2)):
                t = t.as_py() or b""
                cuts = removed_runs(s.as_py(), length) if s.is_valid else np.zeros((0, 2), np.int64)
                out.append((len(t), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(kept_bytes(t, cuts)).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()])]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same result stated over all windows; two windows are held equal where their MD5 is.
SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS body FROM documents),
w AS (SELECT r, i, md5_number(array_slice(body, i, i + 199)::BLOB) AS h FROM (SELECT r, body, unnest(range(1, octet_length(body) - 198)) AS i FROM d WHERE octet_length(body) >= 200)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i > lag(i + 199) OVER (PARTITION BY r ORDER BY i) + 1 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS turn FROM m),
s AS (SELECT r, k, min(i) AS first, max(i) + 199 AS last FROM (SELECT r, i, sum(turn) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
e AS (SELECT r, count(*) AS n_spans, sum(last - first + 1) AS n_removed FROM s GROUP BY r),
p AS (SELECT d.r, s.first AS spot, CASE WHEN s.first IS NULL THEN hex(body) ELSE hex(array_slice(body, coalesce(lag(s.last) OVER (PARTITION BY d.r ORDER BY s.first), 0) + 1, s.first - 1)::BLOB) END AS x FROM d LEFT JOIN s ON s.r = d.r
  UNION ALL SELECT d.r, 1000000000000, hex(array_slice(body, t.last + 1, octet_length(body))::BLOB) FROM d JOIN (SELECT r, max(last) AS last FROM s GROUP BY r) t ON t.r = d.r),
k AS (SELECT r, sha256(unhex(string_agg(x, '' ORDER BY spot NULLS FIRST))) AS kept FROM p GROUP BY r)
SELECT d.doc_id, octet_length(d.body) AS n_bytes, CAST(coalesce(e.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(e.n_spans, 0) AS BIGINT) AS n_spans, k.kept AS kept_sha256 FROM d JOIN k ON k.r = d.r LEFT JOIN e ON e.r = d.r"""
