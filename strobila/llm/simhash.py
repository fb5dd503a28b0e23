"""SimHash near-duplicates: pigeonhole blocks of the fingerprint, then verified Hamming distance.

The 64 bits are split into ``distance + 2`` blocks. Two fingerprints that differ in at most ``distance`` bits agree in at
least two blocks, so fingerprints are grouped by every pair of blocks and compared only in these groups. Equal fingerprints
count once from the start. A group reports a spanning forest of its links, not its pairs, so its output is linear in its
size, and a large group is divided again by blocks of its remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.components import connected_components
from strobila.llm.store import cut, table

#: Groups up to this size are compared pair by pair at once; larger ones are divided first.
_DIRECT = 1024
_CHUNK = 1 << 16
#: Distinct fingerprints of a pair of blocks that go to one task.
_HOT = 1 << 16


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles in their order; a shorter text is one shingle, one without words none."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and the ASCII white space x20, x09-x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.array([h(p, 42) for p in parts], np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number; 0 without words."""
    return fold(shingles(text, width))


def fold(hashes: np.ndarray) -> int:
    """SimHash of hashes: every bit that more than half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _prints(it, width), "doc_id long, fp long")


def block_masks(distance: int) -> list[int]:
    """Masks of the pairs of blocks of which a close pair must agree in at least one."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(fps: np.ndarray, distance: int, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) with i < j that span the components of distinct ``fps`` under Hamming distance.

    ``fixed``: bits in which all of them agree.
    """
    n = len(fps)
    found_a, found_b = [], []
    free = [k for k in range(64) if not fixed >> k & 1]
    if n <= _DIRECT or len(free) <= 2 * (distance + 1):
        for at in range(0, n, _DIRECT):
            for to in range(at, n, _DIRECT):
                i, j = np.nonzero(np.bitwise_count(fps[at : at + _DIRECT, None] ^ fps[None, to : to + _DIRECT]) <= distance)
                keep = i + at < j + to
                found_a.append(i[keep] + at)
                found_b.append(j[keep] + to)
                if sum(map(len, found_a)) > 4 * n + _DIRECT * _DIRECT:
                    label = _settle(n, np.concatenate(found_a), np.concatenate(found_b))
                    k = np.nonzero(label != np.arange(n))[0]
                    found_a, found_b = [label[k]], [k]
    else:
        for part in np.array_split(np.array(free), distance + 1):
            mask = sum(1 << int(k) for k in part)
            key = fps & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order])) + 1
            for own in np.split(order, edges):
                if len(own) > 1:
                    own.sort()
                    i, j = forest(fps[own], distance, fixed | mask)
                    found_a.append(own[i])
                    found_b.append(own[j])
    a = np.concatenate(found_a) if found_a else np.zeros(0, int)
    b = np.concatenate(found_b) if found_b else np.zeros(0, int)
    label = _settle(n, a, b)
    k = np.nonzero(label != np.arange(n))[0]
    return label[k], k


def _links(batches: Iterator[pa.RecordBatch], distance: int, masks: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp, rep), sorted by mask and key, to the links of each group."""
    held: list[tuple[np.ndarray, ...]] = []

    def work(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        kind, key, fp, rep = cols
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(key)]
        us, vs = [], []
        size = ends - starts
        group = np.repeat(np.arange(len(size)), size)
        small = size <= 16
        for gap in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((group[gap:] == group[:-gap]) & small[group[gap:]])
            i = i[np.bitwise_count(fp[i] ^ fp[i + gap]) <= distance]
            us.append(rep[i])
            vs.append(rep[i + gap])
        for g in np.flatnonzero(~small):
            s, e = starts[g], ends[g]
            i, j = forest(fp[s:e], distance, masks[kind[s]])
            us.append(rep[s:e][i])
            vs.append(rep[s:e][j])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cols = (cols[0], cols[1], cols[2].view(np.uint64), cols[3])
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cutoff = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
        held.append(tuple(c[:cutoff] for c in cols) if cutoff else cols)
        if cutoff:
            yield work(tuple(map(np.concatenate, zip(*held))))
            held = [tuple(c[cutoff:] for c in cols)]
    if held:
        yield work(tuple(map(np.concatenate, zip(*held))))


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def close_links(distinct: DataFrame, distance: int = 3, most: int = _HOT) -> DataFrame:
    """(fp, rep) with distinct fps to links (u, v) of the reps that span the groups of close fingerprints.

    A pair of blocks with more than ``most`` fingerprints is dealt again by parts of the bits that it leaves, one more
    than may differ, in one of which any close pair agrees too.
    """
    masks = block_masks(distance)
    finer = []
    for m in masks:
        free = [k for k in range(64) if not m >> k & 1]
        finer.append([m | sum(1 << k for k in free[len(free) * i // (distance + 1) : len(free) * (i + 1) // (distance + 1)]) for i in range(distance + 1)])
    every = masks + [f for own in finer for f in own]
    by = lambda kinds: F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(_signed(every[k])).alias("key")) for k in kinds])
    fps = distinct.filter("rep is not null").select("fp", "rep")
    dealt = fps.select("fp", "rep", F.explode(by(range(len(masks)))).alias("k")).select("k.kind", "k.key", "fp", "rep")
    # At most the rows over ``most``; written, so that the rows beside them come straight from their scan.
    hot = cut(dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("kind", "key", F.lit(True).alias("hot")), "hot")
    joined = dealt.join(hot, ["kind", "key"], "left")
    again = F.coalesce(*[F.when(F.col("kind") == k, by(range(len(masks) + k * (distance + 1), len(masks) + (k + 1) * (distance + 1)))) for k in range(len(masks))])
    parts = joined.filter("hot").select("fp", "rep", F.explode(again).alias("k")).select("k.kind", "k.key", "fp", "rep")
    dealt = joined.filter("hot is null").select("kind", "key", "fp", "rep").unionByName(parts)
    dealt = dealt.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return dealt.mapInArrow(lambda it: _links(it, distance, every), "u long, v long")


def near_groups(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id): the smallest doc_id reachable over links of close fingerprints.

    A row without doc_id takes the component of its fingerprint, null if no row with a doc_id has that fingerprint.
    """
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    comps = connected_components(close_links(distinct, distance))
    of_fp = cut(distinct.join(comps, distinct.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "fp-components")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(table(spark, sf_dir, "documents")), "prints")
    out = near_groups(prints)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
