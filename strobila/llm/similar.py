"""Near copies by the Jaccard similarity of their word shingles, every link verified on the texts.

Candidates come from close SimHash fingerprints and from MinHash bands: texts of similarity ``s`` share a band with
probability ``1 - (1 - s**ROWS)**BANDS``, all but 1.4e-7 at 0.8, where SimHash alone would have to admit some ten bits and
more. Candidates that hang together meet in one task, which counts the shared shingles of all of them and links those that
are similar enough, so a candidate costs time and is never a result. Texts with equal shingles count once from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.components import connected_components
from strobila.llm.simhash import close_links, fold, shingles
from strobila.llm.store import cut

WIDTH = 5
#: Similar enough: NUMER / DENOM of the shingles of both, as integers, so that nothing is rounded.
NUMER, DENOM = 4, 5
BANDS, ROWS = 30, 4
_CHUNK = 1 << 12

_rng = np.random.default_rng(5)
_STEP = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes: equal where ROWS of its minima are."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), _CHUNK):
        low = np.minimum(low, ((own[at : at + _CHUNK] ^ _SALT[:, None]) * _STEP[:, None]).min(1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, fps, keys = [], [], []
        for t in b.column(1).cast(pa.binary()):
            found = shingles(t.as_py(), WIDTH)
            own = np.unique(found)
            same.append(xxhash.xxh3_128_digest(own.tobytes()))
            fps.append(fold(found) if len(found) else 0)
            keys.append(bands(own).view(np.int64))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
        fps = pa.array(np.array(fps, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), fps, lists], ["doc_id", "same", "fp", "bands"])


def settle(sets: list[np.ndarray]) -> list[list[int]]:
    """Groups of the places of ``sets``, sorted distinct hashes, that links of enough similarity hold together.

    From each set all those are reached that are similar to it and not reached before, so near copies leave at once.
    """
    size = np.array([len(s) for s in sets])
    value, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    held, word = owner[order], flat[order]
    first = np.searchsorted(word, np.arange(len(value) + 1))
    alive, n_held, left = np.ones(len(sets), bool), len(sets), len(sets)
    out = []
    for k in range(len(sets)):
        if not alive[k]:
            continue
        alive[k] = False
        left -= 1
        group = [k]
        for x in group:  # grows
            if not left:
                break
            if left * 2 < n_held:
                stay = alive[held]
                held, word, n_held = held[stay], word[stay], left
                first = np.searchsorted(word, np.arange(len(value) + 1))
            own = flat[ends[x] - size[x] : ends[x]]
            n = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(held[at], minlength=len(sets))
            close = np.flatnonzero(alive & (shared > 0) & ((NUMER + DENOM) * shared >= NUMER * (size + size[x])))
            alive[close] = False
            left -= len(close)
            group += close.tolist()
        out.append(group)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (candidates, doc_id, text), sorted by the first, to (u, v): each doc_id with the smallest one of its group."""

    def work(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        groups = settle(sets)
        one = {}  # rows of one doc_id are one document
        for g in groups:
            low = min(ids[k] for k in g)
            for k in g:
                one.setdefault(ids[k], low)
                if one[ids[k]] != low:
                    yield max(one[ids[k]], low), min(one[ids[k]], low)
                if ids[k] != low:
                    yield ids[k], low

    def groups() -> Iterator[tuple[int, int]]:
        last, ids, sets = None, [], []
        for b in batches:
            for c, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                if c != last and ids:
                    yield from work(ids, sets)
                    ids, sets = [], []
                last = c
                ids.append(d)
                sets.append(np.unique(shingles(t.as_py(), WIDTH)))
        if ids:
            yield from work(ids, sets)

    found = np.array(list(chain.from_iterable(groups())), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, component_id) for every doc_id that is the smallest of those with its shingles.

    ``component_id`` is the smallest doc_id reachable over links of texts whose shingles have a Jaccard similarity of
    ``NUMER / DENOM`` at least. Rows without doc_id do not appear.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sketches = docs.mapInArrow(_sketches, "doc_id long, same binary, fp long, bands array<long>")
    sets = sketches.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    sets = cut(sets.select("rep", "fp", "bands"), "sets")
    by_fp = cut(sets.groupBy("fp").agg(F.min("rep").alias("rep")), "fingerprints")
    equal = sets.select("fp", F.col("rep").alias("u")).join(by_fp, "fp").filter("u != rep").select("u", F.col("rep").alias("v"))
    dealt = sets.select(F.col("rep").alias("u"), F.explode("bands").alias("key"))
    heads = dealt.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    banded = dealt.join(heads, "key").filter("u != v").select("u", "v")
    met = connected_components(close_links(by_fp).unionByName(equal).unionByName(banded))
    # A hint, so that few rows and many have one plan; ids are the side that is built.
    rows = docs.join(met.hint("shuffle_hash"), docs.doc_id == met.node).select("component", "doc_id", "text")
    links = rows.repartition("component").sortWithinPartitions("component").mapInArrow(_verified, "u long, v long")
    comps = connected_components(links)
    reps = sets.select("rep").distinct()
    return reps.join(comps, reps.rep == comps.node, "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("component_id"))
