"""Benchmark decontamination by spaced seeds.

A seed reads the tokens of a window at the positions of a fixed mask and ignores the others, so it still matches where an
ignored token was replaced. The seeds of the benchmark are joined with those of every text by their hash. Around every
hit the text and the item are laid side by side, and the longest stretch in which at least ``similarity`` of the tokens
agree is measured. A stretch of ``least`` tokens, or a whole shorter item of five tokens at least, is a leak; its first and
last tokens may be replaced ones.

Any two replaced tokens in a window of 13 leave a hit of the first mask. Items of 5 to 11 tokens have masks of their own, so
that every fifth token of an item of any length can be replaced, wherever they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.langid import slices
from strobila.llm.store import table

#: Positions that each mask reads.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 4, 8), (0, 1, 2, 3, 4))
#: The masks of items of so many tokens, where one or two replaced tokens could leave no hit of those above.
SHORT_MASKS = {
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 3, 4),),
    **dict.fromkeys((8, 9, 10, 11), (*MASKS, (0, 1, 2, 4, 5))),
}
_ALL = tuple(dict.fromkeys((*MASKS, *(m for own in SHORT_MASKS.values() for m in own))))
_WORD = re.compile(r"\w+")
_BITS = 22


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class SeedTable:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], least: int = 13, similarity: float = 0.8, shortest: int = 5):
        self.least, self.similarity, self.shortest = least, similarity, shortest
        words: dict[str, int] = {}
        self.ids, self.items = [], []
        for item, text in sorted(items, key=lambda x: x[0]):
            found = [words.setdefault(w, len(words) + 1) for w in tokens(text)]
            if len(found) >= shortest:
                self.ids.append(item)
                self.items.append(np.array(found, np.int64))
        self.words = words
        rng = np.random.default_rng(9)
        self.noise = rng.integers(1, 2**63, len(words) + 1, np.uint64)
        self.steps = rng.integers(1, 2**62, 5, np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks: set[tuple[int, ...]] = set()
        hashes, owner, place = [], [], []
        for k, item in enumerate(self.items):
            for mask in SHORT_MASKS.get(len(item), MASKS):
                at, h = self._seeds(item, mask, _ALL.index(mask))
                self.masks.add(mask)
                hashes.append(h)
                owner.append(np.full(len(at), k))
                place.append(at)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _seeds(self, ids: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``ids`` in which no read token is 0."""
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        good = ids[mask[0] : mask[0] + n] > 0
        for p in mask[1:]:
            good = good & (ids[p : p + n] > 0)
        at = np.flatnonzero(good)
        h = np.full(len(at), salt + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for p, step in zip(mask, self.steps):
            h = (h ^ self.noise[ids[at + p]]) * step
            h ^= h >> np.uint64(29)
        return at, h

    def overlaps(self, text: np.ndarray, doc_of: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first token, tokens, agreeing tokens) of the leaks in documents laid end to end."""
        lines: set[tuple[int, int, int]] = set()
        for mask in sorted(self.masks):
            at, h = self._seeds(text, mask, _ALL.index(mask))
            near = self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[near], h[near]
            low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
            full = high > low
            at, low, high = at[full], low[full], high[full]
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                for k in range(a, b):
                    lines.add((int(doc_of[p]), int(self.owner[k]), p - int(self.place[k])))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, shift in lines:
            item = self.items[k]
            lo, hi = max(0, int(starts[doc]) - shift), min(len(item), int(ends[doc]) - shift)
            need = min(self.least, len(item))
            if hi - lo < need:
                continue
            same = item[lo:hi] == text[shift + lo : shift + hi]
            if same.sum() < self.similarity * need - 1e-9:
                continue
            run = self.longest(same)
            if run is None or run[1] < need:
                run = self.longest_loose(same)
                if run[1] < need:
                    continue
            # Of equally good places the first.
            found = (run[1], run[2], -int(shift + lo + run[0] - starts[doc]))
            best[doc, k] = max(found, best.get((doc, k), found))
        return [(doc, self.ids[k], -at, size, same) for (doc, k), (size, same, at) in sorted(best.items())]

    def longest(self, same: np.ndarray) -> tuple[int, int, int] | None:
        """Start, length and agreeing tokens of the longest stretch that begins and ends in agreement and agrees enough."""
        hits = np.flatnonzero(same)
        if not len(hits):
            return None
        # Stretch i..j of hits: (j - i + 1) agree of hits[j] - hits[i] + 1.
        rank = np.arange(len(hits))
        gain = rank - self.similarity * hits
        low = np.minimum.accumulate(gain)
        best = (0, 0, 0)
        for j in range(len(hits)):
            # The earliest i with gain[i] <= gain[j] + 1 - similarity: low falls, so bisect on it.
            bound = gain[j] + 1 - self.similarity + 1e-9
            i = int(np.searchsorted(-low, -bound))
            while i <= j and gain[i] > bound:
                i += 1
            if i <= j and hits[j] - hits[i] + 1 > best[1]:
                best = (int(hits[i]), int(hits[j] - hits[i] + 1), j - i + 1)
        return best if best[1] else None

    def longest_loose(self, same: np.ndarray) -> tuple[int, int, int]:
        """Start, length and agreeing tokens of the longest stretch that agrees enough, whatever its ends do."""
        count = np.r_[0, np.cumsum(same)]
        gain = count - self.similarity * np.arange(len(count))
        first = np.searchsorted(-np.minimum.accumulate(gain), -(gain + 1e-9))
        size = np.arange(len(count)) - first
        j = int(size.argmax())
        return int(first[j]), int(size[j]), int(count[j] - count[first[j]])


_WIDEST = max(m[-1] for m in _ALL)


def _found(texts: list[str | None], seeds: SeedTable) -> Iterator[tuple[int, int, int, int, int]]:
    """(place in ``texts``, item, first token, tokens, agreeing tokens) of all leaks."""
    get = seeds.words.get
    for s, e in slices(texts):
        parts, starts, ends, at = [], [], [], 0
        for t in texts[s:e]:
            found = [get(w, 0) for w in tokens(t)]
            starts.append(at)
            ends.append(at + len(found))
            parts += found
            parts += [0] * (_WIDEST + 1)  # no window crosses
            at = len(parts)
        flat = np.array(parts, np.int64)
        doc_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, at]))
        for d, *rest in seeds.overlaps(flat, doc_of, np.array(starts), np.array(ends)):
            yield s + d, *rest


def _scan(batches: Iterator[pa.RecordBatch], seeds: SeedTable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(b.column(0)[k].as_py(), *rest) for k, *rest in _found(b.column(1).to_pylist(), seeds)]
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_token", "n_tokens", "n_same"])


def _clean(batches: Iterator[pa.RecordBatch], seeds: SeedTable, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        keep[[k for k, *_ in _found(b.column(at).to_pylist(), seeds)]] = False
        yield b.filter(pa.array(keep))


def blocks_of(benchmark: DataFrame, most_rows: int = 50_000, most_bytes: int = 1 << 25) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most_rows`` and ``most_bytes`` of text: one at a time comes to the driver and is
    broadcast, so a large benchmark takes more scans of the texts and no more memory."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id is not null and text is not null")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-total // most_rows), -(-size // most_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **blocks) -> DataFrame:
    """Every (doc_id, item_id) with its longest overlap: start_token, n_tokens, n_same; of equally long ones that with the
    most agreeing tokens, then the first.

    Null and empty texts and items, and items of fewer than five tokens, overlap with nothing; empty tables give no rows.
    Repeated rows of ``docs`` appear as often as they occur, a row without doc_id with a null one. Other columns of either
    table are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in blocks_of(benchmark, **blocks):
        shared = spark.sparkContext.broadcast(SeedTable(items, least, similarity))  # a bounded block of items
        found = rows.mapInArrow(lambda it, shared=shared: _scan(it, shared.value), "doc_id long, item_id long, start_token long, n_tokens long, n_same long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 13, similarity: float = 0.8, text_col: str = "text", **blocks) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their doc_id: rows are judged where they are read."""
    at = docs.columns.index(text_col)
    for items in blocks_of(benchmark, **blocks):
        shared = docs.sparkSession.sparkContext.broadcast(SeedTable(items, least, similarity))  # a bounded block of items
        docs = docs.mapInArrow(lambda it, shared=shared: _clean(it, shared.value, at), docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the place; clean documents do not appear."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
