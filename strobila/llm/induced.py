"""Suffix sorting by induction with disk-backed queues, and common prefixes carried along.

The text of a shard is sorted in the manner of external induced sorting. Suffixes are of type S (smaller than the one
that follows them) or L; those of type S that follow one of type L are sorted first, by naming the stretches between them
and sorting the names, recursively. Scanning in ascending order then induces the L suffixes, and in descending order the
S suffixes: a scanned suffix puts the one before it into a priority queue under its first symbol. Suffixes of one symbol
arrive in order, so the queue is a file of tuples for each symbol, held in memory up to a limit and on disk beyond.

Each tuple carries the length of the prefix that it shares with the tuple before it in the queue. An induced tuple's is
one more than the least of those between the two scanned suffixes that induced it. Lengths are exact up to ``depth`` and
capped there, and the order of suffixes is exact to ``depth`` symbols, which is all that finding repeats of that length
needs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a wave that are handled at once.
_WAVE = 1 << 16
#: Names are sorted in memory up to this many, by recursion beyond; and tuples that a queue holds in memory.
_BASE = 1 << 20
_HELD = 1 << 20


class SymbolQueue:
    """(position, shared prefix) tuples by symbol, first in first out; beyond ``memory`` tuples they go to a file."""

    def __init__(self, symbols: int, memory: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file, self.at = memory, 0, None, 0

    def push(self, symbol: int, position: np.ndarray, shared: np.ndarray) -> None:
        self.parts[symbol].append((position, shared))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for k, part in enumerate(parts):
                if len(part) == 2:
                    position, shared = part
                    where = self.file.tell()
                    self.file.write(position.astype("<i8").tobytes())
                    self.file.write(shared.astype("<i4").tobytes())
                    parts[k] = (where, len(position), None)
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of ``symbol`` so far, which leave the queue."""
        parts, self.parts[symbol] = self.parts[symbol], []
        if not parts:
            return None
        loaded = []
        for part in parts:
            if len(part) == 3:
                self.file.seek(part[0])
                position = np.frombuffer(self.file.read(8 * part[1]), "<i8")
                loaded.append((position, np.frombuffer(self.file.read(4 * part[1]), "<i4")))
            else:
                self.held -= len(part[0])
                loaded.append(part)
        if len(loaded) == 1:
            return loaded[0]
        return np.concatenate([p for p, _ in loaded]), np.concatenate([s for _, s in loaded])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _RangeMin:
    """Least value of any range of an array of up to ``_WAVE`` values."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        span = 1
        while 2 * span <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - span], last[span:]))
            span *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of x[low..high], both ends included."""
        out = np.empty(len(low), self.levels[0].dtype)
        level = np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            table = self.levels[k]
            out[m] = np.minimum(table[low[m]], table[high[m] - (1 << int(k)) + 1])
        return out


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the end of the text is smaller than every symbol."""
    n = len(text)
    up = np.zeros(n, bool)
    if n > 1:
        differ = text[:-1] != text[1:]
        at = np.where(differ, np.arange(n - 1), n - 1)
        next_differ = np.minimum.accumulate(at[::-1])[::-1]
        known = next_differ < n - 1
        i = next_differ[known]
        up[:-1][known] = text[i] < text[i + 1]
    return up


class _Words:
    """Four symbols of a text at every position as one word, for comparing suffixes; the words overlap in memory."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        padded = np.zeros(self.n + 8, "<u2")
        padded[: self.n] = text
        padded[: self.n] += 1  # 0 is beyond the end
        self.words = np.ndarray((self.n + 5,), "<u8", padded, 0, (2,))

    def shared(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(a), np.int32)
        live = np.arange(len(a))
        for at in range(0, depth, 4):
            x = self.words[np.minimum(a[live] + at, self.n)] ^ self.words[np.minimum(b[live] + at, self.n)]
            other = x != 0
            if other.any():
                y = x[other]
                same = (y & np.uint64(0xFFFF)) == 0
                for low in (0xFFFFFFFF, 0xFFFFFFFFFFFF):
                    same = same.astype(np.int32) + ((y & np.uint64(low)) == 0)
                out[live[other]] = at + same
                live = live[~other]
                if not len(live):
                    break
        out[live] = depth
        return np.minimum(out, depth)


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the prefixes that the suffixes at ``a`` and ``b`` share, up to ``depth``."""
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    n, step = len(text), 16
    for at in range(0, depth, step):
        pa, pb = a[live] + at, b[live] + at
        same = np.ones(len(live), bool)
        gain = np.zeros(len(live), np.int32)
        for k in range(min(step, depth - at)):
            ia, ib = pa + k, pb + k
            inside = (ia < n) & (ib < n)
            same &= inside & (text[np.minimum(ia, n - 1)] == text[np.minimum(ib, n - 1)])
            gain += same
            if not same.any():
                break
        out[live] += gain
        live = live[same]
        if not len(live):
            break
    return out


def _rank_by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``names`` to ``depth`` names; suffixes that agree so far have one rank."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] if h < n else 0
        tied = np.bincount(rank, minlength=n + 2)[rank] > 1
        m = np.flatnonzero(tied)
        if not len(m):
            break
        # Only ties move; a group of ties starts at its rank among all.
        key = rank[m] * np.int64(n + 2) + after[m]
        order = np.argsort(key, kind="stable")
        k = key[order]
        new_group = np.r_[True, k[1:] != k[:-1]]
        old_group = np.r_[True, (k[1:] // (n + 2)) != (k[:-1] // (n + 2))]
        place = np.arange(len(k))
        start_old = np.maximum.accumulate(np.where(old_group, place, 0))
        start_new = np.maximum.accumulate(np.where(new_group, place, 0))
        if h == 1:  # from dense ranks to ranks that leave room
            counts = np.bincount(rank, minlength=rank.max() + 1)
            rank = (np.cumsum(counts) - counts)[rank] + 1
        fresh = rank[m[order]] + (start_new - start_old)
        rank[m[order]] = fresh
        h *= 2
    return rank


class SuffixSorter:
    """Sorts the suffixes of one shard. ``memory``: tuples that each queue holds before it goes to disk."""

    def __init__(self, depth: int, memory: int = _HELD, base: int = _BASE):
        self.depth, self.memory, self.base = depth, memory, base

    def ordered(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (positions, shared prefixes) in descending order of the suffixes.

        A position's shared prefix is with the one before it in the sequence, that is with the next greater suffix.
        """
        n = len(text)
        if not n:
            return
        symbols, text = self._dense(text)
        self._words = _Words(text) if symbols < 1 << 16 else None
        up = types(text)
        star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
        stars, star_shared = self._sort_stars(text, up, star)
        yield from self._induce(text, up, symbols, stars, star_shared)

    def _compare(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._words.shared(a, b, self.depth) if self._words is not None else _shared(text, a, b, self.depth)

    @staticmethod
    def _dense(text: np.ndarray) -> tuple[int, np.ndarray]:
        if text.dtype == np.uint16:
            used = np.flatnonzero(np.bincount(text, minlength=1 << 16))
            new = np.zeros(1 << 16, np.uint16)
            new[used] = np.arange(len(used))
            return len(used), new[text]
        used, dense = np.unique(text, return_inverse=True)
        return len(used), dense.astype(np.int64)

    def _sort_stars(self, text: np.ndarray, up: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in order, and the prefixes that neighbours share."""
        if not len(star):
            return star, np.zeros(0, np.int32)
        ends = np.r_[star[1:] + 1, len(text)]
        names = self._names(text, star, ends)
        if len(star) <= self.base or names.max() + 1 == len(names):
            rank = _rank_by_doubling(names, self.depth)
        else:
            rank = np.zeros(len(star), np.int64)
            at = len(star)
            for positions, shared in SuffixSorter(self.depth, self.memory, self.base).ordered(names.astype(np.int64)):
                # Equal to the depth: one rank, or the order between them would be unfounded.
                rank[positions] = np.arange(at, at - len(positions), -1)
                at -= len(positions)
        order = np.argsort(rank, kind="stable")
        stars = star[order]
        shared = np.zeros(len(stars), np.int32)
        if len(stars) > 1:
            for at in range(1, len(stars), _WAVE):
                to = min(len(stars), at + _WAVE)
                shared[at:to] = self._compare(text, stars[at - 1 : to - 1], stars[at:to])
        return stars, shared

    @staticmethod
    def _names(text: np.ndarray, star: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Dense order-preserving names of text[star:ends], each of which ends with the next one's first symbol."""
        n = len(text)
        name = np.zeros(len(star), np.int64)
        live = np.arange(len(star))
        base = int(text.max()) + 3
        step = 3 if base**3 < 1 << 26 else 1
        span = np.int64(base**step)
        # Where one stretch is the beginning of another, its last symbol is of type S and the other's is of type L there,
        # so it is the greater one. The last stretch ends with the text, which is smaller than any symbol.
        beyond = np.full(len(star), base - 1, np.int64)
        beyond[-1] = 0
        at = 0
        while len(live):
            key = np.zeros(len(live), np.int64)
            for k in range(step):
                p = star[live] + at + k
                key = key * base + np.where(p < ends[live], text[np.minimum(p, n - 1)].astype(np.int64) + 1, beyond[live])
            key += name[live] * span
            order = np.argsort(key, kind="stable")
            live, key = live[order], key[order]
            group = key // span
            fresh_group = np.r_[True, group[1:] != group[:-1]]
            fresh = np.r_[True, key[1:] != key[:-1]]
            place = np.arange(len(order))
            start_group = np.maximum.accumulate(np.where(fresh_group, place, 0))
            start = np.maximum.accumulate(np.where(fresh, place, 0))
            name[live] = group + (start - start_group)  # places, so that later rounds have room
            at += step
            heads = np.flatnonzero(fresh)
            size = np.diff(np.r_[heads, len(order)])
            left = np.maximum.reduceat(ends[live] - star[live] - at, heads)
            live = live[np.repeat((size > 1) & (left > 0), size)]
        return np.unique(name, return_inverse=True)[1].reshape(-1).astype(np.int64)

    def _induce(self, text: np.ndarray, up: np.ndarray, symbols: int, stars: np.ndarray, star_shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, depth = len(text), self.depth
        first = text[stars].astype(np.int64) if len(stars) else np.zeros(0, np.int64)
        star_at = np.searchsorted(first, np.arange(symbols + 1))
        least = np.full(symbols, depth, np.int32)  # of the prefixes shared since the symbol was last induced
        began = np.zeros(symbols, bool)
        lower = SymbolQueue(symbols, self.memory)  # L suffixes to scan
        done = SymbolQueue(symbols, self.memory)  # L suffixes scanned, for the second pass

        def scan(position: np.ndarray, shared: np.ndarray, wanted, queue: SymbolQueue) -> None:
            """Induces from scanned suffixes; ``shared`` is with the one scanned before."""
            for s in range(0, len(position), _WAVE):
                part, low = position[s : s + _WAVE], shared[s : s + _WAVE]
                before = part - 1
                ok = before >= 0
                c = text[before].astype(np.int64)
                ok &= wanted(c, before, part)
                at = np.flatnonzero(ok)
                if len(at):
                    sym = c[at].astype(np.int32)
                    order = np.argsort(sym.astype(np.uint16) if symbols <= 1 << 16 else sym, kind="stable")
                    at, sym = at[order], sym[order]
                    head = np.r_[True, sym[1:] != sym[:-1]]
                    heads = np.flatnonzero(head)
                    start = np.r_[0, at[:-1] + 1]
                    start[heads] = 0
                    ranges = _RangeMin(low)
                    value = ranges(start, at)
                    used = sym[heads]
                    value[heads] = np.where(began[used], np.minimum(least[used], value[heads]), -1)
                    value = np.minimum(value + 1, depth).astype(np.int32)
                    np.minimum(least, low.min(), out=least)
                    tails = np.r_[heads[1:] - 1, len(at) - 1]
                    rest = at[tails] + 1
                    after = np.full(len(used), depth, np.int32)
                    more = rest < len(low)
                    if more.any():
                        after[more] = ranges(rest[more], np.full(int(more.sum()), len(low) - 1))
                    least[used] = after
                    began[used] = True
                    found = before[at]
                    for k, (a, b) in enumerate(zip(heads, np.r_[heads[1:], len(at)])):
                        queue.push(int(used[k]), found[a:b], value[a:b])
                else:
                    np.minimum(least, low.min(), out=least)

        down = lambda c, before, here: ~up[before]
        # The suffix of the last symbol alone is of type L and follows from the empty one.
        last = np.array([n - 1])
        lower.push(int(text[-1]), last, np.zeros(1, np.int32))
        began[int(text[-1])] = True
        least[:] = 0
        for c in range(symbols):
            end_of_lower = None
            while (wave := lower.take(c)) is not None:
                position, shared = wave
                done.push(c, position, shared)
                scan(position, shared, down, lower)
                end_of_lower = position[-1]
            a, b = star_at[c], star_at[c + 1]
            if a < b:
                shared = star_shared[a:b].copy()
                shared[0] = self._compare(text, np.array([end_of_lower]), stars[a : a + 1])[0] if end_of_lower is not None else 0
                scan(stars[a:b], shared, down, lower)
        lower.close()

        # Descending. A scanned tuple's value is what it shares with the one scanned before, that is the next greater.
        least[:], began[:] = 0, False
        upper = SymbolQueue(symbols, self.memory)
        rising = lambda c, before, here: up[before]
        for c in range(symbols - 1, -1, -1):
            end_of_upper = None
            while (wave := upper.take(c)) is not None:
                position, shared = wave
                yield position, shared
                scan(position, shared, rising, upper)
                end_of_upper = position[-1]
            if (wave := done.take(c)) is not None:
                # Stored ascending, each with its predecessor; turned around, each takes its successor's value.
                position, own = wave[0][::-1], wave[1][::-1]
                shared = np.r_[np.int32(0), own[:-1]].astype(np.int32)
                if end_of_upper is not None:
                    shared[0] = self._compare(text, np.array([end_of_upper]), position[:1])[0]
                yield position, shared
                scan(position, shared, rising, upper)
        upper.close()
        done.close()


def repeated(text: np.ndarray, depth: int, memory: int = _HELD, base: int = _BASE) -> np.ndarray:
    """True at every position whose first ``depth`` symbols also start elsewhere in ``text``."""
    out = np.zeros(len(text), bool)
    last = None
    for position, shared in SuffixSorter(depth, memory, base).ordered(text):
        full = shared >= depth
        out[position[full]] = True
        if last is not None and full[0]:
            out[last] = True
        out[position[:-1][full[1:]]] = True
        last = position[-1]
    return out
