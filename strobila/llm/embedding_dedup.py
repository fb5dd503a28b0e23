"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. Vectors are rotated at random and split
into blocks of a few dimensions. The squared distance is the sum over the blocks, so in at least one block a close pair
is within the block's proportional share of it. Every block is range-joined on a grid: a vector has one home cell, and
probes the cells within reach. Cells begin with two coordinates of the block; a cell with many vectors at home is divided
by two more, and again, until all coordinates of the block are used, so a vector's rows grow far slower than the cells'
vectors. Candidates of a cell are found by block distance and verified exactly, by the cosine in double precision.

A pair meets once in a block, in the greater of its two cells, and counts in the first block that finds it. What comes to
a task is bounded: homes and probes of a cell are dealt into parts that are joined one with one. Equal vectors are one
class from the start. A task reports each vector's number of links and a spanning forest of them, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.components import connected_components
from strobila.llm.simhash import _settle
from strobila.llm.store import cut, table

#: Distances, and candidates, that are held at once.
_TILE = 1 << 22
_PAIRS = 1 << 16
#: Least and greatest number of vectors at home, and of probes, that meet in a task; between the two it is a third of all
#: vectors, so that few vectors are dealt evenly and many make no more rows each.
_LEAST, _MOST = 4096, 65536
#: Coordinates by which a cell is divided at a time.
_AXES = 2


def _mix(key: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    key = (key ^ np.asarray(x, np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return key ^ key >> np.uint64(29)


class Subspaces:
    """Rotation, blocks and grid for vectors of one dimension. ``crowded``: keys of the cells that are divided, in order."""

    def __init__(self, dim: int, cosine: float, crowded: np.ndarray | None = None, width: int = 8, seed: int = 6):
        self.dim, self.cosine = dim, cosine
        self.crowded = np.zeros(0, np.uint64) if crowded is None else crowded
        self.rotation = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]
        n = max(1, dim // width)
        self.cuts = [dim * k // n for k in range(n + 1)]
        self.budget = np.array([(2 - 2 * cosine) * (b - a) / dim for a, b in zip(self.cuts, self.cuts[1:])])
        self.reach = np.sqrt(np.maximum(self.budget, 0)) * (1 + 1e-9) + 1e-12

    def rotated(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.sqrt((x**2).sum(1, keepdims=True))
        return unit @ self.rotation

    def _steps(self, block: int) -> Iterator[tuple[int, int]]:
        a, b = self.cuts[block], self.cuts[block + 1]
        return ((s, min(b, s + _AXES)) for s in range(a, b, _AXES))

    def _first(self, n: int, block: int) -> np.ndarray:
        return np.repeat(_mix(_mix(np.ones(1, np.uint64), self.dim), block), n)

    def divided(self, key: np.ndarray) -> np.ndarray:
        if not len(self.crowded):
            return np.zeros(len(key), bool)
        return self.crowded[np.minimum(np.searchsorted(self.crowded, key), len(self.crowded) - 1)] == key

    def homes(self, y: np.ndarray, block: int) -> np.ndarray:
        """The cell of every row."""
        key, own = self._first(len(y), block), np.arange(len(y))
        for a, b in self._steps(block):
            cell = np.floor(y[own, a:b] / (2 * self.reach[block])).astype(np.int64)
            k = key[own]
            for c in cell.T:
                k = _mix(k, c)
            key[own] = k
            own = own[self.divided(k)]
            if not len(own):
                break
        return key

    def probes(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for all cells greater than a row's own that hold a point within reach of it."""
        r = self.reach[block]
        own = self.homes(y, block)
        row, key, spent = np.arange(len(y)), self._first(len(y), block), np.zeros(len(y))
        rows, keys = [], []
        for a, b in self._steps(block):
            part = y[row, a:b]
            cell = np.floor(part / (2 * r)).astype(np.int64)
            gaps = {-1: part - cell * (2 * r), 0: np.zeros_like(part), 1: (cell + 1) * (2 * r) - part}
            found = []
            for move in product((-1, 0, 1), repeat=b - a):
                far = spent + sum(gaps[m][:, k] ** 2 for k, m in enumerate(move))
                near = np.flatnonzero(far <= r * r * (1 + 1e-9) + 1e-12)
                k = key[near]
                for c, m in enumerate(move):
                    k = _mix(k, cell[near, c] + m)
                found.append((row[near], k, far[near]))
            row, key, spent = (np.concatenate(x) for x in zip(*found))
            on = self.divided(key)
            if b == self.cuts[block + 1]:
                on[:] = False
            rows.append(row[~on])
            keys.append(key[~on])
            row, key, spent = row[on], key[on], spent[on]
            if not len(row):
                break
        row, key = np.concatenate(rows), np.concatenate(keys)
        after = key > own[row]
        return row[after], key[after]


def _by_dim(raw: list[bytes], kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1)
        yield x.shape[1], at, x.astype(np.float64)


def _count(batches, cosine: float, crowded: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """(cell, homes, probes) of a batch."""
    for b in batches:
        for d, _, x in _by_dim(b.column(0).to_pylist(), kind):
            s = Subspaces(d, cosine, crowded)
            y = s.rotated(x)
            for block in range(len(s.budget)):
                home, (_, probe) = s.homes(y, block), s.probes(y, block)
                cell, at = np.unique(np.r_[home, probe], return_inverse=True)
                n_home = np.bincount(at[: len(home)], minlength=len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n_home), pa.array(np.bincount(at, minlength=len(cell)) - n_home)], ["cell", "homes", "probes"])


class Parts:
    """Into how many parts the homes and the probes of a cell are dealt; one and one for cells that are not named."""

    def __init__(self, cells: np.ndarray, homes: np.ndarray, probes: np.ndarray):
        order = np.argsort(cells)
        self.cells = np.r_[cells[order], np.uint64(0)][: max(1, len(cells))]
        self.homes = np.r_[homes[order], 1][: max(1, len(cells))]
        self.probes = np.r_[probes[order], 1][: max(1, len(cells))]

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.cells, key), len(self.cells) - 1)
        named = self.cells[at] == key
        return np.where(named, self.homes[at], 1), np.where(named, self.probes[at], 1)


_DEALT = "cell long, home_part int, probe_part int, role int, dim int, block int, cid long, n long, v binary"


def _deal(batches, cosine: float, crowded: np.ndarray, parts: Parts, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (role 0 for homes, 1 for probes) of each vector in each block."""
    names = [c.split()[0] for c in _DEALT.split(", ")]

    def times(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each index n times, and a counter from 0 for each."""
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    for b in batches:
        for start in range(0, b.num_rows, 1000):
            piece = b.slice(start, 1000)
            cids = piece.column(0).to_numpy()
            for d, own, x in _by_dim(piece.column(2).to_pylist(), kind):
                s = Subspaces(d, cosine, crowded)
                y = s.rotated(x)
                lot = _mix(np.full(len(own), 7, np.uint64), cids[own])
                for block in range(len(s.budget)):
                    home = s.homes(y, block)
                    in_homes, in_probes = parts(home)
                    home_part = (lot % in_homes.astype(np.uint64)).astype(np.int64)
                    probe_part = (_mix(lot, 1) % in_probes.astype(np.uint64)).astype(np.int64)
                    at, k = times(in_probes)
                    out = [(at, home[at], home_part[at], k, np.zeros(len(at), np.int64))]
                    # To the later parts of its own cell a home comes as a probe.
                    at, k = times(in_homes - 1 - home_part)
                    out.append((at, home[at], home_part[at] + 1 + k, probe_part[at], np.ones(len(at), np.int64)))
                    row, cell = s.probes(y, block)
                    in_homes, in_probes = parts(cell)
                    probe_part = (_mix(lot[row], 1) % in_probes.astype(np.uint64)).astype(np.int64)
                    at, k = times(in_homes)
                    out.append((row[at], cell[at], k, probe_part[at], np.ones(len(at), np.int64)))
                    row, cell, hp, pp, role = (np.concatenate(c) for c in zip(*out))
                    take = pa.array(own[row])
                    ints = lambda c: pa.array(c, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), ints(hp), ints(pp), ints(role), ints(np.full(len(row), d)), ints(np.full(len(row), block)), piece.column(0).take(take), piece.column(1).take(take), piece.column(2).take(take)], names)


class _Cell:
    """The vectors at home in a part of a cell, the links found so far, and a forest of them."""

    def __init__(self, dim: int, block: int, cosine: float):
        self.s, self.block = Subspaces(dim, cosine), block
        self.held: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add(self, cid, n, x) -> None:
        self.held.append((cid, n, x))

    def _prepare(self) -> None:
        self.cid, self.n, self.x = (np.concatenate(c) for c in zip(*self.held))
        self.held = []
        self.y = self.s.rotated(self.x.astype(np.float64))
        part = self._part(self.y)
        # One product of these rows with those of probes is the squared distance.
        self.wide = np.c_[-2 * part, (part**2).sum(1), np.ones(len(part), np.float32)].astype(np.float32)
        self.sums = np.zeros(len(part), np.int64)
        self.label = np.arange(len(part))
        self.tile = max(16, _TILE // max(1, len(part)))
        self.ready = True

    def _part(self, y: np.ndarray) -> np.ndarray:
        return y[:, self.s.cuts[self.block] : self.s.cuts[self.block + 1]].astype(np.float32)

    def _pairs(self, x: np.ndarray, y: np.ndarray, above: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(home, row) of the links of some rows; with ``above`` the rows are homes from there on, each with later ones."""
        s, block = self.s, self.block
        b = s.cuts[block + 1]
        budget = s.budget * (1 + 1e-9) + 1e-12
        own = self._part(y)
        own = np.c_[own, np.ones(len(own), np.float32), (own**2).sum(1)].astype(np.float32)
        i, j = np.nonzero(self.wide[above or 0 :] @ own.T <= np.float32(budget[block] + 1e-5))
        if above is not None:
            later = i > j
            i, j = i[later] + above, j[later]
        good = np.zeros(len(i), bool)
        for c in range(0, len(i), _PAIRS):
            p, q = i[c : c + _PAIRS], j[c : c + _PAIRS]
            by_block = np.add.reduceat((self.y[p, :b] - y[q, :b]) ** 2, s.cuts[: block + 1], axis=1)
            ok = by_block[:, block] <= budget[block]
            ok &= ~(by_block[:, :block] <= budget[:block]).any(1)  # an earlier block counts it
            k = np.flatnonzero(ok)
            u, v = self.x[p[k]].astype(np.float64), x[q[k]].astype(np.float64)
            cos = (u * v).sum(1) / (np.sqrt((u**2).sum(1)) * np.sqrt((v**2).sum(1)))
            good[c + k[cos >= s.cosine]] = True
        return i[good], j[good]

    def _joined(self, a: np.ndarray, b: np.ndarray, cids: np.ndarray, others: bool) -> Iterator[pa.RecordBatch]:
        """The links that join trees: of homes ``a`` with homes ``b``, or with ``others`` with rows whose ids are ``cids``."""
        left = self.label[a]
        homes, at = np.unique(left if others else np.r_[left, self.label[b]], return_inverse=True)
        m = len(homes)
        if others:
            rows, to = np.unique(b, return_inverse=True)
            ids, ends = np.r_[self.cid[homes], cids[rows]], (at, m + to)
        else:
            ids, ends = self.cid[homes], (at[: len(a)], at[len(a) :])
        low = _settle(len(ids), *ends)
        tree = np.flatnonzero(low != np.arange(len(ids)))
        moved = tree[tree < m]
        if len(moved):
            to = np.arange(len(self.label))
            to[homes[moved]] = homes[low[moved]]
            self.label = to[self.label]
        yield _found(ids[tree], ids[low[tree]], None)

    def among(self) -> Iterator[pa.RecordBatch]:
        """Links of homes with homes."""
        if not self.ready:
            self._prepare()
        for at in range(0, len(self.cid), self.tile):
            i, j = self._pairs(self.x[at : at + self.tile], self.y[at : at + self.tile], at)
            if len(i):
                j = j + at
                self.sums += np.bincount(i, self.n[j], len(self.sums)).astype(np.int64) + np.bincount(j, self.n[i], len(self.sums)).astype(np.int64)
                yield from self._joined(i, j, self.cid, False)

    def links(self, cid, n, x) -> Iterator[pa.RecordBatch]:
        """Links of homes with probes."""
        if not self.ready:
            self._prepare()
        y = self.s.rotated(x.astype(np.float64))
        for at in range(0, len(cid), self.tile):
            own = slice(at, at + self.tile)
            i, j = self._pairs(x[own], y[own])
            if len(i):
                self.sums += np.bincount(i, n[own][j], len(self.sums)).astype(np.int64)
                sums = np.bincount(j, self.n[i], len(cid[own])).astype(np.int64)
                some = np.flatnonzero(sums)
                yield _found(cid[own][some], None, sums[some])
                yield from self._joined(i, j, cid[own], True)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.ready and (some := np.flatnonzero(self.sums)).size:
            yield _found(self.cid[some], None, self.sums[some])


def _found(u: np.ndarray, v: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    """A link of the forest with null n, or with null v the links of u that were found in a place."""
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), none if v is None else pa.array(v), none if n is None else pa.array(n)], ["u", "v", "n"])


def _join(batches, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, parts and role, homes first."""
    key, cell, fresh = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(8)]
        turn = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:6]], axis=0)]
        starts = np.flatnonzero(turn)
        for s, e in zip(starts, np.r_[starts[1:], b.num_rows]):
            now = (*(int(c[s]) for c in cols[:3]), int(cols[4][s]), int(cols[5][s]))
            if now != key:
                if cell is not None:
                    if fresh:
                        yield from cell.among()
                    yield from cell.close()
                key, cell, fresh = now, None, False
            x = np.frombuffer(b"".join(b.column(8).slice(s, e - s).to_pylist()), kind).reshape(e - s, -1)
            if cols[3][s] == 0:
                if cell is None:
                    cell, fresh = _Cell(now[3], now[4], cosine), now[2] == 0  # homes meet each other in one part of the probes
                cell.add(cols[6][s:e], cols[7][s:e], x)
            elif cell is not None:
                if fresh:
                    yield from cell.among()
                    fresh = False
                yield from cell.links(cols[6][s:e], cols[7][s:e], x)
    if cell is not None:
        if fresh:
            yield from cell.among()
        yield from cell.close()


def _grid(bare: DataFrame, cosine: float, most: int, kind: str) -> tuple[np.ndarray, Parts]:
    """The cells that are divided, and the parts of those that stay crowded. Only cells with more than ``most`` rows come
    to the driver, a number that is the vectors' rows over ``most`` at the highest."""
    crowded = np.zeros(0, np.uint64)
    while True:
        counts = bare.select("v").mapInArrow(lambda it, c=crowded: _count(it, cosine, c, kind), "cell long, homes long, probes long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("probes").alias("probes"))
        rows = counts.filter((F.col("homes") > most) | (F.col("probes") > most)).collect()
        cells, homes, probes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        cells = cells.view(np.uint64)
        again = np.union1d(crowded, cells[homes > most])
        if len(again) == len(crowded):  # those that have no more coordinates stay as they are
            return crowded, Parts(cells, np.maximum(1, -(-homes // most)), np.maximum(1, -(-probes // most)))
        crowded = again


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", most: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``, whose other columns are not read.

    Null, empty or zero vectors, and those with a null or non-finite component, link with nothing; nor do vectors of
    different dimensions. Vectors of floats are compared as they are, others as doubles. Rows without id link with
    nothing; such a row is its own component, null, and is kept. Rows that repeat an id each link by their own vector;
    ``component_id`` is the least id reached. ``most``: vectors at home, and probes, that meet in a task, by default a
    third of the vectors between 4,096 and 65,536; the result is the same.
    """
    vec = F.col("v")
    single = df.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(cast).alias("v"))
    fine = F.coalesce(vec.isNotNull() & F.col("vec_id").isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(vec, lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    classes = rows.filter("fine").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")

    if most is None:
        most = min(_MOST, max(_LEAST, classes.count() // 3))

    def packed(batches):
        for b in batches:
            lists = b.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            if not single and len(values):  # by a power of two, so that no square overflows and no digit is lost
                _, power = np.frexp(np.maximum.reduceat(np.abs(values), cuts[:-1]))
                values = np.ldexp(values, -np.repeat(power, np.diff(cuts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([values[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())], ["cid", "n", "v"])

    bare = classes.select("cid", "n", "v").mapInArrow(packed, "cid long, n long, v binary")
    crowded, parts = _grid(bare, cosine, most, kind)
    dealt = bare.mapInArrow(lambda it: _deal(it, cosine, crowded, parts, kind), _DEALT)
    key = ["cell", "home_part", "probe_part"]
    found = cut(dealt.repartition(*key).sortWithinPartitions(*key, "dim", "block", "role").mapInArrow(lambda it: _join(it, cosine, kind), "u long, v long, n long"), "vector-links")
    links = found.filter("n is not null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.filter("v is not null").select("u", "v")).withColumnRenamed("node", "cid")
    reps = comps.join(classes.select("cid", "rep"), "cid")
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = classes.join(links, "cid", "left").join(comps.join(least, "component").select("cid", "least"), "cid", "left")
    of_class = cut(of_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "vector-classes")
    good = rows.filter("fine").join(of_class, "v").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same result stated over all pairs, for tables whose ids do not repeat.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(low) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
