"""Work on whole groups of rows, many groups at a time, so that small ones cost little and a partition never has to be held."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Work = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def changes(keys: list[pa.Array]) -> np.ndarray:
    """The rows whose key is not that of the row before, without the first row."""
    n = len(keys[0])
    out = np.zeros(max(0, n - 1), bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        out |= pc.fill_null(pc.not_equal(a, b), pa.scalar(False)).to_numpy(zero_copy_only=False)
        out |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


class Bytes:
    """Binary values one after the other, of which any stretch is taken without the single values."""

    def __init__(self, column: pa.ChunkedArray):
        if column.null_count:
            raise ValueError("a sample without data")
        chunks = [c.cast(pa.binary()) for c in column.chunks if len(c)]
        self.starts = np.cumsum([0, *map(len, chunks)]).tolist()
        self.ends = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in chunks]
        self.bytes = [memoryview(c.buffers()[2] or b"") for c in chunks]

    def _stretches(self, a: int, b: int) -> Iterator[tuple[memoryview, np.ndarray]]:
        for k in range(bisect_right(self.starts, a) - 1, len(self.ends)):
            lo, hi = max(a, self.starts[k]) - self.starts[k], min(b, self.starts[k + 1]) - self.starts[k]
            if hi <= lo:
                break
            yield self.bytes[k], self.ends[k][lo : hi + 1]

    def joined(self, a: int, b: int) -> bytes:
        return b"".join([c[e[0] : e[-1]] for c, e in self._stretches(a, b)])

    def sizes(self, a: int, b: int) -> np.ndarray:
        return np.concatenate([np.diff(e) for _, e in self._stretches(a, b)]).astype(np.int64)


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Work, schema) -> DataFrame:
    """What ``work`` (rows, bounds) yields, where ``rows`` are some whole groups of ``df``, each in ``order``, and group g is
    rows ``bounds[g]`` to ``bounds[g + 1]``. A task holds the group that it reads and the groups of one Arrow batch."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            starts = changes([rows.column(k).combine_chunks() for k in keys])
            yield from work(rows, np.concatenate([[0], starts, [rows.num_rows]]))

        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(names.index(k)) for k in keys]
            starts = changes(own)
            cut = int(starts[-1]) if len(starts) else 0 if last is not None and last != [k[0].as_py() for k in own] else -1
            if cut >= 0:
                if cut:
                    held.append(b.slice(0, cut))
                yield from done()
                held = [b.slice(cut)]
            else:
                held.append(b)
            last = [k[b.num_rows - 1].as_py() for k in own]
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
