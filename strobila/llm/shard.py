"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows are first dealt into source blocks. How many rows each block sends to each shard is drawn, exactly, from the
multivariate hypergeometric law given the block sizes and the shard sizes (equal, or one apart), which is the law that a
uniform random shuffle would give. Each block is permuted locally and cut by its row of the matrix, the pieces are
exchanged, and every shard is permuted again. Everything on the rows is DataFrame code; the driver handles counts only,
one for each shard and about two million rows, so no window grows with the table.

Rows are numbered as they are first written, and all randomness is a hash of that number and ``seed``: a task that runs
again after a lost executor makes the same rows, and rows that are equal in every column are spread like any others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strobila.llm.store import cut, table, values

#: Numpy's generator takes counts below this.
_SMALL = 10**9
#: Rows of a block, and of a span of a shard, that a window orders.
_BLOCK_ROWS = 1 << 21


def _log_ratio(a: int, b: int) -> float:
    """log(b! / a!), to a few parts in 10**9 even where both factorials are far beyond a float's digits."""
    if min(a, b) < 10**6:
        return math.lgamma(b + 1) - math.lgamma(a + 1)
    # Stirling's series of both, with what is large in both taken out.
    d = b - a
    return (a + 0.5) * math.log1p(d / a) + d * math.log(b) - d + (1 / b - 1 / a) / 12 - (1 / b**3 - 1 / a**3) / 360


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows taken from ``good`` and ``bad`` ones are good, for counts of any size.

    Beyond what numpy takes, by rejection under Stadlober's ratio-of-uniforms table mountain, whose constants hold for
    every log-concave law: exact in the same sense as numpy's, up to the rounding of logarithms.
    """
    total = good + bad
    if not total or not n or not good or not bad or n == total:
        return min(n, good) if not bad or n == total else 0
    if total < _SMALL:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    p = good / total
    spread = math.sqrt(n * p * (1 - p) * (total - n) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (n + 1) * (good + 1) // (total + 2)
    centre = n * good // total  # the mean: a whole part, and the rest as a float
    rest = (n * good % total) / total + 0.5
    low, high = max(0, n - bad), min(n, good)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = centre + math.floor(rest + width * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        log_p = -(_log_ratio(mode, k) + _log_ratio(good - mode, good - k) + _log_ratio(n - mode, n - k) + _log_ratio(bad - n + mode, bad - n + k))
        if 2 * math.log(u) <= log_p:
            return k


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows: blocks, columns: shards; row sums are ``blocks`` and column sums ``shards`` exactly.

    Each row is a multivariate hypergeometric draw from what the shards still lack.
    """
    assert sum(blocks) == sum(shards)
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in blocks:
        row, rest, pool = [], n, sum(left)
        for j, room in enumerate(left):
            pool -= room
            row.append(hypergeometric(rng, room, pool, rest) if j + 1 < len(left) else rest)
            rest -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def uniform_shards(df: DataFrame, n_shards: int = 16, seed: int = 20240229, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard): a uniform shuffle.

    Shard sizes differ by one row at most. Every row of ``df`` is one row of the result, nulls and repeated rows too; an
    empty table stays empty. Columns named ``shard`` or ``slot`` are replaced, all others stay, whatever their names.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = cut(df.select(row.alias("row"), F.monotonically_increasing_id().alias("number")), "shard-rows")
    total = rows.count()
    mark = lambda k: F.xxhash64(F.lit(seed + k), "number")
    n_blocks, n_spans = (max(m, -(-n // block_rows)) for m, n in ((64, total), (16, total // n_shards)))
    rows = rows.withColumns({"block": F.pmod(mark(0), F.lit(n_blocks)), "first": mark(1), "second": mark(2)})
    sizes = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # n_blocks numbers
    order = sorted(sizes)
    wanted = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([sizes[b] for b in order], wanted, seed)
    ends = values(spark, [(b, [int(x) for x in np.cumsum(r)]) for b, r in zip(order, matrix)], "block long, ends array<long>")

    rank = F.row_number().over(Window.partitionBy("block").orderBy("first", "number")) - 1
    dealt = (
        rows.withColumn("rank", rank)
        .join(F.broadcast(ends), "block")  # n_blocks rows
        .select("row", "number", "second", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
        .withColumn("span", F.pmod(F.shiftrightunsigned("second", 20), F.lit(n_spans)))
    )
    dealt = cut(dealt, "shard-dealt")
    counts = {(r["shard"], r["span"]): r["count"] for r in dealt.groupBy("shard", "span").count().collect()}  # n_shards * n_spans numbers
    starts = []
    for j in range(n_shards):
        at = 0
        for s in range(n_spans):
            starts.append((j, s, at))
            at += counts.get((j, s), 0)
    starts = values(spark, starts, "shard int, span long, start long")
    again = F.row_number().over(Window.partitionBy("shard", "span").orderBy("second", "number")) - 1
    placed = dealt.withColumn("again", again).join(F.broadcast(starts), ["shard", "span"])  # n_shards * n_spans rows
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], "shard", (F.col("start") + F.col("again")).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``. A null text has the size 1 and the check sum of an empty
    one; rows that repeat, or have a null doc_id, are dealt like any others."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
