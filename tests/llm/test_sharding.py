import numpy as np
import pytest

from strobila.llm import shard


def test_matrix_sums_and_law():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 50, 30).tolist() + [0]
    total = sum(blocks)
    shards = [total // 7 + (j < total % 7) for j in range(7)]
    m = np.array(shard.communication_matrix(blocks, shards, 3))
    assert m.min() >= 0 and m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards
    # A cell's mean is that of the hypergeometric law.
    cells = [shard.communication_matrix([40, 60], [30, 70], s)[0][0] for s in range(3000)]
    assert abs(np.mean(cells) - 12) < 0.3 and abs(np.var(cells) - 100 / 99 * 40 * 0.3 * 0.7 * 0.6) < 0.7


def test_large_counts_keep_their_sums():
    blocks, shards = [3 * 10**9, 2 * 10**9, 7], [10**9, 4 * 10**9 + 7]
    m = np.array(shard.communication_matrix(blocks, shards, 1), dtype=object)
    assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and min(m.flatten()) >= 0


def test_draws_of_any_size():
    rng = np.random.default_rng(2)
    for good, bad, n in ((6 * 10**9, 4 * 10**9, 10**9), (10**10, 10**10, 15 * 10**9), (300, 10**10, 10**9), (10**12, 10**13, 10**12)):
        x = np.array([shard.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
        p, total = good / (good + bad), good + bad
        sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
        assert abs(x.mean() - n * p) < 4 * sd / 4000**0.5 and abs(x.std() / sd - 1) < 0.06
        assert abs(((x - n * p) / sd < 1).mean() - 0.8413) < 0.03
    assert shard.hypergeometric(rng, 0, 5, 3) == 0 and shard.hypergeometric(rng, 5, 0, 3) == 3 and shard.hypergeometric(rng, 4, 6, 10) == 4


def test_rejection_gives_the_exact_law(monkeypatch):
    """Where the law can be written down, by the path that large counts take."""
    from math import comb

    monkeypatch.setattr(shard, "_SMALL", 0)
    rng = np.random.default_rng(3)
    for good, bad, n in ((7, 12, 5), (30, 20, 40), (3, 3, 3)):
        x = np.bincount([shard.hypergeometric(rng, good, bad, n) for _ in range(20000)], minlength=n + 1) / 20000
        law = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(n + 1)])
        assert np.abs(x - law).max() < 0.015


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, size long, note string")


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_shards(spark, n):
    df = rows(spark, [(k if k % 10 else None, k % 3, None if k % 7 == 0 else "x") for k in range(n)] + [(7, 7, "same")] * (5 if n else 0))
    df = df.withColumn("block", df.doc_id).withColumn("row", df.size).withColumn("slot", df.note)
    out = shard.uniform_shards(df, n_shards=4, block_rows=16).toPandas()
    assert sorted(map(str, out[["doc_id", "size", "note", "block", "row"]].itertuples(index=False))) == sorted(map(str, df.toPandas()[["doc_id", "size", "note", "block", "row"]].itertuples(index=False)))
    if n:
        counts = out.groupby("shard").size().reindex(range(4), fill_value=0)
        assert counts.max() - counts.min() <= 1
        for _, part in out.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))


def test_equal_rows_are_spread(spark):
    out = shard.uniform_shards(rows(spark, [(1, 1, "same")] * 3000), n_shards=4, block_rows=100).toPandas()
    assert out.groupby("shard").size().tolist() == [750] * 4


def test_shuffle_is_repeatable_and_mixes(spark):
    df = rows(spark, [(k, 0, "") for k in range(2000)]).repartition(3, "doc_id")
    a, b = (shard.uniform_shards(x, n_shards=4, block_rows=100).toPandas().sort_values("doc_id") for x in (df, df))
    assert a["shard"].tolist() == b["shard"].tolist() and a["slot"].tolist() == b["slot"].tolist()
    first = a[a["doc_id"] < 500]["shard"].value_counts()
    assert first.min() > 80  # near 125 each
    assert abs(np.corrcoef(a["doc_id"], a["slot"])[0, 1]) < 0.1
