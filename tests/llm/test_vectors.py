import numpy as np

from strobila.llm import embedding_dedup
from strobila.llm.simhash import _settle


def brute(x, ids, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = _settle(len(x), *np.nonzero(near))
    return near.sum(1), [ids[k] for k in label]


def test_links_and_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([centres[rng.integers(0, 12, 250)] + rng.normal(size=(250, 32)) * rng.choice([0.05, 0.2, 0.35], (250, 1)), rng.normal(size=(60, 32))]).astype(np.float32)
    x[20:40] = x[20]
    x[41] = 2 * x[20]
    ids = list(range(100, 100 + len(x)))
    odd = [(1, None), (2, [0.0] * 32), (3, [float("nan")] * 32), (4, [1.0, None] * 16), (5, [float("inf")] * 32), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0] * 32)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + odd, "vec_id long, embedding array<float>").repartition(3)
    for most in (8192, 40, 9):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, most=most).collect()}
        links, groups = brute(x.astype(float), ids, 0.95)
        assert [got[i]["n_links"] for i in ids] == links.tolist()
        assert [got[i]["component_id"] for i in ids] == groups
        assert [(got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) for k in range(1, 7)] == [(0, k, True) for k in range(1, 7)]
        assert (got[7]["n_links"], got[8]["component_id"], got[8]["kept"]) == (1, 7, False)
        assert got[None]["n_links"] == 0 and got[None]["kept"]


def test_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_doubles_and_repeated_ids(spark):
    near = [1.0, 1e-9] + [0.0] * 6
    rows = [(1, [1.0] + [0.0] * 7), (1, [0.0, 1.0] + [0.0] * 6), (2, near), (3, [1e300, 1e300] + [0.0] * 6), (4, [1.0, 1.0] + [0.0] * 6), (0, [0.0, 2.0] + [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(df, cosine=1 - 1e-12).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert {c for c in embedding_dedup.near_vectors(df).columns} == {"vec_id", "n_links", "component_id", "kept"}


def test_rows_a_vector_stay_even(spark):
    """What is dealt grows no faster than the vectors while cells have room."""
    rng = np.random.default_rng(4)
    s = embedding_dedup.Subspaces(64, 0.95)
    per = []
    for n in (5_000, 20_000):
        y = s.rotated(rng.normal(size=(n, 64)))
        per.append(sum(len(s.probes(y, b)[0]) + n for b in range(len(s.budget))) / n)
    assert per[1] < 1.1 * per[0] < 40
