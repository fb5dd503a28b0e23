import random
from collections import defaultdict

import numpy as np
import xxhash

from strobila.llm import components, simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(rows, distance):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, fa) in enumerate(rows):
        for b, fb in rows[:i]:
            if bin(fa ^ fb).count("1") <= distance:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in parent}


def test_fingerprints():
    for t in [None, "", "  \n", "one", "One TWO", "a b c", "É é ÀB c d e f\x0bg", "x " * 500, "word\t\tother  word again once more"]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_print(t)


def test_forest_spans_the_links():
    rng = np.random.default_rng(0)
    for trial in range(5):
        base = rng.integers(0, 2**64, 5, np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(2500)], np.uint64)
        fps = np.unique(base[rng.integers(0, 5, 2500)] ^ flips)
        a, b = simhash.forest(fps, 3)
        i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
        assert (simhash._settle(len(fps), a, b) == simhash._settle(len(fps), i, j)).all() and len(a) < len(fps)


def test_groups(spark):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(20)]
    rows = []
    for d in range(300):
        f = random.choice(base)
        for k in random.sample(range(64), random.randrange(5)):
            f ^= 1 << k
        rows.append((d * 3 + 1, f))
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    df = spark.createDataFrame(signed + [(None, signed[0][1]), (None, 12345)], "doc_id long, fp long")
    got = simhash.near_groups(df).collect()
    want = brute_groups(rows, 3)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted((r["component_id"] is None for r in got if r["doc_id"] is None)) == [False, True]
    assert len(got) == 302


def test_hot_pairs_of_blocks_are_dealt_again(spark):
    rng = random.Random(5)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 150:  # all near one fingerprint
        f = base
        for k in rng.sample(range(64), rng.randrange(0, 7)):
            f ^= 1 << k
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in rows], "fp long, rep long")
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.close_links(df, 3, most=5)).collect()}
    assert {d: got.get(d, d) for d, _ in rows} == brute_groups(rows, 3)


def test_empty(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, fp long")).count() == 0


def test_texts_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, None, 6), (2, "", 7), (3, "A b C d", 8)], "doc_id long, text string, fp long")
    got = simhash.near_groups(simhash.fingerprints(df)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (2, 2), (3, 1)]


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7, None)]
    near = defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
