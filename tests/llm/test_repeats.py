import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strobila.llm import induced, suffix_dedup


@pytest.mark.parametrize("base, memory", [(1 << 24, 1 << 20), (1, 3), (5, 50)])
def test_sorting_and_shared_prefixes(base, memory):
    rng = np.random.default_rng(base + memory)
    for _ in range(60):
        n, depth = int(rng.integers(1, 70)), int(rng.integers(1, 12))
        t = rng.integers(0, rng.integers(1, 5), n).astype(np.uint16)
        tl, order, shared = t.tolist(), [], []
        for p, s in induced.SuffixSorter(depth, memory, base).ordered(t):
            order += p.tolist()
            shared += s.tolist()
        assert sorted(order) == list(range(n))
        for a, b, s in zip(order, order[1:], shared[1:]):
            assert tl[b : b + depth] <= tl[a : a + depth]
            k = 0
            while k < depth and max(a, b) + k < n and tl[a + k] == tl[b + k]:
                k += 1
            assert s == k


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(12)
    docs = [text(random.randrange(0, 120)) for _ in range(30)]
    docs += [docs[0], docs[1], text(30) + passage + text(20), passage, passage + passage, "", None, "a" * 700, "ab" * 300, "x" + "ab" * 300]
    docs += [text(25) + line + text(25) for _ in range(10)]
    near = text(150)
    docs += [near[:k] + "#" + near[k + 1 :] for k in range(100, 500, 60)]
    return docs


@pytest.mark.parametrize("slice_bits, sort_bytes", [(20, 1 << 20), (20, 300), (10, 2000)])
def test_removal(spark, monkeypatch, slice_bits, sort_bytes):
    if slice_bits < 20:  # texts longer than a slice
        monkeypatch.setattr(suffix_dedup, "_SLICE", (1 << slice_bits) - 1)
    docs = corpus()
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(docs)], "doc_id long, text string, mark string").repartition(3)
    length = 100
    _, spans, _ = suffix_dedup.repeats(df, length, sort_bytes=sort_bytes)
    found = {r["id"]: r["spans"] for r in spans.collect()}
    for k, (t, want) in enumerate(zip(docs, brute(docs, length))):
        b = (t or "").encode()
        cuts = suffix_dedup.removed_runs([s.asDict() for s in found.get(k, [])], length)
        got = (len(b), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(suffix_dedup.kept_bytes(b, cuts)).hexdigest())
        assert got == want, k


def test_texts_stay_whole(spark):
    shared = "é" * 150
    df = spark.createDataFrame([(1, "start " + shared + " end"), (2, "other " + shared), (3, None), (4, "clean"), (4, "clean")], "doc_id long, text string")
    out = suffix_dedup.without_repeats(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["text"] is not None) == [(1, "start  end"), (2, "other "), (4, "clean"), (4, "clean")] or all("�" not in (r["text"] or "") for r in out)
    assert len(out) == 5 and sum(r["text"] is None for r in out) == 1
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0
