import random
from itertools import combinations

import numpy as np
import pytest

from strobila.llm import decontaminate


def found(seeds, texts):
    parts, starts, ends = [], [], []
    for t in texts:
        starts.append(len(parts))
        parts += [seeds.words.get(w, 0) for w in t]
        ends.append(len(parts))
        parts += [0] * 9
    doc_of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(parts)]))
    return {(d, k): (at, n, same) for d, k, at, n, same in seeds.overlaps(np.array(parts), doc_of, np.array(starts), np.array(ends))}


@pytest.mark.parametrize("n", range(5, 16))
def test_every_substitution(n):
    item = [f"w{k}" for k in range(n)]
    seeds = decontaminate.SeedTable([(1, " ".join(item))])
    texts = [["a", "b"] + ["x" if k in gone else w for k, w in enumerate(item)] + ["c"] for m in range(n // 5 + 1) for gone in combinations(range(n), m)]
    got = found(seeds, texts)
    assert sorted(d for d, _ in got) == list(range(len(texts)))
    more = [["x" if k in gone else w for k, w in enumerate(item)] for gone in combinations(range(n), n // 5 + 1)]
    if n <= 13:
        assert not found(seeds, more)


def test_against_brute_force():
    random.seed(6)
    items = [(k, [f"w{random.randrange(12)}" for _ in range(random.randrange(3, 24))]) for k in range(40)]
    texts = []
    for _ in range(150):
        words = [f"w{random.randrange(16)}" for _ in range(random.randrange(30))]
        at = random.randrange(len(words) + 1)
        words[at:at] = [w if random.random() < 0.83 else f"w{random.randrange(16)}" for w in random.choice(items)[1]]
        texts.append(words)
    want = set()
    for d, t in enumerate(texts):
        for k, item in items:
            need = min(13, len(item))
            for shift in range(-len(item), len(t)):
                same = [t[shift + i] == w for i, w in enumerate(item) if 0 <= shift + i < len(t)]
                if len(item) >= 5 and any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + need, len(same) + 1)):
                    want.add((d, k))
    got = found(decontaminate.SeedTable([(k, " ".join(i)) for k, i in items]), texts)
    assert set(got) == want and len(want) > 50
    for (d, k), (at, n, same) in got.items():
        item = dict(items)[k]
        assert n >= min(13, len(item)) and 5 * same >= 4 * n
        assert any(sum(a == b for a, b in zip(texts[d][at : at + n], item[i : i + n])) == same for i in range(len(item) - n + 1))
