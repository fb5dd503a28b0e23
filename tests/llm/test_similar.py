import random

import corpus_pipeline
from strobila.llm import similar


def brute_kept(rows):
    """The smallest doc_id of each group of texts whose sets of five words in a row have a similarity of 0.8."""
    sets = {}
    for d, t in rows:
        words = t.lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    low = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                    low[a] = low[b] = min(low[a], low[b])
    return sorted(d for d in low if low[d] == d)


def texts():
    random.seed(3)
    base = [[f"w{random.randrange(4000)}" for _ in range(random.choice([6, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for d in range(110):
        words = list(random.choice(base))
        for _ in range(random.randrange(4)):
            words[random.randrange(len(words))] = f"x{random.randrange(4000)}"
        rows.append((d * 3 + 1, " ".join(words)))
    return rows


def test_near_copies_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == brute_kept(rows)


def test_settle_against_brute_force():
    rows = texts()
    sets = [similar.np.unique(similar.shingles(t.encode(), 5)) for _, t in rows]
    got = similar.settle(sets)
    assert sorted(k for g in got for k in g) == list(range(len(rows)))
    assert sorted(min(rows[k][0] for k in g) for g in got) == brute_kept(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one Two"), (4, "ONE two"), (None, "one two"), (5, "three"), (5, "four")], "doc_id long, text string")
    got = similar.similar_groups(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (3, 3), (5, 5)]
