import random

import numpy as np

from strobila.llm import langid, quality, toxicity

SYLLABLES = {"en": "the and ing er on th re".split(), "de": "sch ein ung ch und ß ä".split(), "fr": "eau le é que tre aux oi".split()}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    model = langid.BackoffModel([(text(la, 80, rng), la) for la in SYLLABLES for _ in range(15)])
    rows = [(k, text(la, 12, rng), la) for k, la in enumerate(list(SYLLABLES) * 10)]
    df = spark.createDataFrame(rows + [(100, None, "en"), (101, "", None), (102, "12 .. 7", "de"), (103, "😀", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.detect(df, model).collect()}
    assert all(got[k]["lang_pred"] == la for k, _, la in rows)
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (100, 101, 102, 103)] == [("und", 0.0)] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.detect(df.limit(0), model).count() == 0


def test_words_come_before_grams():
    model = langid.BackoffModel([("haus haus maus", "de"), ("house house mouse", "en")])
    assert model.word("haus").argmax() == 0 and model.word("houses").argmax() == 1
    assert len(model.word("zzzz")) == 2
    assert langid.BackoffModel([]).predict(["a", None])[0] == ["und", "und"]


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: text("en", 150, rng).encode()
    bad = lambda: " ".join(w.upper() + "!!" for w in text("en", 150, rng).split()).encode()
    model = quality.CompressionModel([good() for _ in range(60)], [bad() for _ in range(60)])
    p, q = model.score([good() for _ in range(40)]), model.score([bad() for _ in range(40)])
    assert p.min() > q.max() and p.mean() > 0.8 and q.mean() < 0.2
    df = spark.createDataFrame([(1, good().decode(), 9.0), (2, None, 9.0), (3, "", 9.0), (4, "a" * 100000, 9.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["score"] == got[3]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def pairs(label, n=1500, seed=6):
    rng, out = random.Random(seed), []
    filler = [f"w{k}" for k in range(60)]
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        out.append((" ".join([rng.choice(filler) for _ in range(10)] + ["insult"] * a + ["group"] * b), int(label(a, b))))
    return out


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_pairs_that_a_linear_model_misses(spark):
    data = pairs(lambda a, b: a and b)
    model = toxicity.FactorizationMachine().fit([t for t, _ in data], [y for _, y in data])
    model.calibrate([t for t, _ in data], [y for _, y in data])
    both, one, other, none = model.score(["w1 insult group", "w1 insult", "w2 group", "w3"])
    assert both > 0.9 and max(one, other, none) < 0.1
    df = spark.createDataFrame([(1, "insult group", 0.5), (2, None, 0.5), (3, "", 0.5), (3, "", 0.5), (4, "insult w1 group " * 50_000, 0.5)], "doc_id long, text string, _text double")
    got = sorted((r["doc_id"], r["predicted"], r["score"], r["_text"]) for r in toxicity.score(df, model).collect())
    assert [r[:2] for r in got] == [(1, 1), (2, 0), (3, 0), (3, 0), (4, 1)] and got[1][2] == got[2][2] == got[3][2] and {r[3] for r in got} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_pairs_of_which_neither_term_tells_anything():
    data, rest = pairs(lambda a, b: a != b), pairs(lambda a, b: a != b, 500, 7)
    model = toxicity.FactorizationMachine().fit([t for t, _ in data], [y for _, y in data])
    assert auc(model.raw([t for t, _ in rest]), [y for _, y in rest]) > 0.95
    i, j = (model.index[model._terms_of(w)[0]] for w in ("insult", "group"))
    assert model.v[i] @ model.v[j] < -0.5  # the pair itself carries weight


def test_missing_labels():
    for texts, y, want in (([], [], 0.5), (["a b"] * 8, [1] * 8, 0.9), (["a b"] * 8, [0] * 8, 0.1)):
        model = toxicity.FactorizationMachine().fit(texts, y).calibrate(texts, y)
        assert model.score(["a", None, ""]).tolist() == [want] * 3
    for good, bad, want in ((0, 0, 0.5), (8, 0, 0.9), (0, 8, 0.1)):
        assert quality.CompressionModel([b"a text"] * good, [b"bad"] * bad).score([b"", b"x"]).tolist() == [want] * 2


def test_sample_has_every_label(spark):
    """A label of many rows, one of few, one whose texts are all long; ids that repeat count once."""
    from strobila.llm.sampling import labelled_sample

    rows = [(k, f"text {k}", "a") for k in range(2000)] + [(5000 + k, f"few {k}", "b") for k in range(10)] + [(7000 + k, "é" * 9000, "c") for k in range(500)] + [(1, "text 1", "a")] * 50
    rows += [(None, "x", "a"), (9000, None, "a"), (9001, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = labelled_sample(df.filter("text is not null"), df, "lang", 300, 1000, 1)
    n = {la: sum(r["lang"] == la for r in found) for la in "abc"}
    assert len(found) == 300 and n["b"] == 10 and min(n["a"], n["c"]) > 110 and len({r["doc_id"] for r in found}) == 300
    assert max(len(r["text"].encode()) for r in found) <= 1000 and {len(r["text"]) for r in found if r["lang"] == "c"} == {250}
    again = labelled_sample(df.repartition(2).filter("text is not null"), df, "lang", 300, 1000, 1)
    assert [r["doc_id"] for r in again] == [r["doc_id"] for r in found]
    # The same law at any count: the place in the order is a hash times the count, which a long holds exactly enough.
    assert labelled_sample(df.limit(0), df, "lang", 300, 1000, 1) == []


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    w = quality.fit_logistic(x, y.astype(float))
    assert abs(w[0] - 2) < 0.25 and abs(w[1] + 1) < 0.2
