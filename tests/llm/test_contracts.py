"""Every registered query of the subpackage and the pipeline, on whole small tables with odd rows, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from strobila.llm import langid, registry, token_file
from strobila.llm.simhash import _settle

SYLLABLES = {"en": "the and ing er on th re st".split(), "de": "sch ein ung ch und ß ä ge".split(), "fr": "eau le é que tre aux oi ment".split()}
INSULTS = "idiot moron scum".split()


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def make(folder, rows, labels, vectors, items):
    column = lambda values, kind: pa.array(list(values), kind)
    docs = {n: column((r[k] for r in rows), kind) for k, (n, kind) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])}
    # Columns whose names the operators could use inside.
    docs |= {c: column(["own"] * len(rows), pa.string()) for c in ("score", "_text", "_key", "_mark", "_spans", "shard", "slot", "row", "component_id")}
    pq.write_table(pa.table(docs), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": column((r[0] for r in labels), pa.int64()), "quality": column((r[1] for r in labels), pa.int32()), "toxic": column((r[2] for r in labels), pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": column((r[0] for r in items), pa.int64()), "text": column((r[1] for r in items), pa.string())}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32()), "cid": pa.array(["own"] * len(vectors), pa.string())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    items = [(k, prose(rng, "en", n)) for k, n in enumerate([30, 16, 8, 6, 3])] + [(7, None), (8, "")]
    for k in range(260):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randrange(8, 90))
        good, toxic = rng.random() < 0.6, rng.random() < 0.4
        if toxic:
            words = text.split()
            for w in INSULTS:
                words.insert(rng.randrange(len(words) + 1), w)
            text = " ".join(words)
        if not good:
            text = text.upper() + " !!! $$$ CLICK HERE"
        rows.append([k, text, lang if rng.random() < 0.9 else None, "s", len(text)])
        if rng.random() < 0.9:
            labels.append((k, int(good), int(toxic)))
    passage = prose(rng, "en", 60)
    more = [
        (300, rows[0][1]), (301, rows[0][1]), (302, rows[1][1] + " more"), (303, prose(rng, "en", 20) + " " + passage + " " + prose(rng, "en", 9)), (304, passage + passage), (305, None), (306, ""), (307, "12 34 .."),
        (308, prose(rng, "de", 9000)), (309, "ab" * 60_000), (310, "x\0y \t\n z"), (311, "😀 é " * 80), (312, prose(rng, "fr", 5) + " " + items[0][1]), (312, "a repeated id"), (None, "no id here at all, none"), (None, None),
    ]
    words = items[1][1].split()
    words[7] = "changed"
    more.append((313, prose(rng, "en", 12) + " " + " ".join(words) + " " + prose(rng, "en", 3)))
    words = items[3][1].split()
    words[2] = "changed"
    more += [(314, " ".join(words)), (315, items[4][1]), (316, rows[2][1]), (316, rows[2][1])]
    long = prose(rng, "en", 80).split()
    more += [(320 + k, " ".join(long[:k] + ["other"] + long[k + 1 :])) for k in (0, 40, 79)]
    rows += [[d, t, "en", "hot", len(t or "")] for d, t in more]
    labels += [(9999, 1, 1), (305, 1, 0), (306, 0, 0)]
    gen = np.random.default_rng(3)
    x = gen.normal(size=(40, 16)).astype(np.float32)
    x = np.concatenate([x, x[:10] + gen.normal(0, 0.05, (10, 16)).astype(np.float32), x[:5]])
    vectors = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [])]
    folder = make(tmp_path_factory.mktemp("tables"), rows, labels, vectors, items)
    return folder, rows, labels, vectors, items


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return make(tmp_path_factory.mktemp("empty"), [], [], [], [])


def run(spark, name, folder):
    out = registry.QUERIES[name](spark, folder)
    return [r.asDict() for r in out.collect()], dict(out.dtypes)


def held(doc, n, rest):
    return zlib.crc32(str(doc).encode()) % n == rest if doc is not None else None


def ids(rows):
    return Counter(r["doc_id"] if isinstance(r, dict) else r[0] for r in rows)


def test_op1(spark, tables):
    folder, rows, *_ = tables
    got, types = run(spark, "op1_sharding", folder)
    assert types == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t) + 1, zlib.crc32(t)) for d, t in raw)
    per = Counter(r["shard"] for r in got)
    assert set(per) <= set(range(16)) and max(per.values()) - min(per.get(k, 0) for k in range(16)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(per[k])) for k in per)


@pytest.mark.parametrize("name, n, rest", [("op2_quality_classifier", 3, 1), ("op8_toxicity", 5, 0)])
def test_scores(spark, tables, name, n, rest):
    folder, rows, labels, *_ = tables
    got, types = run(spark, name, folder)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert ids(got) == ids(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"], n, rest) for r in got)
    truth = {d: (q if n == 3 else t) for d, q, t in labels if d < 300}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(right) > 30 and sum(right) / len(right) > 0.85
    assert len({r["score"] for r in got if r["doc_id"] in (305, 306)}) == 1  # null like empty


def test_op4(spark, tables):
    folder, rows, *_ = tables
    got, types = run(spark, "op4_language_id", folder)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"} and ids(got) == ids(rows)
    known = {"en", "de", "fr"}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 5, 0) and r["lang_pred"] in known | {"und"}
        if r["doc_id"] is not None and r["doc_id"] != 312:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text[r["doc_id"]] or ""))
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 260 and r[2]}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.95


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def components(nodes, linked):
    """Least node that each of them reaches."""
    a = [(i, j) for i in range(len(nodes)) for j in range(i) if linked(i, j)]
    label = _settle(len(nodes), np.array([i for i, _ in a], int), np.array([j for _, j in a], int))
    low = {}
    for k, la in enumerate(label):
        low[la] = min(low.get(la, nodes[k]), nodes[k])
    return [low[la] for la in label]


def test_op5(spark, tables):
    folder, rows, *_ = tables
    got, types = run(spark, "op5_simhash_neardup", folder)
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    fps = [simhash(r[1]) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fps))
    with_id = [(r[0], f) for r, f in zip(rows, fps) if r[0] is not None]
    want = components([d for d, _ in with_id], lambda i, j: with_id[i][0] == with_id[j][0] or (with_id[i][1] ^ with_id[j][1]).bit_count() <= 3)
    assert Counter((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == Counter(zip([d for d, _ in with_id], want))


def test_op6(spark, tables):
    folder, _, _, vectors, _ = tables
    got, types = run(spark, "op6_embedding_neardup", folder)
    assert types == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    fine = [(k, np.array(v, float)) for k, v in vectors if v and np.isfinite(v).all() and np.any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in fine])
    near = u @ u.T >= 0.95
    want = {k: (int(near[i].sum()) - 1, c) for i, ((k, _), c) in enumerate(zip(fine, components([k for k, _ in fine], lambda i, j: near[i, j])))}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want | {k: (0, k) for k, _ in vectors if k not in want}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(vectors)


def removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + length, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        out.append((b, np.cumsum(gone)[: len(b)] > 0))
    return out


def test_op7(spark, tables):
    folder, rows, *_ = tables
    got, types = run(spark, "op7_suffix_array_dedup", folder)
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = Counter()
    for r, (b, gone) in zip(rows, removed([r[1] for r in rows])):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[r[0], len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def overlap(text, item):
    """Whether a stretch of 13 tokens, or of a whole shorter item of five, agrees in four fifths somewhere."""
    a, b = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    need = min(13, len(b))
    if len(b) < 5 or len(a) < need:
        return False
    code = {w: k for k, w in enumerate(dict.fromkeys(b))}
    x, y = np.array([code.get(w, -1) for w in a]), np.array([code[w] for w in b])
    for shift in range(need - len(b), len(a) - need + 1):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        same = np.r_[0, np.cumsum(x[lo + shift : hi + shift] == y[lo:hi])]
        if len(same) > need and (same[need:] - same[:-need]).max() >= 0.8 * need:
            return True
    return False


def test_op9(spark, tables):
    folder, rows, _, _, items = tables
    got, types = run(spark, "op9_decontamination", folder)
    assert types == {"doc_id": "bigint", "item_id": "bigint", "start_token": "bigint", "n_tokens": "bigint", "n_same": "bigint"}
    want = Counter((r[0], i) for r in rows for i, t in items if overlap(r[1], t))
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == want and {(312, 0), (313, 1), (314, 3)} <= set(want)


def test_op3(spark, tables):
    import public_tokenizers
    import sentencepiece

    folder, rows, *_ = tables
    got, types = run(spark, "op3_sentencepiece", folder)
    assert types == {"doc_id": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint", "round_trip": "boolean"} and all(r["round_trip"] for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    codes = [np.array(sp.encode(r[1] or ""), "<u4") for r in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(c), zlib.crc32(c.tobytes())) for r, c in zip(rows, codes))


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, *_ = tables
    got, types = run(spark, "op10_token_file", folder)
    assert types == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    whole = Tokenizer.from_file(token_file.default_tokenizer())
    codes = [np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(c), zlib.crc32(c.tobytes())) for r, c in zip(rows, codes))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()


def plain_pipeline(spark, folder, rows, items):
    """The five stages, one after the other, over all pairs of documents and all windows."""
    import public_tokenizers
    import sentencepiece

    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    found = model.predict([r[1] for r in rows])
    rows = [r for r, la, s in zip(rows, *found) if la != "und" and s >= corpus_pipeline.LEAST_CERTAIN]

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    alike = lambda i, j: rows[i][0] == rows[j][0] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4
    keep = set(components([r[0] for r in rows], alike))
    rows = [r for r in rows if r[0] in keep]
    cut = []
    for r, (b, gone) in zip(rows, removed([r[1] for r in rows])):
        # Whole characters only: a cut begins where one begins and ends where one ends.
        runs = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2)
        stay = np.ones(len(b), bool)
        for s, e in runs:
            while s < e and b[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            stay[s:e] = False
        text = np.frombuffer(b, np.uint8)[stay].tobytes().decode()
        if text.strip() or len(text.encode()) == len(b):
            cut.append((r[0], text))
    cut = [(d, t) for d, t in cut if not any(overlap(t, i) for _, i in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    return Counter((d, len(t), tuple(sp.encode(t))) for d, t in cut)


def test_pipeline(spark, tables):
    folder, rows, _, _, items = tables
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    want = plain_pipeline(spark, folder, rows, items)
    assert Counter((r["doc_id"], r["n_chars"], tuple(r["ids"])) for r in got) == want
    assert not {301, 313, 314} & {r["doc_id"] for r in got} and len(got) > 100


@pytest.mark.parametrize("name", [*registry.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert (registry.QUERIES.get(name) or corpus_pipeline.run)(spark, empty).count() == 0


def test_one_label_only(spark, tables, tmp_path):
    """Scores without, or with only one kind of, labels are defined."""
    _, rows, _, vectors, items = tables
    folder = make(tmp_path, rows[:12], [], vectors[:1], items)
    for name in ("op2_quality_classifier", "op8_toxicity"):
        assert {r["score"] for r in run(spark, name, folder)[0]} == {0.5}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got, types = run(spark, name, tables[0])
    assert sorted(names) == sorted(types)
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want.fetchall())
