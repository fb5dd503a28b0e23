import random
import zlib

import numpy as np
import pytest

from strobila.llm import decontaminate, sentencepiece_fst, token_file

STRANGE = ["", " ", "   ", "a", "  two  spaces ", "x" * 300, "é ß ñ Ç", "日本語 text 😀", "tab\tline\n\nend ", "▁ under ▁▁x", "\x00\x1c\x85\xa0", "It's DON'T we'll 3½ ²", "é combined", "<|endoftext|> <s>", "!!! ### ... ,,", " " * 40 + "x", "İstanbul ΣΑΣ"]


def texts():
    random.seed(7)
    words = ["the", "ing", "tion", "er", "sch", "ó", "Haus", "que", ",", ".", "12", "  "]
    return STRANGE + [" ".join("".join(random.choice(words) for _ in range(random.randrange(1, 5))) for _ in range(60)) for _ in range(60)]


def test_pieces_equal_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    with open(sentencepiece_fst.default_model(), "rb") as f:
        model = sentencepiece_fst.PieceTransducer(f.read())
    for t in texts():
        ids = model.encode(t)
        assert ids == sp.encode(t), t
        assert model.decode(ids) == t.replace("▁", " ")
    assert model.encode(None) == [] and model.decode([]) == ""


def test_unigram_path_is_shortest():
    import struct

    def message(*fields):
        out = b""
        for k, v in fields:
            if isinstance(v, float):
                out += bytes([k << 3 | 5]) + struct.pack("<f", v)
            elif isinstance(v, int):
                out += bytes([k << 3, v])
            else:
                out += bytes([k << 3 | 2, len(v)]) + v
        return out

    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "bb": -3.2, "▁ab": -7.0}
    model = sentencepiece_fst.PieceTransducer(message((1, message((1, b"<unk>"), (3, 2))), *[(1, message((1, p.encode()), (2, s))) for p, s in pieces.items()], (2, message((3, 1)))))

    def best(t):
        if not t:
            return 0.0
        return max((s + best(t[len(p) :]) for p, s in pieces.items() if t.startswith(p)), default=-1e9)

    for t in ("▁ab", "▁abb", "▁aabbb", "▁ba"):
        assert abs(sum(pieces[p] for p in model.path(t)) - best(t)) < 1e-6


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate([*STRANGE, None])], "doc_id long, text string, ids int")
    out = sentencepiece_fst.encode(df)
    assert out.filter("round_trip").count() == len(STRANGE) + 1
    back = {r["doc_id"]: r["decoded"] for r in sentencepiece_fst.decode(out).collect()}
    assert all(back[k] == t.replace("▁", " ") for k, t in enumerate(STRANGE)) and back[len(STRANGE)] == ""


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = token_file.default_tokenizer()
    own, whole = token_file.WordTokens(path), Tokenizer.from_file(path)
    assert own.by_words
    for got, t in zip(own.ids([t.encode() for t in texts()]), texts()):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_another_tokenizer_takes_texts_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(token_file.default_tokenizer(), encoding="utf-8").read())
    spec["normalizer"] = None  # upper case counts now
    (tmp_path / "t.json").write_text(json.dumps(spec))
    own, whole = token_file.WordTokens(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not own.by_words
    for got, t in zip(own.ids([t.encode() for t in texts()]), texts()):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_a_block_from_all_its_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(k, " ".join(f"w{k * j % 977}" for j in range(3000))) for k in range(60)], "doc_id long, text string")
    place = token_file.write_tokens(df, f"file://{tmp_path}/t", token_file.default_tokenizer(), block_tokens=1 << 30)
    parts = token_file.read_block(spark, place, 0, 0).orderBy("part").collect()
    assert len(parts) > 2 and [r["first"] for r in parts] == [k * token_file.LANES * token_file._CHECKPOINT for k in range(len(parts))]
    whole = [i for r in token_file.read_tokens(spark, place, with_ids=True).orderBy("start").collect() for i in r["ids"]]
    assert [i for r in parts for i in r["ids"]] == whole


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000, 400_000])
def test_coder(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 999).astype(np.uint32)
    coder = token_file.Coder(token_file.scaled(np.bincount(np.r_[ids, 3], minlength=1000)))
    payload, points = coder.encode(ids)
    assert (coder.decode(payload, n) == ids).all()
    step = token_file.LANES * token_file._CHECKPOINT
    for k in range(1, n // step + 1):
        if k * step < n:
            assert (coder.decode(payload, n, points, first=k) == ids[k * step :]).all()
    if n > 100_000:
        p = np.bincount(ids) / n
        assert len(payload) < 1.05 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 + 8 * token_file.LANES


def test_scaled_keeps_every_symbol():
    freq = token_file.scaled(np.array([10**12, 1, 0, 5]))
    assert freq.sum() == 1 << token_file.PROB_BITS and freq[1] >= 1 and freq[2] == 0


def test_files(spark, tmp_path):
    rows = [(k * 2, t) for k, t in enumerate(texts())] + [(4, "again"), (None, "no id"), (9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    place = token_file.write_tokens(df, f"file://{tmp_path}/t", token_file.default_tokenizer(), block_tokens=300, file_tokens=1000)
    got = token_file.read_tokens(spark, place, with_ids=True).orderBy("start").collect()
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(token_file.default_tokenizer()), 0
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((d or -1, whole.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    place = token_file.write_tokens(df, f"file://{tmp_path}/t", token_file.default_tokenizer())
    spark.read.parquet(place["blocks"]).withColumn("payload", F.expr("concat(payload, X'00')")).write.parquet(f"file://{tmp_path}/u")
    with pytest.raises(Exception, match="damaged"):
        token_file.read_tokens(spark, place | {"blocks": f"file://{tmp_path}/u"}).collect()


def test_leaks(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 20, 13, 8, 3])] + [(9, None), (10, "")]
    swap = lambda t, every: " ".join("other" if i % every == every - 1 else w for i, w in enumerate(t.split()))
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (0, noise(50) + " " + items[0][1] + " " + noise(20)), (1, items[1][1].upper().replace(" ", ", ")), (2, noise(5) + " " + swap(items[0][1], 6)), (3, noise(200)),
        (4, noise(9) + " " + items[2][1]), (5, items[3][1]), (6, items[4][1]), (7, None), (8, ""), (9, " ".join(items[0][1].split()[:10]) + " " + noise(30)), (10, " ".join(items[0][1].split()[5:19])),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 0), (4, 2), (5, 3), (10, 0)}
    assert found[0, 0]["start_token"] == 50 and found[0, 0]["n_tokens"] == 40 and found[10, 0]["n_tokens"] == 14
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()) == [3, 6, 7, 8, 9]
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0


def test_seeds_tolerate_two_replacements():
    from itertools import combinations

    mask = decontaminate.MASKS[0]
    for gone in combinations(range(13), 2):
        assert any(all(o + p not in gone for p in mask) for o in range(13 - mask[-1]))
