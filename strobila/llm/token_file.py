"""Token ids in a compact binary format: a static range asymmetric numeral system in interleaved blocks.

Every text is tokenised once. The counts of all ids of the corpus make one frequency table, shared by all blocks. Texts
are put in ascending order of doc_id, and runs of whole texts make blocks. A block is coded by itself, by many
interleaved coders whose states are one numpy vector, so that a block is coded and decoded in vector steps; blocks are
coded and decoded in parallel. A block carries the ids of its texts and their lengths, its place among all ids, check
sums of its payload and of its ids, and checkpoints: coder states and stream positions from which decoding can start
inside the block.

A file is a Parquet table of blocks in ascending order, each with its header columns and its payload; the frequency
table is a table of its own beside it. So any store that Spark reads and writes will do.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobila.llm.held import held
from strobila.llm.store import new_path, table, written

#: Total of the scaled frequencies, lower bound of a coder's state, and bits that leave a state at once.
PROB_BITS = 20
LOW = 1 << 31
LANES = 1024
#: Words of a worker's cache, which starts anew beyond; and texts that the tokenizer gets at once.
_CACHE = 400_000
_ENCODE = 2_000
_CHECKPOINT = 128

# Tokenising


class WordTokens:
    """Ids of whole texts by a tokenizer file, its words looked up in a cache.

    This holds for tokenizers that fold white space, lower the case, cut a text by ``PATTERN`` and tokenise every part by
    itself, which the file must say in so many words. A text of Latin-1 characters is cut here, and each distinct part
    goes through the tokenizer once. Any other text, one with the string of a special token, and every text where the
    file says anything else goes through the tokenizer whole.
    """

    #: The tokenizer's pattern, for lower-case Latin-1 text.
    PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t\n\x0b\x0c\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    _OTHER = re.compile("[^\x00-\x1b\x20-\xff]")
    #: What a file of such a tokenizer says of its normaliser and its cutting.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUTTING = [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        about = json.loads(spec)
        suffix = about["model"].get("end_of_word_suffix") or ""
        parts = lambda x, kinds: (x or {}).get(kinds, [x])
        self.by_words = (
            parts(about.get("normalizer"), "normalizers") == self.NORMALIZERS
            and parts(about.get("pre_tokenizer"), "pretokenizers") == self.CUTTING
            and not (about.get("truncation") or about.get("padding") or about["model"].get("dropout"))
        )
        self.special = [t["content"] for t in about.get("added_tokens") or []]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), _ENCODE):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + _ENCODE], add_special_tokens=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        """Many words go through the tokenizer as one text where their ends can be told."""
        groups = [new[i : i + 64] for i in range(0, len(new), 64)]
        flats, sizes = [], []
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone = self._encode(group)
                ids, cuts = np.concatenate(alone), np.cumsum([len(i) for i in alone])
            flats.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        size = np.concatenate(sizes)
        end = len(self.flat) + np.cumsum(size)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.flat = np.concatenate([self.flat, *flats])
        self.start, self.size = np.concatenate([self.start, end - size]), np.concatenate([self.size, size])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        if len(self.words) > _CACHE:
            self._reset()
        plain = [t.decode("utf-8", "replace") for t in texts]
        whole = [k for k, t in enumerate(plain) if not self.by_words or self._OTHER.search(t) or any(x in t for x in self.special)]
        apart = dict(zip(whole, self._encode([plain[k] for k in whole])))
        cut = self.PATTERN.findall
        parts = [[] if k in apart else cut(t.lower()) for k, t in enumerate(plain)]
        new = set().union(*parts).difference(self.words)
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        counts = [len(p) for p in parts]
        at = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, sum(counts))
        start, size = self.start[at], self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return [apart[k] if k in apart else flat[a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


# Coding


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**PROB_BITS``, at least 1 wherever the count is not 0."""
    total, top = int(counts.sum()), 1 << PROB_BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.maximum((counts.astype(object) * top // total).astype(np.int64), (counts > 0).astype(np.int64))
    over = int(freq.sum()) - top
    order = np.argsort(-freq, kind="stable")
    while over:  # taken from, or given to, the most frequent
        for i in order:
            if not over:
                break
            if over > 0:
                take = min(over, int(freq[i]) // 2)
                freq[i] -= take
                over -= take
            else:
                freq[i] -= over
                over = 0
    return freq.astype(np.uint64)


class Coder:
    """The shared table, and coding of one block."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.r_[np.uint64(0), np.cumsum(self.freq)[:-1]].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload (final states, then words in decoding order) and checkpoints of a block of ids."""
        n = len(ids)
        steps = -(-n // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words, marks = [], []
        shift, low32, up = np.uint64(63 - PROB_BITS), np.uint64(0xFFFFFFFF), np.uint64(PROB_BITS)
        for t in range(steps - 1, -1, -1):
            s = ids[t * LANES : (t + 1) * LANES]
            f, c, y = self.freq[s], self.start[s], x[: len(s)]
            full = y >= (f << shift)
            out = (y[full] & low32).astype("<u4")
            y[full] >>= np.uint64(32)
            words.append(out)
            q = y // f
            x[: len(s)] = (q << up) + (y - q * f) + c
            if t and t % _CHECKPOINT == 0:
                marks.append((t, x.copy()))
        words.reverse()
        offset = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        body = np.concatenate([np.zeros(0, "<u4"), *words])
        points = b"".join(np.array([t, offset[t]], "<i8").tobytes() + states.astype("<u8").tobytes() for t, states in reversed(marks))
        return x.astype("<u8").tobytes() + body.astype("<u4").tobytes(), points

    def decode(self, payload: bytes, n: int, points: bytes = b"", first: int = 0) -> np.ndarray:
        """Ids of a block, from checkpoint number ``first`` on (0: the beginning of the block)."""
        x = np.frombuffer(payload, "<u8", LANES).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", offset=8 * LANES)
        t = at = 0
        if first:
            size = 16 + 8 * LANES
            t, at = (int(v) for v in np.frombuffer(points, "<i8", 2, (first - 1) * size))
            x = np.frombuffer(points, "<u8", LANES, (first - 1) * size + 16).astype(np.uint64)
        begin = t
        out = np.empty(max(0, n - begin * LANES), np.uint32)
        mask, up, low, half = np.uint64((1 << PROB_BITS) - 1), np.uint64(PROB_BITS), np.uint64(LOW), np.uint64(32)
        for k in range(0, len(out), LANES):
            m = min(LANES, len(out) - k)
            y = x[:m]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[k : k + m] = s
            y = self.freq[s] * (y >> up) + slot - self.start[s]
            need = np.flatnonzero(y < low)
            if len(need):
                y[need] = (y[need] << half) | words[at : at + len(need)]
                at += len(need)
            x[:m] = y
        return out


# Spark

_BLOCK_SCHEMA = "file int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary, checkpoints binary, payload_crc32 long, ids_crc32 long"


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(kind, doc_id, n_tokens, ids): for kind 0 a text's ids, packed; for kind 1 a task's counts of ids. Written out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("tokens", path), lambda: WordTokens(path))
        counts = np.zeros(max(len(tokens.ends), end_id + 1), np.int64)
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        names = ["kind", "doc_id", "n_tokens", "ids"]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = tokens.ids([t.as_py() or b"" for t in part.column(1).cast(pa.binary())])
                full = [np.append(i, np.uint32(end_id)) for i in found]
                counts += np.bincount(np.concatenate(full), minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(full), np.int32)), part.column(0), pa.array([len(i) for i in full], pa.int64()), pa.array([pack(_narrow(i)) for i in full], pa.binary())], names
                )
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([pack(counts.astype("<i8").tobytes())], pa.binary())], names)

    return written(rows.mapInArrow(work, "kind int, doc_id long, n_tokens long, ids binary"), "ids")


def _narrow(ids: np.ndarray) -> bytes:
    """A leading byte for the width, then the ids at two or four bytes each."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint32)


def _summed(rows: DataFrame) -> np.ndarray:
    """Counts of all ids: every task sums its part, and the driver the tasks' sums."""

    def work(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), "<i8")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))[total > 0]), pa.array(total[total > 0])], ["token", "n"])

    found = rows.filter("kind = 1").select("ids").mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["token"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        out[r["token"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = 1 << 18, file_tokens: int = 1 << 23) -> dict[str, str]:
    """Tokenises ``docs`` and writes blocks and table below ``path``; returns their places.

    Null texts are empty; every text ends with ``end_id``. Rows without doc_id come first; equal doc_ids keep all rows.
    """
    spark = docs.sparkSession
    rows, rows_path = tokenised(docs, tokenizer, end_id)
    counts = _summed(rows)
    freq = scaled(counts)
    shared = spark.sparkContext.broadcast(freq)  # one number for each id of the vocabulary
    n_files = int(max(1, -(-int(counts.sum()) // file_tokens)))
    texts = rows.filter("kind = 0").select("doc_id", "n_tokens", "ids")
    ordered = texts.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "ids").withColumn("file", F.spark_partition_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        held: list[np.ndarray] = []
        docs_held: list[int | None] = []
        file = block = size = 0

        def block_row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload, points = coder.encode(ids)
            row = [[file], [block], [docs_held], [[len(h) for h in held]], [len(ids)], [payload], [points], [zlib.crc32(payload)], [zlib.crc32(ids.astype("<u4").tobytes())]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["file", "block", "doc_ids", "lengths", "n_tokens", "payload", "checkpoints", "payload_crc32", "ids_crc32"])

        for b in batches:
            for doc, packed, own in zip(b.column(0), b.column(1), b.column(2)):
                held.append(_wide(packed.as_py()))
                docs_held.append(doc.as_py())
                file, size = own.as_py(), size + len(held[-1])
                if size >= block_tokens:
                    yield block_row()
                    held, docs_held, size, block = [], [], 0, block + 1
        if held:
            yield block_row()

    place = {"blocks": f"{path}/blocks", "table": f"{path}/frequencies"}
    ordered.select("doc_id", "ids", "file").mapInArrow(work, _BLOCK_SCHEMA).write.option("compression", "none").parquet(place["blocks"])
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "token long, freq long").coalesce(1).write.parquet(place["table"])
    from strobila.llm.store import remove

    remove(spark, rows_path)
    return place


def _frequencies(spark: SparkSession, place: dict[str, str]) -> np.ndarray:
    """One number for each id of the vocabulary."""
    rows = spark.read.parquet(place["table"]).collect()
    freq = np.zeros(max((r["token"] for r in rows), default=-1) + 1, np.uint64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def read_tokens(spark: SparkSession, place: dict[str, str], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the blocks; a damaged block raises an error."""
    blocks = spark.read.parquet(place["blocks"])
    shared = spark.sparkContext.broadcast(_frequencies(spark, place))
    # Where each block begins among all ids: sums by file on the driver (one number a file), by block in the file. The
    # payloads are not joined: a block is decoded where it is read, and its texts' rows get its beginning afterwards.
    sums = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()
    starts, at = [], 0
    for r in sums:
        starts.append((int(r["file"]), at))
        at += r["n"]
    own = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.select("file", "block", "n_tokens").withColumn("_in_file", F.coalesce(own, F.lit(0))).drop("n_tokens")
    file_start = spark.createDataFrame(starts, "file int, _file_start long")
    places = places.join(file_start, "file").select("file", "block", (F.col("_in_file") + F.col("_file_start")).alias("block_start"))

    schema = "file int, block int, doc_id long, begin long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        coder = Coder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                where = f"block {row['block']} of file {row['file']}"
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"{where} is damaged")
                ids = coder.decode(row["payload"], row["n_tokens"])
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"{where} decodes to other ids")
                ends = np.cumsum(row["lengths"])
                begins, n = ends - row["lengths"], len(ends)
                view = memoryview(raw)
                cols = [pa.array(np.full(n, row["file"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(begins, ends)], pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:e].astype(np.int64) for a, e in zip(begins, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    decoded = blocks.select("file", "block", "doc_ids", "lengths", "n_tokens", "payload", "payload_crc32", "ids_crc32").mapInArrow(work, schema)
    out = decoded.join(places, ["file", "block"])
    return out.select("doc_id", (F.col("block_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_block(spark: SparkSession, place: dict[str, str], file: int, block: int) -> DataFrame:
    """(part, first, ids): one block decoded from all its checkpoints at once, a task for each part between two of them."""
    blocks = spark.read.parquet(place["blocks"]).filter((F.col("file") == file) & (F.col("block") == block))
    shared = spark.sparkContext.broadcast(_frequencies(spark, place))
    parts = blocks.select("n_tokens", "payload", "checkpoints", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / (LANES * _CHECKPOINT)).cast("int"))).alias("part"))

    def work(batches):
        coder = Coder(shared.value)
        for b in batches:
            for n, payload, points, part in zip(*(c.to_pylist() for c in b.columns)):
                ids = coder.decode(payload, min(n, (part + 1) * LANES * _CHECKPOINT), points, part)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([part * LANES * _CHECKPOINT]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["part", "first", "ids"])

    return parts.repartition("part").mapInArrow(work, "part int, first long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    """All texts tokenised, written in the block format, read back and digested."""
    place = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), default_tokenizer())
    return read_tokens(spark, place)
