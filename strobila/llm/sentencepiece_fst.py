"""SentencePiece encoding as a shortest path in a composed weighted transducer, and decoding.

A model file is compiled into a normaliser, a lexicon transducer (a trie whose accepting states emit piece ids) and byte
fallback arcs for characters without a piece. An input is composed with them on the fly and its segmentation is the
shortest path over the tropical semiring (minimum, plus).

A unigram model weighs each piece arc by its negated score. In a BPE model the scores are merge priorities, so their sum
says nothing; there the transducer is composed with a bigram acceptor that gives weight 0 to two pieces that merging
leaves side by side, and infinite weight to two pieces that it would have merged across. One path of finite weight
remains, and it is what merging by priority makes.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strobila.llm.held import held
from strobila.llm.store import table

SPACE = "▁"
_INF = float("inf")
#: Entries of a worker's caches, which start anew beyond; longer stretches are segmented anew each time.
_CACHE = 200_000
_KEEP = 48

#: Fixed values of the model file's format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceTransducer:
    """A compiled model: ``encode`` and ``decode`` of one text."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                charsmap = norm.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity character map are compiled")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.cost = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        self.dear = 10 + max(self.cost.values(), default=0) if self.kind == UNIGRAM else 0.0
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        # The same lexicon as a matcher that reads an input once and gives every piece where it ends.
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, p)
        if self.ids:
            self.matcher.make_automaton()
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.spans_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.encode() for p, _, t in self.pieces]
        self._spines: dict[str, tuple | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._emits: dict[str, tuple[int, ...]] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    # The bigram acceptor of a BPE model.

    def _spine(self, piece: str) -> tuple | None:
        """The tokens at the left and at the right end of ``piece`` while merging builds it, each with the priority that
        ends it; None if merging alone does not build it."""
        if piece in self._spines:
            return self._spines[piece]
        parts = list(piece)
        left, right = [], []
        queue = [(self.cost[a + b], k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.cost]
        heapq.heapify(queue)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        while queue:
            cost, k, whole = heapq.heappop(queue)
            n = after[k]
            if parts[k] is None or n >= len(parts) or parts[n] is None or parts[k] + parts[n] != whole:
                continue
            if k == 0:
                left.append((parts[k], cost))
            if after[n] >= len(parts):
                right.append((parts[n], cost))
            parts[k], parts[n], after[k] = whole, None, after[n]
            if after[k] < len(parts):
                before[after[k]] = k
                if (new := whole + parts[after[k]]) in self.cost:
                    heapq.heappush(queue, (self.cost[new], k, new))
            if before[k] >= 0 and (new := parts[before[k]] + whole) in self.cost:
                heapq.heappush(queue, (self.cost[new], before[k], new))
        found = None
        if parts[0] == piece:
            found = (left + [(piece, _INF)], right + [(piece, _INF)])
        self._spines[piece] = found
        return found

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` by priority leaves exactly ``a`` and ``b``."""
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        if len(self._pairs) > 2 * _CACHE:
            self._pairs.clear()
        sa, sb = self._spine(a), self._spine(b)
        good = sa is not None and sb is not None
        if good:
            ends, starts, i, j = sa[1], sb[0], 0, 0
            while True:
                (x, x_until), (y, y_until) = ends[i], starts[j]
                across = self.cost.get(x + y)
                if across is not None and across < x_until and across <= y_until:
                    good = False
                    break
                if x_until == y_until == _INF:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
        self._pairs[a, b] = good
        return good

    # Composition and shortest path.

    def _emit(self, piece: str) -> tuple[int, ...]:
        found = self._emits.get(piece)
        if found is None:
            i = self.ids.get(piece)
            if i is not None:
                found = (i,)
            else:
                found = tuple(self.bytes[b] for b in piece.encode("utf-8", "replace")) if self.bytes else (self.unknown,)
            if len(self._emits) < _CACHE:
                self._emits[piece] = found
        return found

    def path(self, text: str) -> list[str]:
        """Pieces along the shortest path through normalised ``text``; a character without a piece stands alone."""
        n, bigram = len(text), self.kind == BPE
        if n and self.ids.keys() >= set(text):  # no fallback arc is needed
            return self._matched(text, n, bigram)
        best: list[tuple[float, str, int] | None] = [None] * (n + 1)
        best[0] = (0.0, "", -1)
        trie, cost, pair = self.trie, self.cost, self.side_by_side
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            so_far, last, _ = here
            node, to = trie, at
            single = False
            while to < n and (node := node.get(text[to])) is not None:
                to += 1
                piece = node.get("")
                if piece is None:
                    continue
                single = single or to == at + 1
                if bigram:
                    if best[to] is not None:  # all finite paths weigh the same
                        continue
                    if at and not pair(last, piece) or not at and self._spine(piece) is None:
                        continue
                    total = so_far
                else:
                    total = so_far + cost[piece]
                if best[to] is None or total < best[to][0]:
                    best[to] = (total, piece, at)
            if not single:  # the fallback arc
                total = so_far + self.dear
                if (not bigram or not at or pair(last, text[at])) and (best[at + 1] is None or total < best[at + 1][0]):
                    best[at + 1] = (total, text[at], at)
        out, at = [], n
        while at > 0:
            _, piece, at = best[at]
            out.append(piece)
        return out[::-1]

    def _matched(self, text: str, n: int, bigram: bool) -> list[str]:
        """``path`` where every character is a piece: arcs come in order of their ends."""
        best: list[str | None] = [None] * (n + 1)
        best[0] = ""
        if bigram:
            known, pair = self._pairs.get, self.side_by_side
            for end, piece in self.matcher.iter(text):
                if best[end + 1] is not None:  # all finite paths weigh the same
                    continue
                at = end + 1 - len(piece)
                last = best[at]
                if last is None:
                    continue
                if at:
                    good = known((last, piece))
                    if good is None:
                        good = pair(last, piece)
                else:
                    good = self._spine(piece) is not None
                if good:
                    best[end + 1] = piece
        else:
            weight, cost = [0.0] + [_INF] * n, self.cost
            for end, piece in self.matcher.iter(text):
                total = weight[end + 1 - len(piece)] + cost[piece]
                if total < weight[end + 1]:
                    weight[end + 1], best[end + 1] = total, piece
        out, at = [], n
        while at > 0:
            out.append(best[at])
            at -= len(best[at])
        return out[::-1]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null or empty."""
        norm = self.normalise(text or "")
        if self.spans_space:
            return list(chain.from_iterable(map(self._emit, self.path(norm))))
        cache = self._cache
        if len(cache) > _CACHE:
            cache.clear()
        # No piece holds a space after another character, so no path crosses the start of a run of spaces.
        parts = re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", norm)
        out: list[tuple[int, ...]] = []
        for part in parts:
            ids = cache.get(part)
            if ids is None:
                ids = self._segment(part)
                if len(part) <= _KEEP:
                    cache[part] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def _segment(self, part: str) -> tuple[int, ...]:
        """Ids of a stretch, cut where no piece holds the two characters side by side: no path crosses there."""
        inside, cache = self.inside, self._cache
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in inside]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(part)]):
            piece = part[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(chain.from_iterable(map(self._emit, self.path(piece))))
                if len(piece) <= _KEEP:
                    cache[piece] = ids
            out += ids
        return tuple(out)

    def decode(self, ids: list[int]) -> str:
        """The normalised text: bytes of the pieces, spaces restored, without the space put before the first word."""
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``round_trip`` (decoding restores the text, up to the space character).

    Null and empty texts have no ids. Columns of these names are replaced.
    """
    with open(model_path or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in docs.columns if c not in ("ids", "round_trip")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("pieces", shared.value), lambda: PieceTransducer(shared.value))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, same = [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    found = model.encode(t)
                    ids.append(np.array(found, np.int32))
                    plain = (t or "").replace(SPACE, " ")
                    same.append(model.decode(found) == plain)
                sizes = np.cumsum([0, *map(len, ids)])
                flat = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], flat, pa.array(same, pa.bool_())], [*keep, "ids", "round_trip"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("ids", ArrayType(IntegerType())).add("round_trip", "boolean")
    return rows.mapInArrow(work, schema)


def decode(df: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (string) for its ids; null ids decode to an empty text."""
    with open(model_path or default_model(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != "decoded"]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).alias("_ids"))

    def work(batches):
        model = held(("pieces", shared.value), lambda: PieceTransducer(shared.value))
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "decoded"])

    return rows.mapInArrow(work, df.select(*[F.col(f"`{c}`") for c in keep]).schema.add("decoded", "string"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text, digested, and whether decoding restores the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_body"))
    with open(default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def work(batches):
        model = held(("pieces", shared.value), lambda: PieceTransducer(shared.value))
        for b in batches:
            sizes, crcs, same = [], [], []
            for t in b.column(1):
                t = t.as_py() or ""
                ids = model.encode(t)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
                same.append(model.decode(ids) == t.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
