"""Language identification by words first, then by ever shorter character n-grams.

A known word scores its smoothed log frequency in each language. A word that training did not see falls back to the
longest n-grams of it that training did see (4 letters with word ends, then 3, 2, 1), each at its log frequency for its
length, averaged, and discounted for every step back. A text's score in a language is the mean over its words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.held import held
from strobila.llm.sampling import fold, labelled_sample
from strobila.llm.store import fresh, table

_WORD = re.compile(r"[^\W\d_]+")
#: Words of a worker's cache; it starts anew beyond.
_CACHE = 150_000
_SLICE = 1 << 20


def _grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class BackoffModel:
    """Log frequencies of words and of n-grams of 1 to ``order`` characters for each language."""

    def __init__(self, texts: list[tuple[str, str]], order: int = 4, discount: float = 0.7, least: int = 2):
        self.langs = sorted({lang for _, lang in texts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words = [Counter() for _ in self.langs]
        for text, lang in texts:
            words[at[lang]].update(_WORD.findall(text.lower()))
        self.order, self.discount = order, discount
        total = Counter()
        for c in words:
            total.update(c)
        known = {w for w, n in total.items() if n >= least}
        self.words = self._table([{w: n for w, n in c.items() if w in known} for c in words])
        self.grams = []
        for n in range(1, order + 1):
            counts = [Counter() for _ in self.langs]
            for out, c in zip(counts, words):
                for w, k in c.items():
                    for g in _grams(w, n):
                        out[g] += k
            self.grams.append(self._table(counts))
        self.floor = np.full(len(self.langs), -20.0, np.float32)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)

    def _table(self, counts: list[dict]) -> tuple[dict[str, int], np.ndarray]:
        keys = sorted({k for c in counts for k in c})
        sums = np.array([sum(c.values()) for c in counts], float)
        table = np.array([[c.get(k, 0) for c in counts] for k in keys], float).reshape(len(keys), len(counts))
        logs = np.log((table + 0.1) / (sums + 0.1 * max(1, len(keys)))).astype(np.float32)
        return {k: i for i, k in enumerate(keys)}, logs

    def word(self, w: str) -> np.ndarray:
        index, logs = self.words
        if (known := index.get(w)) is not None:
            return logs[known]
        weight = self.discount
        for n in range(self.order, 0, -1):
            index, logs = self.grams[n - 1]
            found = [i for g in _grams(w, n) if (i := index.get(g)) is not None]
            if found:
                return weight * logs[found].mean(0)
            weight *= self.discount
        return self.floor

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text; ``und`` and 0.0 where there is no letter or no model."""
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return out, score
        if len(self.cache) > _CACHE:
            self.cache, self.rows = {}, self.rows[:0]
        new = list({w for ws in found for w in ws}.difference(self.cache))
        if new:
            self.cache.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, np.array([self.word(w) for w in new], np.float32)])
        sizes = np.array([len(ws) for ws in found])
        full = np.flatnonzero(sizes)
        if not len(full):
            return out, score
        get = self.cache.__getitem__
        ids = np.fromiter((i for ws in found for i in map(get, ws)), np.int64, sizes.sum())
        logs = self.rows[ids]
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        mean = np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / sizes[full, None]
        sure = mean * np.minimum(sizes[full, None], 20)
        p = np.exp(sure - sure.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for k, i in enumerate(full):
            out[i] = self.langs[best[k]]
        score[full] = p[np.arange(len(full)), best]
        return out, score

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": self.rows[:0]}


def slices(texts: list, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def parts(b: pa.RecordBatch, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of its last column, one row at least, so that few texts are Python's at a
    time."""
    size = np.asarray(pc.binary_length(b.column(b.num_columns - 1)).fill_null(0)).astype(np.int64)
    turn = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(turn)) + 1
    for s, e in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
        if e > s:
            yield b.slice(int(s), int(e - s))


def train(docs: DataFrame, most_docs: int = 3000, most_bytes: int = 1 << 15, seed: int = 4) -> BackoffModel:
    """A model from a bounded sample of the rows with an id, a text and a lang: ``most_docs`` texts of ``most_bytes`` at
    most, an equal share for each language. Without any, the model answers ``und``."""
    rows = docs.select("doc_id", "text", "lang")
    found = labelled_sample(rows.filter("text is not null"), rows, "lang", most_docs, most_bytes, seed)
    return BackoffModel([(r["text"], r["lang"]) for r in found])


def detect(docs: DataFrame, model: BackoffModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string) and ``score`` (double); a null, empty or letterless text is ``und`` at 0.0.

    Texts are read whole, and of equally likely languages the first by name is given. Every row of ``docs`` stays, as do
    its columns, but for any named ``lang_pred`` or ``score``, which the result replaces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: it comes from the bounded sample
    key = uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(fresh("_text", keep)))

    def work(batches):
        model = held(key, lambda: shared.value)
        for b in batches:
            for part in parts(b):
                lang, score = model.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(work, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    model = train(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    ids = rows.select("doc_id", "held_out", F.col("text").alias("_body"))
    return detect(ids, model, "_body").select("doc_id", "held_out", "lang_pred", "score")
