"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words and their beginnings, each hashed to one of ``2**bits`` terms. The score is the logistic of

    bias + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms that it holds, so a pair such as an insult and the mention of a group has a weight of its own, which a
linear model cannot give. The pair sum is taken in linear time from the sum and the sum of squares of the factors.

The machine is fitted twice. The first time all terms that occur often enough take part, under penalties that draw
weights and whole factors to zero; no term is judged by its own share of labels, so a pair that tells only together is
found like any other. The terms that the first machine gives most weight or the longest factors are fitted again, almost
without a penalty: thousands of terms that weigh next to nothing would otherwise add up over a long text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.held import held
from strobila.llm.langid import parts
from strobila.llm.quality import fit_logistic, shift, with_labels
from strobila.llm.sampling import fold, labelled_sample
from strobila.llm.store import fresh, table

_WORD = re.compile(r"\w+")
_CACHE = 100_000
#: Steps that a fit takes at least, however few its texts.
_LEAST_STEPS = 500
#: Letters of a word's beginning, which is a term too.
_STEM = 5


class FactorizationMachine:
    """Weights and factors by AdaGrad on the logistic loss, with penalties that set them to zero."""

    def __init__(self, bits: int = 20, rank: int = 8, seed: int = 8):
        self.bits, self.rank, self.seed = bits, rank, seed
        self.cache: dict[str, int] = {}
        self.constant: float | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _terms_of(self, word: str) -> tuple[int, ...]:
        """Of a word, and of its beginning where it is longer."""
        names = (word, word[:_STEM] + "*") if len(word) > _STEM else (word,)
        return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) >> (32 - self.bits) for n in names)

    def terms(self, text: str | None) -> set[int]:
        return {t for w in set(_WORD.findall((text or "").lower())) for t in self._terms_of(w)}

    def fit(self, texts: list[str], y: list[int], least: int = 3, most: int = 1024) -> "FactorizationMachine":
        """``least``: texts that a term must be in; ``most``: terms of the second machine. With texts of one label only,
        or none, every text scores that label's share, (ones + 1) / (all + 2)."""
        y = np.asarray(y, float)
        if len(set(y.tolist())) < 2:
            self.constant, self.index = (y.sum() + 1) / (len(y) + 2), {}
            return self
        rows = [np.fromiter(self.terms(t), np.int64) for t in texts]
        seen = np.bincount(np.concatenate(rows), minlength=1 << self.bits)
        live = np.flatnonzero(seen >= least)
        self._descend(rows, y, live, rounds=8, l1=6e-3, group=1e-2)
        weight = np.abs(self.w) + np.sqrt((self.v**2).sum(1))
        first = np.argsort(-weight, kind="stable")[:most]
        self._descend(rows, y, np.sort(live[first[weight[first] > 0]]), rounds=25, l1=1e-4, group=1e-4)
        return self

    def _descend(self, rows: list[np.ndarray], y: np.ndarray, live: np.ndarray, rounds: int, l1: float, group: float, rate: float = 0.1, batch: int = 32) -> None:
        """Fits bias, w and v of the ``live`` terms. ``l1`` and ``group`` are taken off the size of a weight and off the
        length of a factor at each step, for each text of the batch."""
        rng = np.random.default_rng(self.seed)
        where = np.full(1 << self.bits, -1)
        where[live] = np.arange(len(live))
        self.index = {int(t): k for k, t in enumerate(live)}
        x = [i[i >= 0] for i in (where[r] for r in rows)]
        n, share = len(live), (y.sum() + 0.5) / (len(y) + 1)
        self.bias, self.w, self.v = float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.05, (n, self.rank))
        gb, gw, gv = 1e-2, np.full(n, 1e-2), np.full(n, 1e-2)
        full = np.array([k for k, i in enumerate(x) if len(i)], np.int64)
        for _ in range(max(rounds, _LEAST_STEPS * batch // max(1, len(full)))):
            turn = rng.permutation(full)
            for at in range(0, len(turn), batch):
                own = turn[at : at + batch]
                idx = np.concatenate([x[k] for k in own])
                size = np.array([len(x[k]) for k in own])
                begin = np.r_[0, np.cumsum(size)[:-1]]
                v = self.v[idx]
                total = np.add.reduceat(v, begin, 0)
                z = self.bias + np.add.reduceat(self.w[idx], begin) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), begin))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
                gb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(gb)
                each = np.repeat(g, size)
                order = np.argsort(idx, kind="stable")
                used, first = np.unique(idx[order], return_index=True)
                step = np.add.reduceat(each[order], first)
                gw[used] += step**2
                pace = rate / np.sqrt(gw[used])
                w = self.w[used] - pace * step
                self.w[used] = np.sign(w) * np.maximum(0, np.abs(w) - pace * l1 * len(own))
                step = np.add.reduceat(((np.repeat(total, size, 0) - v) * each[:, None])[order], first, 0)
                gv[used] += (step**2).sum(1)
                pace = rate / np.sqrt(gv[used])
                v = self.v[used] - pace[:, None] * step
                length = np.sqrt((v**2).sum(1)) + 1e-12
                self.v[used] = v * np.maximum(0, 1 - pace * group * len(own) / length)[:, None]

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Log odds before calibration."""
        cache, index = self.cache, self.index
        if len(cache) > _CACHE:
            cache.clear()
        out = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            found: set[int] = set()
            for w in set(_WORD.findall((t or "").lower())):
                live = cache.get(w)
                if live is None:
                    live = cache[w] = tuple(index[t] for t in self._terms_of(w) if t in index)
                if live:
                    found.update(live)
            if found:
                i = sorted(found)
                v = self.v[i]
                out[k] += self.w[i].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return out

    def calibrate(self, texts: list[str], y: list[int]) -> "FactorizationMachine":
        """Fits scale and constant of the log odds; they stay as they are unless both labels occur."""
        self.scale = np.array([1.0, 0.0])
        if self.constant is None and len(set(y)) == 2:
            self.scale = fit_logistic(np.clip(self.raw(texts), -20, 20)[:, None], np.asarray(y, float), ridge=1e-4)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = np.clip(self.raw(texts), -20, 20) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 8000, most_bytes: int = 1 << 15, seed: int = 8) -> FactorizationMachine:
    """From docs (doc_id, text) and labels (doc_id, toxic): a bounded sample of ``most_docs`` texts of ``most_bytes`` at most, both labels alike.

    Four fifths fit the machine, the rest calibrates it; its constant then returns to the labels' own proportion.
    """
    found = labelled_sample(with_labels(docs, labels, "toxic"), docs, "toxic", most_docs, most_bytes, seed)
    own = [zlib.crc32(str(r["doc_id"]).encode()) // 5 % 5 == 0 for r in found]
    pick = lambda own_is: zip(*[(r["text"], int(r["toxic"])) for r, k in zip(found, own) if k == own_is])
    texts, y = map(list, pick(False) if not all(own) else ((), ()))
    model = FactorizationMachine().fit(texts, y)
    texts, y = map(list, pick(True) if any(own) else ((), ()))
    model.calibrate(texts, y)
    model.scale[1] += shift(found, "toxic")
    return model


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from 0.5 on); a null text scores like an empty
    one. Texts are read whole. Every row of ``docs`` stays, as do its columns, but for any named ``score`` or
    ``predicted``, which the result replaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and 2**bits terms
    key = uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(fresh("_text", keep)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: shared.value)
        for b in batches:
            for part in parts(b):
                p = model.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(work, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").alias("_body"))
    return score(rows, model, "_body").select("doc_id", "held_out", "score", "predicted")
