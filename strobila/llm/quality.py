"""Quality by compression: how much better one dictionary than the other shortens a text.

Two zstandard dictionaries are trained on labelled texts, one on good and one on bad ones, each on all blocks of half of
the texts of its label. A text is compressed with each, in blocks, so that the dictionary and not the text's own beginning explains every part of it. The difference of the two sizes over
their sum, and the compressed share of the text, go through a logistic calibration fitted on labelled texts that the
dictionaries have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobila.llm.langid import parts
from strobila.llm.sampling import fold, labelled_sample
from strobila.llm.store import cut, fresh, table

_BLOCK = 1024
#: Bytes of a dictionary, and of the segments that training picks for it.
_SIZE = 112 << 10
_SEGMENT = 256


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, constant last, of a ridge logistic regression by Newton's method; classes weigh as they occur."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class CompressionModel:
    """Dictionaries of good and bad text, and the calibration of the size difference."""

    def __init__(self, good: list[bytes], bad: list[bytes], level: int = 5):
        """With texts of one label only, or none, every text scores that label's share, (good + 1) / (all + 2)."""
        self.level = level
        self.constant = (len(good) + 1) / (len(good) + len(bad) + 2) if not (good and bad) else None
        cut_good, cut_bad = (len(good) + 1) // 2, (len(bad) + 1) // 2
        self.dicts = [self._dictionary(good[:cut_good]), self._dictionary(bad[:cut_bad])]
        self._open()
        if self.constant is None:
            rest_good, rest_bad = good[cut_good:] or good, bad[cut_bad:] or bad
            raw = self.features([*rest_good, *rest_bad])
            y = np.r_[np.ones(len(rest_good)), np.zeros(len(rest_bad))]
            self.mid, self.spread = raw.mean(0), raw.std(0) + 1e-9
            self.weights = fit_logistic(self._shape(raw), y)

    @staticmethod
    def _dictionary(texts: list[bytes]) -> bytes:
        """A dictionary trained on all blocks of the texts; of too few for training, the texts themselves."""
        blocks = [t[at : at + _BLOCK] for t in texts for at in range(0, len(t), _BLOCK)]
        try:
            return zstandard.train_dictionary(_SIZE, blocks, k=_SEGMENT, d=8).as_bytes()
        except zstandard.ZstdError:
            return b"\n".join(blocks)[-_SIZE:] or b"\0" * 16

    def _open(self) -> None:
        self.packers = []
        for content in self.dicts:
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            self.packers.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "packers"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def sizes(self, text: bytes) -> tuple[int, int]:
        good = bad = 0
        pack_good, pack_bad = self.packers[0].compress, self.packers[1].compress
        for at in range(0, len(text) or 1, _BLOCK):
            part = text[at : at + _BLOCK]
            good += len(pack_good(part))
            bad += len(pack_bad(part))
        return good, bad

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), 2))
        for i, t in enumerate(texts):
            good, bad = self.sizes(t)
            out[i] = (bad - good) / (bad + good), (good + bad) / (2 * len(t) + 64)
        return out

    def _shape(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mid) / self.spread, -6, 6)
        return np.c_[z, z**2, z[:, :1] * z[:, 1:]]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality for each text."""
        if not texts or self.constant is not None:
            return np.full(len(texts), self.constant or 0.0)
        x = self._shape(self.features(texts))
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the texts that have one: a join of ids, no text is shuffled."""
    return cut(docs.filter("text is not null").select("doc_id").join(labels.select("doc_id", label).dropna(), "doc_id"), "labels")


def shift(found: list[dict], label: str) -> float:
    """What takes the log odds of a sample back to those of the labels."""
    n = {r[label]: r["n"] for r in found}
    own = [sum(r[label] == k for r in found) for k in (0, 1)]
    return float(np.log(n[1] / n[0]) - np.log(own[1] / own[0])) if all(own) else 0.0


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 8000, most_bytes: int = 1 << 15, seed: int = 2) -> CompressionModel:
    """From docs (doc_id, text) and labels (doc_id, quality): a bounded sample of ``most_docs`` texts of ``most_bytes`` at
    most, both labels alike, so the calibration is shifted back to the labels' own proportion."""
    found = labelled_sample(with_labels(docs, labels, "quality"), docs, "quality", most_docs, most_bytes, seed)
    model = CompressionModel(*[[r["text"].encode() for r in found if r["quality"] == k] for k in (1, 0)])
    if model.constant is None:
        model.weights[-1] += shift(found, "quality")
    return model


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from 0.5 on); a null text scores like an empty
    one. Texts are read whole. Every row of ``docs`` stays, as do its columns, but for any named ``score`` or
    ``predicted``, which the result replaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 112 KiB
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(fresh("_text", keep)))

    def work(batches):
        model = shared.value
        for b in batches:
            for part in parts(b):
                s = model.score([t.as_py() or b"" for t in part.column(part.num_columns - 1).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(work, schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").alias("_body"))
    return score(rows, model, "_body").select("doc_id", "held_out", "score", "predicted")
