"""Bounded samples of labelled texts, an equal share for each label, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(col: str, n: int):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def labelled_sample(narrow: DataFrame, docs: DataFrame, label: str, most_docs: int, most_bytes: int, seed: int) -> list:
    """At most ``most_docs`` rows (doc_id, text, label, n), n being how many rows of ``narrow`` have the label.

    ``narrow`` (doc_id, label) says which rows there are; ``docs`` (doc_id, text, and label if it has it) holds the texts,
    which are fetched for the chosen ids only, by a broadcast of at most ``most_docs`` ids, so no text is shuffled. A row's
    place in the order is its hash, from 0 to 1, times the count of its label: the first ``most_docs`` of it are an equal
    share of each label at any number of rows, and all rows of a label that has fewer. Of a text of more than
    ``most_bytes`` bytes a part is taken that begins at a hashed place, so long texts are learned from too. Rows without
    id, text or label are left out, and rows that repeat an id count once. Of more than ``most_docs`` labels the most
    frequent ones are sampled, so that no more counts are broadcast.
    """
    narrow = narrow.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    counts = narrow.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most_docs)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    ranked = narrow.join(F.broadcast(counts), label).select("doc_id", label, "n", (lot * F.col("n")).alias("lot")).distinct()
    picked = ranked.orderBy("lot", "doc_id", label).limit(most_docs).collect()
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r[label]) for r in picked], narrow.schema)
    text, chars = F.col("text"), most_bytes // 4
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(F.length(text) - chars, F.lit(0)).cast("long") + 1) + 1
    part = F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.substring(text, begin.cast("int"), F.lit(chars)))
    on = ["doc_id", label] if label in docs.columns else ["doc_id"]
    found = docs.filter("text is not null").join(F.broadcast(chosen), on).groupBy("doc_id", label).agg(F.min(part).alias("text"))
    texts = {(r["doc_id"], r[label]): r["text"] for r in found.collect()}
    return [r.asDict() | {"text": texts[r["doc_id"], r[label]]} for r in picked if (r["doc_id"], r[label]) in texts]
