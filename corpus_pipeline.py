"""A corpus cleaned and tokenised in stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobila.llm import langid, sentencepiece_fst
from strobila.llm.decontaminate import drop_leaks
from strobila.llm.similar import similar_groups
from strobila.llm.store import cut, remove, table, written
from strobila.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this goes, and so does one without a letter.
LEAST_CERTAIN = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go, null and letterless texts among them; the others stay as they are. The
    model learns from a bounded sample of the documents that name their language; without any, all documents go."""
    model = langid.train(docs)
    found = langid.detect(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one with the smallest
    doc_id. Rows without doc_id go; of rows that share the smallest doc_id all stay."""
    keep = cut(similar_groups(docs).filter("doc_id = component_id").select("doc_id"), "kept")
    # A hash join on the ids at every size, so that texts are not sorted and few rows and many have one plan.
    return docs.join(keep.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out, by whole characters; a document of which
    nothing stays goes. ``n_chars`` is counted anew."""
    out = without_repeats(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those without doc_id too."""
    return drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids; ``round_trip`` tells that decoding gives the text back."""
    out = sentencepiece_fst.encode(docs.select(*COLUMNS))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", to_pieces),
]

#: No SQL states trained models or piece ids; run() is tested against the same five stages in plain Python, over all pairs
#: of documents and all windows of bytes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written before the next stage reads it."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, new = written(stage(spark, docs, sf_dir), "stage")
        if path:
            remove(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
