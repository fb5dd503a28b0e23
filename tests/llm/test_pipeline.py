import pathlib

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="the driver's tables are not here")
def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SMALL), "test")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.count() <= before
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == before and out.filter("not round_trip").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "words of a text here", "en", "s", 20), (3, "words of another text there", "en", "s", 27)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SMALL).count() >= 1
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.keep_known_languages(spark, docs, SMALL).collect()) == [0, 3]
