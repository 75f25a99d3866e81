"""The pipeline's stages on odd rows, and its run on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from brinewave.llm.common import materialise, prepare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def odd(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    t = docs.first().text
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, t, None, None, None), (None, "the end of it", "en", "s", 3), (None, "the end of it", "en", "s", 3), (900, "", "en", "s", 0), (901, "", "en", None, 0), (902, "1 2 3 4 5 6", None, "s", 9)]
    return docs.unionByName(spark.createDataFrame(rows, kind)).unionByName(docs.limit(3))


@pytest.mark.parametrize("name,stage", c.STAGES)
def test_stage_on_odd_and_empty_tables(spark, name, stage):
    prepare(spark)
    docs = materialise(odd(spark), "odd").withColumn("score", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    found = stage(spark, docs, FOLDER)
    assert found.columns[:7] == [*COLUMNS, "score", "n_tokens"]
    rows = found.collect()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if stage is c.known_language:
        assert {900, 901, 902} & {r.doc_id for r in rows} == set() and all(r.text for r in rows)
    if stage is c.one_of_each_group:
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and {900, 901, 902} <= set(ids)
        assert sorted((r.text or "") for r in rows if r.doc_id is None) == ["", "the end of it"]


def test_language_stage_rejects_low_scores(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("lang is not null").count()
    odd = [(10**6, "Это русский текст о погоде", None, "s", 26), (10**6 + 1, "asdf 12345 9999 ..... 1111", None, "s", 26), (10**6 + 2, "123", None, "s", 3)]
    both = materialise(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "both")
    left = {r.doc_id for r in c.known_language(spark, both, FOLDER).collect()}
    assert not left & {10**6, 10**6 + 1, 10**6 + 2} and len(left) == known


def test_language_stage_without_languages(spark):
    prepare(spark)
    rows = [(1, "some words", None), (2, "12 3", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in c.known_language(spark, docs, FOLDER).collect()] == [1]


def test_groups_follow_texts_not_ids(spark):
    """An id with two texts, one of them a copy: the other one stays; near copies without an id are one."""
    prepare(spark)
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, one), (5, one + " more"), (5, two), (7, two + " more"), (None, three), (None, three + " more"), (8, "..."), (None, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.text) for r in c.one_of_each_group(spark, docs, FOLDER).collect()]
    assert (1, one) in found and (5, two) in found and (8, "...") in found
    assert len(found) == 4 and sum(i is None and t.startswith(three) for i, t in found) == 1


def test_run(spark):
    out = c.run(spark, FOLDER)
    assert out.columns == [*COLUMNS, "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    assert [s[0] for s in c.STAGES] == ["quality classifier", "language ID", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
