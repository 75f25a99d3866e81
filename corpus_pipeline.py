"""Corpus preparation: five stages on the documents table, each written before the next one.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
columns of ``docs``; the last one adds the token counts and digests. Rows with null or empty
text are judged by the stages as their docstrings say. Tables the stages need beside the
documents (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm import bpe, decontaminate, language, neardup, quality
from brinewave.llm.common import fresh, materialise, prepare, table

#: near duplicates: five-word shingles, similarity of 0.8 or more
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``quality.KEEP``.

    The model learns from the stage's own documents. An empty table stays empty; null and
    empty texts get the score of an empty text; rows are kept or dropped one by one, so
    repeated rows share their fate.
    """
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.KEEP).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that are ``und`` (null, or without a letter) go, and those
    whose score is below ``language.LEAST_SCORE``.

    The model learns from the stage's own documents; where none has a language, nothing can be
    told apart and all documents with a letter stay.
    """
    prepare(spark)
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name, score = fresh(docs, "lang_found"), fresh(docs, "lang_score")
    found = language.identify(docs, model, name=name, score=score)
    return found.where((F.col(name) != "und") & (F.col(score) >= language.LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Every distinct (id, text) is a document of its own: repeated rows become one, and of a
    group's texts under its smallest id the one with the smallest hash stays. Rows without
    an id come after all others. Texts without a word link with nothing and stay, but for
    those without an id that equal another one.
    """
    prepare(spark)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        found = neardup.near_duplicates(docs, NEAR_PERCENT).where("not kept")
        # the ids that go are fewer than those that stay
        return docs.join(materialise(found.select("doc_id"), "gone"), "doc_id", "left_anti").select(*docs.columns)
    key = fresh(docs, "row_key")
    rows = materialise(docs.dropDuplicates(["doc_id", "text"]).withColumn(key, F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows, NEAR_PERCENT, doc_id=key).select(F.col("doc_id").alias(key), "component_id", "n_shingles")
    # a text without a word is alone, except that its copies without an id meet it
    alone = F.col("n_shingles") == 0
    hashes = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    about = rows.select(F.col(key), "doc_id", F.col("text").isNull().alias("none"), hashes[0].alias("t1"), hashes[1].alias("t2"))
    found = materialise(found.join(about, key).withColumn("alone", alone), "groups")
    group = [F.when(~F.col("alone"), F.col("component_id")).alias("c"), *(F.when(F.col("alone"), F.col(x)).alias(f"g_{x}") for x in ("none", "t1", "t2"))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2", key))
    chosen = found.groupBy(*group).agg(first.alias("first")).select(F.col(f"first.{key}").alias(key))
    chosen = chosen.unionByName(found.where("alone and doc_id is not null").select(key)).distinct()
    return rows.join(materialise(chosen, "chosen"), key, "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at a similarity of 0.8 or more."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, and digests of the ids and of the text decoded from them."""
    prepare(spark)
    whole, text = docs.columns, fresh(docs, "text_in")
    out = {c: fresh(docs, c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")}
    found = bpe.token_digest(docs.withColumn(text, F.col("text")), text)
    return found.toDF(*whole, *out.values())


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: networks, support vector machines and BPE have no SQL form; tests/llm hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is a table in the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
