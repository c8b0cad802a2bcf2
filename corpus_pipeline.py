"""From raw documents to packed training windows, in five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of `documents`. None of them can be put as SQL over whole texts at a useful
cost (compression, MinHash verification, content-defined chunks and a tokenizer), so ORACLE_SQL is None and the tests
hold the stages against brute force.

Defined cases: rows with a null or empty text are scored by the prior, are no copies of each other, hold no passage and no
item, and become one separator id; rows with a null doc_id are kept by the same rules as others; an empty table gives an
empty table; columns other than those of `documents` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chunk_dedup, compression_classifier, decontaminate, ngram_join, packing
from veilspark.llm.common import scratch, written
from veilspark.llm.queries import fold

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression score is at least 0.3; the model learns from the labelled rows of `sf_dir` that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_classifier.fit(docs, labels, fold(F.col("doc_id")) != 0)
    return _columns(compression_classifier.score(docs, model, out="_score").where("_score >= 0.3"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least id (null ids last); of repeated rows one stays.

    Rows go by id and text, so rows without an id, or that share one, are told apart."""
    return _columns(ngram_join.deduplicated(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one holds."""
    cut = chunk_dedup.deduplicated(docs)
    return _columns(cut.withColumn("n_chars", F.length("text").cast("long")))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other parameters."""
    return _columns(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`. What stages pass on lies below the session's checkpoint folder."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
