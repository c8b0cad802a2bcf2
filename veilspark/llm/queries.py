"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

#: Which documents labels are learned from, and which are held out.
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.chunk_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.quotes import linked

    return linked(table(spark, sf_dir, "conversations"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of `conversations` with the one before it quoted on top; the links must lead back to that one."""
    from veilspark.llm.quotes import linked

    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("> "), F.regexp_replace("text", "\n", "\n> "), F.lit("\n")).alias("quote"))
    made = rows.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.concat(F.coalesce("quote", F.lit("")), "text").alias("text"))
    return linked(made).select("conv_id", "turn", "own", "reply_to", "thread", "depth")


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.backoff_lm import backoff_scores

    return backoff_scores(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.maximal_repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.ngram_join import similar

    return similar(table(spark, sf_dir, "documents"))


def op7_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import compression_classifier as c

    docs = table(spark, sf_dir, "documents")
    model = c.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    scored = c.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import toxicity as t

    docs = table(spark, sf_dir, "documents")
    model = t.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 0)
    scored = t.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.quality_rules import quality_rules

    got = quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.centroid_clusters import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.line_dedup import deduplicated

    got = deduplicated(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.hard_negatives import hard_negatives, moved_label

    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", moved_label(F.col("vec_id"), F.col("label"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "quoted_replies") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from veilspark.llm import centroid_clusters, decontaminate, hard_negatives, line_dedup

    return {
        "op11_centroid_clusters": centroid_clusters.oracle(),
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_hard_negatives": hard_negatives.oracle(),
        "op9_decontaminate": decontaminate.ORACLE,
        "quoted_replies": "SELECT conv_id, turn, trim(text) AS own, lag(turn) OVER w AS reply_to, first(turn) OVER w AS thread, row_number() OVER w - 1 AS depth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    }
