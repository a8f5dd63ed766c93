"""The operators of this package as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from . import (
    bpe,
    chat,
    clusters,
    decontaminate,
    fill_middle,
    language_id,
    line_rules,
    ngram_join,
    passages,
    pii,
    quality,
    vectors,
    warc,
)
from .common import is_held_out, table

#: A deployment takes the key from its secret store.
PII_KEY = b"basketlens demonstration key"
QUALITY_FLOOR = 0.3


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = is_held_out(F.col("doc_id"), 4, 2)
    model = language_id.train(docs.where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language_id.predict(rows, model, F.col("text"), "lang_pred", "score").drop("text")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data, and where they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymize(docs, PII_KEY, spans_col="spans")
    return found.select("doc_id", "text", F.size("spans").alias("n_replaced"), "spans")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that repeat an earlier document's."""
    return passages.find(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard links of 0.9 on three-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items hit in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(docs, items)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    made = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    formatted = chat.format_conversations(rows.unionByName(made), path, pattern)
    return chat.digests(formatted, path, pattern)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = is_held_out(F.col("doc_id"), 5, 0)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    found = quality.score(rows, model, F.col("text"), "score").drop("text")
    return found.withColumn("predicted", (F.col("score") >= QUALITY_FLOOR).cast("int"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and its record as read back from them."""
    folder = shared_dir(spark, "warc")
    manifest = cut_lineage(warc.write(table(spark, sf_dir, "pages"), folder))
    archives = manifest.repartition(max(1, manifest.count()), "path")
    return warc.read(archives).drop("url", "payload")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds from 40 first centroids."""
    found, centroids = clusters.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)
    return clusters.with_inertia(found, centroids)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and restored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fill_middle.transform(docs, share=100, spm_share=50, seed=7)
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document, and the verdict on it without its source's common lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_rules.judged(docs, "source", "text").drop("source", "text", "cleaned")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_permutation_index": op2_permutation_index,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_compact_windows": op4_compact_windows,
    "op5_ngram_join": op5_ngram_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_ns_bounds": op11_ns_bounds,
    "op12_fill_middle": op12_fill_middle,
    "op13_line_rules": op13_line_rules,
}
SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.ORACLE,
    "op11_ns_bounds": clusters.oracle(k=40, rounds=5, seed=2, dims=64, scale=256),
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_line_rules": line_rules.ORACLE,
}
