"""Readers for listing, match and verdict files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MATCH_FILE, MATCH_THRESHOLD, VERDICT_FILE


def read_listing_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON array files below ``path`` as items with ``seq`` and source tags.

    Whole files are single JSON arrays, so a file is one row of text here; its
    entries are split with ``variant`` functions and keep their position.
    ``platform=``/``category=`` folders become columns.
    """
    files = spark.read.option("wholetext", True).text(path)
    tags = [c for c in files.columns if c != "value"]
    return files.select(
        *tags,
        F.col("_metadata.file_name").alias("file_name"),
        F.posexplode(
            F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
        ).alias("seq", "item"),
    )


def read_match_results(
    spark: SparkSession,
    path: str,
    threshold: float = MATCH_THRESHOLD,
    multi_line: bool = True,
) -> DataFrame:
    """Candidates (query_id, corpus_id, score) at or above the threshold.

    ``multi_line`` is for one document per file; with one document per line the
    files can be split.

    A missing ``rerank_score`` falls back to ``score``, then to 0; ``pos`` is the
    order in the file, which decides between equal scores.
    """
    doc = spark.read.schema(MATCH_FILE).option("multiLine", multi_line).json(path)
    rows = doc.select("category", F.posexplode("matches").alias("pos", "m"))
    score = F.coalesce("m.rerank_score", "m.score", F.lit(0.0))
    return rows.select(
        "category",
        "pos",
        F.col("m.query_id").alias("query_id"),
        F.col("m.corpus_id").alias("corpus_id"),
        score.alias("score"),
    ).where(F.col("score") >= threshold)


def read_judge_verdicts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Verdicts keyed by the listing pair, so two candidates of one anchor stay apart."""
    doc = spark.read.schema(VERDICT_FILE).option("multiLine", multi_line).json(path)
    return doc.select(F.explode("verdicts").alias("v")).select(
        F.col("v.catalog_id_a").alias("catalog_id_a"),
        F.col("v.catalog_id_b").alias("catalog_id_b"),
        (F.col("v.verdict") == "YES").alias("is_match"),
    )
