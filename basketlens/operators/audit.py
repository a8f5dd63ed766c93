"""Match quality: ambiguous pairs, verdicts, ground truth, sweeps, rule checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_unit, token_jaccard
from ..schemas import (
    HIGH_CONFIDENCE,
    JUDGE_PASS_ACCURACY,
    MATCH_THRESHOLD,
    MAX_CLUSTER_SIZE,
    MIN_TOKEN_OVERLAP,
    SWEEP_THRESHOLDS,
)
from .stats import top_n


def _members(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    listings = catalog.select(F.col("id").alias("catalog_id"), "platform", "name", "brand", "unit")
    return mappings.join(listings, "catalog_id")


def _blinkit_member(members: DataFrame) -> DataFrame:
    """The blinkit listing with the lowest id of each cluster that has one."""
    fields = ("catalog_id", "name", "brand", "unit")
    return (
        members.where(F.col("platform") == "blinkit")
        .groupBy("canonical_id")
        .agg(F.min_by(F.struct(*fields), "catalog_id").alias("_a"))
        .select("canonical_id", *[F.col(f"_a.{f}").alias(f"{f}_a") for f in fields])
    )


def ambiguous_pairs(
    mappings: DataFrame,
    catalog: DataFrame,
    low: float = MATCH_THRESHOLD,
    high: float = HIGH_CONFIDENCE,
) -> DataFrame:
    """Mappings in the doubtful score band, next to their cluster's blinkit listing."""
    members = _members(mappings, catalog)
    score = F.col("similarity_score")
    doubtful = members.where((score >= low) & (score < high)).select(
        "canonical_id",
        *[F.col(c).alias(f"{c}_b") for c in ("catalog_id", "name", "brand", "unit")],
        score.alias("similarity"),
    )
    return doubtful.join(_blinkit_member(members), "canonical_id")


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame, missing_verdict: bool) -> DataFrame:
    """Add ``verified``; pairs nobody judged take ``missing_verdict``."""
    keys = ["catalog_id_a", "catalog_id_b"]
    judged = verdicts.select(*keys, "is_match")
    return (
        pairs.join(judged, keys, "left")
        .withColumn("verified", F.coalesce("is_match", F.lit(missing_verdict)))
        .drop("is_match")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall and F1 from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * p * r, p + r))
    )


def _judged(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    keys = ["catalog_id_a", "catalog_id_b"]
    return predicted.select(*keys, F.col("is_match").alias("predicted")).join(
        truth.select(*keys, F.col("is_match").alias("actual")), keys
    )


def judge_benchmark(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion matrix of a judge over the pairs both sides know."""
    said, is_so = F.col("predicted"), F.col("actual")
    counts = _judged(predicted, truth).agg(
        F.count_if(said & is_so).alias("tp"),
        F.count_if(said & ~is_so).alias("fp"),
        F.count_if(~said & ~is_so).alias("tn"),
        F.count_if(~said & is_so).alias("fn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return (
        with_prf(counts)
        .withColumn("total_pairs", total)
        .withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), total))
        .withColumn("passed", F.col("accuracy") >= JUDGE_PASS_ACCURACY)
    )


def judge_mismatches(predicted: DataFrame, truth: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` wrong verdicts, a report for reading."""
    kind = F.when(F.col("actual"), "false_negative").otherwise("false_positive")
    return (
        _judged(predicted, truth)
        .where(F.col("predicted") != F.col("actual"))
        .select("catalog_id_a", "catalog_id_b", kind.alias("type"))
        .orderBy("catalog_id_a", "catalog_id_b")
        .limit(n)
    )


def ground_truth_pairs(listings: DataFrame, index_pairs: DataFrame) -> DataFrame:
    """Position pairs -> id pairs.

    ``listings``: platform, pos (position in its source file), id.
    ``index_pairs``: platform_a, pos_a, platform_b, pos_b.
    """
    a = listings.select(
        F.col("platform").alias("platform_a"), F.col("pos").alias("pos_a"), F.col("id").alias("id_a")
    )
    b = listings.select(
        F.col("platform").alias("platform_b"), F.col("pos").alias("pos_b"), F.col("id").alias("id_b")
    )
    return (
        index_pairs.join(a, ["platform_a", "pos_a"])
        .join(b, ["platform_b", "pos_b"])
        .select("id_a", "id_b")
    )


def pair_set_rows(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Union of two pair sets with each pair's outcome: tp (in both), fp or fn.

    One aggregation over the tagged union instead of an intersection and two
    differences, so neither input is computed more than once.
    """
    in_truth = truth.select("id_a", "id_b", F.lit(1).alias("t"), F.lit(0).alias("a"))
    in_actual = actual.select("id_a", "id_b", F.lit(0).alias("t"), F.lit(1).alias("a"))
    sides = (
        in_truth.unionByName(in_actual)
        .groupBy("id_a", "id_b")
        .agg(F.max("t").alias("t"), F.max("a").alias("a"))
    )
    outcome = F.when(F.col("t") == 0, "fp").when(F.col("a") == 0, "fn").otherwise("tp")
    return sides.select("id_a", "id_b", outcome.alias("outcome"))


def pair_set_counts(truth: DataFrame, actual: DataFrame) -> DataFrame:
    rows = pair_set_rows(truth, actual)
    return rows.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]
    )


def threshold_sweep(
    scored: DataFrame, truth: DataFrame, thresholds: Iterable[float] = SWEEP_THRESHOLDS
) -> DataFrame:
    """Precision, recall and F1 at each threshold.

    ``scored``: query_id, corpus_id, score.  ``truth``: query_id, corpus_id.  A
    query's best match does not depend on the threshold, only whether it counts,
    so one best match per query serves all thresholds in a single aggregation.
    """
    best = scored.groupBy("query_id").agg(
        F.max_by("corpus_id", F.struct("score", -F.col("corpus_id"))).alias("corpus_id"),
        F.max("score").alias("score"),
    )
    facts = truth.select("query_id", "corpus_id").distinct().withColumn("is_true", F.lit(True))
    marked = best.join(facts, ["query_id", "corpus_id"], "full").select(
        F.col("score"), F.coalesce("is_true", F.lit(False)).alias("is_true")
    )
    values = [float(t) for t in thresholds]
    hit = [F.coalesce(F.col("score") >= t, F.lit(False)) for t in values]
    per_threshold = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.count_if(h & F.col("is_true")).alias("tp"),
            F.count_if(h & ~F.col("is_true")).alias("fp"),
            F.count_if(~h & F.col("is_true")).alias("fn"),
        )
        for t, h in zip(values, hit)
    ]
    return with_prf(marked.agg(F.array(*per_threshold).alias("s")).select(F.inline("s")))


def recommend_threshold(sweep: DataFrame, current: float = MATCH_THRESHOLD) -> DataFrame:
    """Best-F1 threshold (the lowest of equals), with the change against today's."""
    row = F.struct("threshold", "f1", "precision", "recall")
    is_current = F.abs(F.col("threshold") - current) < 0.001
    picked = sweep.agg(
        F.max_by(row, F.struct("f1", -F.col("threshold"))).alias("b"),
        F.max(F.when(is_current, F.col("precision"))).alias("p0"),
        F.max(F.when(is_current, F.col("recall"))).alias("r0"),
    )
    return picked.select(
        F.col("b.threshold").alias("recommended"),
        F.col("b.f1").alias("f1"),
        ((F.col("b.precision") - F.col("p0")) * 100).alias("precision_gain"),
        ((F.col("r0") - F.col("b.recall")) * 100).alias("recall_loss"),
    )


def oversized_clusters(mappings: DataFrame, max_size: int = MAX_CLUSTER_SIZE) -> DataFrame:
    counts = mappings.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.where(F.col("cnt") > max_size)


def unit_conflicts(canonicals: DataFrame, mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sizes of clusters that hold more than one, one row per (cluster, size)."""
    sizes = (
        _members(mappings, catalog)
        .select("canonical_id", normalize_unit("unit").alias("unit"))
        .where(F.col("unit").isNotNull())
        .distinct()
    )
    mixed = (
        sizes.groupBy("canonical_id")
        .agg(F.count(F.lit(1)).alias("n_units"))
        .where(F.col("n_units") > 1)
    )
    names = canonicals.select(
        F.col("id").alias("canonical_id"),
        F.trim(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "canonical_name")).alias("name"),
    )
    return sizes.join(mixed, "canonical_id").join(names, "canonical_id")


def low_overlap_matches(
    mappings: DataFrame,
    catalog: DataFrame,
    low: float = MATCH_THRESHOLD,
    min_overlap: float = MIN_TOKEN_OVERLAP,
) -> DataFrame:
    """Accepted matches whose texts share few tokens, one per (cluster, other name).

    Of all blinkit/other pairs behind a (cluster, other name) the one with the
    lowest other id, then the lowest blinkit id, is kept.  A listing is not paired
    with itself, so the two lowest ids of each side decide and the members of a
    cluster are never multiplied with each other.
    """
    members = _members(mappings, catalog)
    score = F.col("similarity_score")
    others = top_n(
        members.where((score >= low) & (score < 1.0)).select(
            "canonical_id",
            F.col("name").alias("other_name"),
            F.col("catalog_id").alias("other_id"),
            F.col("brand").alias("other_brand"),
            score.alias("similarity"),
        ),
        ["canonical_id", "other_name"], [F.col("other_id")], 2, "_nth",
    )
    blinkit = members.where(F.col("platform") == "blinkit")
    fields = F.struct("catalog_id", "name", "brand")
    lowest = blinkit.groupBy("canonical_id").agg(F.min("catalog_id").alias("_low"))
    heads = (
        blinkit.join(lowest, "canonical_id")
        .groupBy("canonical_id")
        .agg(
            F.min_by(fields, "catalog_id").alias("_first"),
            F.min_by(
                fields, F.when(F.col("catalog_id") != F.col("_low"), F.col("catalog_id"))
            ).alias("_second"),
        )
    )
    paired = (
        others.join(heads, "canonical_id")
        .withColumn(
            "_b",
            F.when(F.col("_first.catalog_id") != F.col("other_id"), F.col("_first")).otherwise(
                F.col("_second")
            ),
        )
        .where(F.col("_b").isNotNull())
        .groupBy("canonical_id", "other_name")
        .agg(F.min_by(F.struct("_b", "other_brand", "similarity"), "other_id").alias("_p"))
        .select("canonical_id", "other_name", "_p.*")
    )

    def label(brand: Column, name: Column) -> Column:
        return F.trim(F.concat_ws(" ", F.coalesce(brand, F.lit("")), name))

    return (
        paired.select(
            "canonical_id",
            label(F.col("_b.brand"), F.col("_b.name")).alias("blinkit"),
            label(F.col("other_brand"), F.col("other_name")).alias("other"),
            "similarity",
        )
        .withColumn("jaccard", token_jaccard("blinkit", "other"))
        .where(F.col("jaccard") < min_overlap)
    )


def quality_summary(canonicals: DataFrame, mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Counts of the three checks, and their share of all canonicals."""

    def counted(df: DataFrame, name: str, what=F.count(F.lit(1))) -> DataFrame:
        return df.agg(what.alias("n")).withColumn("check", F.lit(name))

    parts = [
        counted(oversized_clusters(mappings), "oversized_clusters"),
        counted(
            unit_conflicts(canonicals, mappings, catalog),
            "unit_conflicts",
            F.count_distinct("canonical_id"),
        ),
        counted(low_overlap_matches(mappings, catalog), "low_overlap"),
        counted(canonicals, "total_canonicals"),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    row = stacked.agg(
        *[
            F.max(F.when(F.col("check") == c, F.col("n"))).alias(c)
            for c in ("oversized_clusters", "unit_conflicts", "low_overlap", "total_canonicals")
        ]
    )
    flagged = F.col("oversized_clusters") + F.col("unit_conflicts") + F.col("low_overlap")
    return row.withColumn("total_flagged", flagged).withColumn(
        "flagged_pct", _ratio(flagged * 100, F.col("total_canonicals"))
    )
