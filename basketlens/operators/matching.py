"""Entity resolution: anchors, candidate matching, guards, canonical assignment.

Every step runs for all categories at once; the category is a join key.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scorers import text_features
from ..functions.text import compose_text, normalize_unit, token_jaccard
from ..schemas import (
    COSINE_FLOOR,
    DENSE_WEIGHT,
    LEXICAL_WEIGHT,
    MATCH_THRESHOLD,
    MRP_TOLERANCE_PCT,
    PLATFORMS,
    TOP_K,
    UNMAPPED_TRIGGER,
)
from ..session import cut_lineage
from .catalog import unmapped_by_category, unmapped_listings
from .similarity import SetScore, cosine_pairs, rarest_first, set_top_k
from .stats import join_groups, top_n
from .tables import insert_canonicals

#: Characters kept of the error of a failing matcher.
ERROR_CHARS = 2_000


def platform_rank() -> Column:
    """0, 1, 2 in preference order; unknown platforms last."""
    rank = F.lit(len(PLATFORMS))
    for i, name in enumerate(PLATFORMS):
        rank = F.when(F.col("platform") == name, F.lit(i)).otherwise(rank)
    return rank


def choose_anchor(listings: DataFrame, by: str = "preference") -> DataFrame:
    """Add ``anchor`` (platform) and ``is_anchor`` per category.

    ``by="preference"`` takes the first present platform of the preference list.
    ``by="scan"`` knows only the top preference; without it the platform of the
    lowest id is the anchor, as in an unsorted scan.
    """
    if by == "preference":
        order = F.struct(platform_rank(), F.col("platform"))
    elif by == "scan":
        order = F.struct(
            (F.col("platform") != PLATFORMS[0]).alias("other"), F.col("id"), F.col("platform")
        )
    else:
        raise ValueError(f"unknown anchor choice {by!r}")
    # Platforms are few, so the category level is settled on a tiny table.
    per_platform = listings.groupBy("category", "platform").agg(F.min("id").alias("id"))
    anchors = per_platform.groupBy("category").agg(F.min_by("platform", order).alias("anchor"))
    return join_groups(listings, anchors, ["category"]).withColumn(
        "is_anchor", F.col("platform") == F.col("anchor")
    )


def listing_texts(listings: DataFrame) -> DataFrame:
    return listings.withColumn("text", compose_text("brand", "name", "unit"))


# --------------------------------------------------------------------- matching


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = token_jaccard):
    """Second score per candidate, four decimals.

    ``candidates``: query_id, corpus_id, query_text, corpus_text, ...  The scorer
    is a column function: a built-in expression or a ``batch_scorer`` model.
    """
    return candidates.withColumn(
        "rerank_score", F.round(scorer(F.col("query_text"), F.col("corpus_text")), 4)
    )


def match_products(
    listings: DataFrame,
    *,
    k: int = TOP_K,
    floor: float = COSINE_FLOOR,
    features: Callable[[Column], Column] = text_features,
    scorer: Callable[[Column, Column], Column] | None = None,
    use_lexical: bool = False,
    anchor_by: str = "preference",
    anchored: bool = False,
    encoder: Callable[[Column], Column] | None = None,
    search: Callable[..., DataFrame] = cosine_pairs,
) -> DataFrame:
    """Top-k anchor candidates of every non-anchor listing, all categories at once.

    Listings with the same text are matched once.  Of an anchor text only the k
    lowest listing ids can be among anybody's top k (ties go to the lower id), so
    copies are expanded to k at most and no result changes.

    ``encoder`` (a built-in expression or a ``batch_scorer`` model: text -> vector) puts
    the cosine of vectors in place of that of token sets.  ``search`` finds the vectors: all pairs
    of a category, or ``cells.nearest`` with a quantiser or a dimension bound to it.
    """
    marked = listings if anchored else choose_anchor(listings, anchor_by)
    rows = listing_texts(marked).select("category", "id", "is_anchor", "text")

    if encoder is not None:
        return _match_vectors(rows, encoder, search, k, floor, scorer)

    # Texts are composed once, by all tasks: a compact table is read by few.
    rows = cut_lineage(listing_texts(marked.repartition("id")).select(*rows.columns))
    # One document per distinct text and side; its id is the lowest listing id.
    documents = rows.groupBy("category", "is_anchor", "text").agg(F.min("id").alias("id"))
    ranked = rarest_first(
        documents.withColumn("features", features(F.col("text"))), ["category"]
    )
    # Read by both sides of the search and again to expand the copies.
    ranked = cut_lineage(ranked)
    score = SetScore(DENSE_WEIGHT, LEXICAL_WEIGHT) if use_lexical else SetScore()
    by_text = set_top_k(
        ranked.where("NOT is_anchor"), ranked.where("is_anchor"), ["category"],
        k=k, floor=floor, score=score,
    ).select(F.col("query_id").alias("query_doc"), F.col("corpus_id").alias("corpus_doc"), "score")

    candidates = candidates_of(rows, ranked, by_text, k)
    if scorer is not None:
        scored = rerank(candidates, scorer)
    else:
        scored = candidates.withColumn("rerank_score", F.round("dense_score", 4))
    return scored.withColumn("dense_score", F.round("dense_score", 4))


def candidates_of(rows: DataFrame, docs: DataFrame, by_text: DataFrame, k: int) -> DataFrame:
    """Pairs of texts as ranked candidates of listings, k per query.

    ``rows``: category, id, is_anchor, text.  ``docs``: category, is_anchor, text, id (of the
    listing that stands for the text).  ``by_text``: query_doc, corpus_doc, score.
    """
    members = rows.join(
        docs.select("category", "is_anchor", "text", F.col("id").alias("doc")),
        ["category", "is_anchor", "text"],
    )
    anchors = top_n(
        members.where("is_anchor").select(
            F.col("doc").alias("corpus_doc"), F.col("id").alias("corpus_id"),
            F.col("text").alias("corpus_text"),
        ),
        ["corpus_doc"], [F.col("corpus_id")], k, "_copy",
    ).drop("_copy")
    per_doc = top_n(
        by_text.join(anchors, "corpus_doc"),
        ["query_doc"], [F.desc("score"), F.col("corpus_id")], k, "rank",
    )
    queries = members.where("NOT is_anchor").select(
        "category", F.col("doc").alias("query_doc"), F.col("id").alias("query_id"),
        F.col("text").alias("query_text"),
    )
    return queries.join(per_doc, "query_doc").select(
        "category",
        "query_id",
        "query_text",
        "corpus_id",
        "corpus_text",
        F.col("score").alias("dense_score"),
        "rank",
    )


def _match_vectors(rows: DataFrame, encoder, search, k: int, floor: float, scorer) -> DataFrame:
    # a text is encoded once, however many listings have it, and in as many tasks as there are
    texts = rows.select("text").distinct().withColumn("vec", encoder(F.col("text")))
    vectors = cut_lineage(rows.join(texts, "text").select(*rows.columns, "vec"))
    found = search(
        vectors.where("NOT is_anchor"), vectors.where("is_anchor"), ["category"], floor=floor, k=k
    )
    q = rows.select("category", F.col("id").alias("query_id"), F.col("text").alias("query_text"))
    c = rows.select(F.col("id").alias("corpus_id"), F.col("text").alias("corpus_text"))
    candidates = found.join(q, "query_id").join(c, "corpus_id").withColumnRenamed("score", "dense_score")
    if scorer is not None:
        return rerank(candidates, scorer)
    return candidates.withColumn("rerank_score", F.round("dense_score", 4))


def compare_matchers(
    listings: DataFrame, combos: dict[str, dict], folder: str | None = None
) -> DataFrame:
    """Per matcher setting: combo, num_scores, elapsed_seconds, error.

    Each setting is one job with a tag of its own.  Its pairs are counted while they are
    written, to ``folder``/combo=<name> or nowhere.  A setting that fails, while it is planned
    or while it runs, gives a row with the error and no count; the others go on.
    """
    context = listings.sparkSession.sparkContext
    rows = []
    for name, options in combos.items():
        tag = f"compare_matchers {name}".replace(",", ";")
        seen, count, error = Observation(), None, None
        context.addJobTag(tag)
        started = time.monotonic()
        try:
            pairs = match_products(listings, **options)
            writer = pairs.observe(seen, F.count(F.lit(1)).alias("num_scores")).write.mode("overwrite")
            if folder is None:
                writer.format("noop").save()
            else:
                writer.parquet(f"{folder}/combo={quote(name)}")
            count = seen.get["num_scores"]
        except Exception as failure:  # noqa: BLE001 - a failing combo is reported, not fatal
            error = f"{type(failure).__name__}: {failure}"[:ERROR_CHARS]
        finally:
            context.removeJobTag(tag)
        rows.append((name, count, time.monotonic() - started, error))
    return listings.sparkSession.createDataFrame(
        rows, "combo string, num_scores long, elapsed_seconds double, error string"
    )


def best_match(matches: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best candidate per query at or above the threshold; the first listed wins ties.

    ``matches``: query_id, corpus_id, score, pos (order in the match list).
    """
    return (
        matches.where(F.col("score") >= threshold)
        .groupBy("query_id")
        .agg(
            F.max_by("corpus_id", F.struct("score", -F.col("pos"))).alias("corpus_id"),
            F.max("score").alias("score"),
        )
    )


def match_guards(
    best: DataFrame, catalog: DataFrame, mrp: DataFrame, tolerance: float = MRP_TOLERANCE_PCT
) -> DataFrame:
    """Add ``reject_reason``: sizes that differ, or MRPs too far apart, when both known."""
    facts = catalog.select("id", normalize_unit("unit").alias("unit")).join(
        mrp.withColumnRenamed("catalog_id", "id"), "id", "left"
    )

    def side(prefix: str) -> DataFrame:
        return facts.select(
            F.col("id").alias(f"{prefix}_id"),
            F.col("unit").alias(f"{prefix}_unit"),
            F.col("mrp").alias(f"{prefix}_mrp"),
        )

    joined = best.join(side("query"), "query_id", "left").join(side("corpus"), "corpus_id", "left")
    lower = F.least("query_mrp", "corpus_mrp")
    gap = F.abs(F.col("query_mrp") - F.col("corpus_mrp")) / F.nullif(lower, F.lit(0.0)) * 100
    reason = F.when(F.col("query_unit") != F.col("corpus_unit"), F.lit("unit mismatch")).when(
        F.col("query_mrp").isNotNull() & F.col("corpus_mrp").isNotNull() & (gap > tolerance),
        F.lit("MRP mismatch"),
    )
    return joined.withColumn("reject_reason", reason)


def assign_canonicals(
    unmapped: DataFrame,
    matches: DataFrame | None,
    catalog: DataFrame,
    mrp: DataFrame,
    *,
    threshold: float = MATCH_THRESHOLD,
    tolerance: float = MRP_TOLERANCE_PCT,
    anchor_by: str = "scan",
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonicals, mappings and per-category counts for the unmapped listings.

    Anchors found canonicals.  An accepted query joins its anchor's canonical; all
    others found their own.  A canonical's id is its founder's listing id, so the
    result is the same in every run and needs no sequence.  The match of an anchor
    that is mapped already founds a new canonical, unless ``existing`` mappings
    are given, in which case the anchor's canonical is reused.
    """
    marked = choose_anchor(unmapped, anchor_by)
    if matches is None:
        assigned = marked.withColumns(
            {"canonical_id": F.col("id"), "similarity_score": F.lit(1.0), "_joined": F.lit(False)}
        )
    else:
        # Founders, mappings and figures are made of these; match once.
        accepted = cut_lineage(
            match_guards(best_match(matches, threshold), catalog, mrp, tolerance).where(
                F.col("reject_reason").isNull()
            )
        )
        targets = marked.where("is_anchor").select(
            F.col("id").alias("corpus_id"), F.col("id").alias("target"),
            F.col("category").alias("target_category"),
        )
        if existing is not None:
            stored = existing.join(
                catalog.select(F.col("id").alias("catalog_id"), "category"), "catalog_id"
            ).select(
                F.col("catalog_id").alias("corpus_id"),
                F.col("canonical_id").alias("target"),
                F.col("category").alias("target_category"),
            )
            targets = targets.unionByName(stored)
        links = accepted.join(targets, "corpus_id").select(
            F.col("query_id").alias("id"), "target", "target_category",
            F.round("score", 4).alias("_score"),
        )
        joined = ~F.col("is_anchor") & F.coalesce(
            F.col("target_category") == F.col("category"), F.lit(False)
        )
        assigned = (
            marked.join(links, "id", "left")
            .withColumn("_joined", joined)
            .withColumn("canonical_id", F.when(F.col("_joined"), F.col("target")).otherwise(F.col("id")))
            .withColumn(
                "similarity_score", F.when(F.col("_joined"), F.col("_score")).otherwise(F.lit(1.0))
            )
        )
    founders = assigned.where("NOT _joined")
    mappings = assigned.select(F.col("id").alias("catalog_id"), "canonical_id", "similarity_score")
    stats = assigned.groupBy("category").agg(
        F.count_if(~F.col("_joined")).alias("canonical_products_created"),
        F.count(F.lit(1)).alias("mappings_created"),
        F.count_if(~F.col("_joined") & ~F.col("is_anchor")).alias("unmapped_count"),
    )
    return insert_canonicals(founders), mappings, stats


def matches_for_assignment(matched: DataFrame) -> DataFrame:
    """``match_products`` output in the shape of a match file.

    The file is sorted by score; within equal scores the lower anchor id comes
    first, which makes ``-corpus_id`` the position that matters.
    """
    return matched.select(
        "category",
        "query_id",
        "corpus_id",
        F.col("rerank_score").alias("score"),
        F.col("corpus_id").alias("pos"),
    )


def acceptable_matches(
    listings: DataFrame, threshold: float = MATCH_THRESHOLD, **match_options
) -> DataFrame:
    """Matches that assignment can accept, searched with its threshold as the floor.

    What scores lower is never assigned, and a high floor keeps prefixes short:
    at 0.8 a third of a text's features, its rarest ones, take part in the search.
    A reranker may lift a weak candidate, so with one the usual floor stays.
    """
    if "scorer" not in match_options:
        # Scores are rounded to four decimals before they meet the threshold.
        match_options.setdefault("floor", threshold - 1e-4)
    return matches_for_assignment(match_products(listings, **match_options))


def incremental_normalize(
    catalog: DataFrame,
    mappings: DataFrame,
    mrp: DataFrame,
    *,
    threshold: int = UNMAPPED_TRIGGER,
    reuse_existing: bool = False,
    **match_options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match and assign the categories with enough unmapped listings.

    Matching covers the whole category, assignment only its unmapped listings.
    A second run over its own result finds nothing left to do.
    """
    due = unmapped_by_category(catalog, mappings, threshold).select("category")
    # Matching, guards and assignment all start from this part of the catalog.
    in_scope = cut_lineage(catalog.join(due, "category", "left_semi"))
    matched = acceptable_matches(in_scope, **match_options)
    return assign_canonicals(
        unmapped_listings(in_scope, mappings),
        matched,
        in_scope,
        mrp,
        existing=mappings if reuse_existing else None,
    )
