"""Entity-resolution and match-quality queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    batch_scorer,
    compose_text,
    hashed_counts,
    normalize_unit,
    register_functions,
    text_features,
    token_jaccard,
    weight_vector,
)
from ..operators import audit as A
from ..operators import cells
from ..operators import encoding as E
from ..operators import matching as M
from ..operators import similarity as S
from ..operators import tables as W
from ..operators.catalog import latest_positive_mrp, unmapped_listings
from ..schemas import DENSE_WEIGHT, LEXICAL_WEIGHT
from ..session import cut_lineage
from .bindings import RetailTables, r6
from .brand_queries import rounded
from .oracle import unit_sql
from .registry import query

# --------------------------------------------------------------------- functions


@query("normalize_unit", f"SELECT id, unit, {unit_sql('unit')} AS unit_normalized FROM catalog")
def _(t: RetailTables) -> DataFrame:
    return t.catalog.select("id", "unit", normalize_unit("unit").alias("unit_normalized"))


@query(
    "compose_text",
    f"""SELECT id, concat_ws(' ', brand, name, {unit_sql('unit')}) AS text,
               concat_ws(' ', brand, name, coalesce({unit_sql('unit')}, unit)) AS text_raw_unit FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    return t.catalog.select(
        "id",
        compose_text("brand", "name", "unit").alias("text"),
        compose_text("brand", "name", "unit", keep_raw_unit=True).alias("text_raw_unit"),
    )


@query(
    "register_functions",
    f"""SELECT id, {unit_sql('unit')} AS unit_normalized,
               substr(md5(platform || ':' || lower(trim(name)) || ':' || lower(trim(unit))), 1, 16) AS stable_id,
               round(CASE WHEN brand IS NULL THEN 0 ELSE
                 len(list_intersect(string_split(lower(name), ' '), string_split(lower(brand || ' ' || name), ' ')))
                 / len(list_distinct(string_split(lower(brand || ' ' || name), ' ')))::DOUBLE END, 6) AS jaccard
        FROM catalog""",
)
def _(t: RetailTables) -> DataFrame:
    register_functions(t.spark)
    return t.catalog.selectExpr(
        "id",
        "normalize_unit(unit) AS unit_normalized",
        "stable_listing_id(platform, name, unit) AS stable_id",
        "round(token_jaccard(name, coalesce(concat(brand, ' ', name), '')), 6) AS jaccard",
    )


@query(
    "batch_scorer",
    "SELECT id, CAST(length(name) * 2 AS DOUBLE) AS score FROM catalog",
)
def _(t: RetailTables) -> DataFrame:
    twice = batch_scorer(lambda names: names.str.len() * 2.0, "double")
    return t.catalog.select("id", twice("name").alias("score"))


@query(
    "encode_text",
    """SELECT id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ') AS features,
              round(1 / sqrt(len(list_distinct(string_split(lower(text), ' ')))::DOUBLE), 6) AS weight
       FROM texts""",
)
def _(t: RetailTables) -> DataFrame:
    rows = M.listing_texts(t.catalog)
    weights = F.map_values(weight_vector("text"))
    return rows.select(
        "id",
        F.array_join(F.sort_array(text_features("text")), " ").alias("features"),
        r6(F.get(weights, 0), "weight"),
    )


# -------------------------------------------------------------- candidate search


@query("choose_anchor", "SELECT id, category, anchor, is_anchor FROM anchored")
def _(t: RetailTables) -> DataFrame:
    return M.choose_anchor(t.catalog).select("id", "category", "anchor", "is_anchor")


def _vectors(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """Queries and anchors, category by category; every anchor has a copy under a second id."""
    rows = t.raw("embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )
    is_anchor = F.col("id") % 3 == 0
    anchors = rows.where(is_anchor)
    again = anchors.withColumn("id", -F.col("id") - 1)
    return rows.where(~is_anchor), anchors.unionByName(again)


_COSINE = """
  SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
         list_dot_product(q.v, c.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10)
                                     * (sqrt(list_dot_product(c.v, c.v)) + 1e-10)) AS score
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 <> 0) q
       JOIN
       (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0
        UNION ALL
        SELECT -vec_id - 1, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0) c
       USING (label)"""
_TOP = f"""
  SELECT query_id, corpus_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
  FROM ({_COSINE}) WHERE score >= 0.1 QUALIFY rank <= 5"""


@query(
    "cosine_pairs",
    f"SELECT query_id, corpus_id, round(score, 6) AS score FROM ({_COSINE}) WHERE score >= 0.25",
)
def _(t: RetailTables) -> DataFrame:
    q, c = _vectors(t)
    return rounded(S.cosine_pairs(q, c, ["label"], floor=0.25), "score")


@query("topk_candidates", f"SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM ({_TOP})")
def _(t: RetailTables) -> DataFrame:
    q, c = _vectors(t)
    return rounded(S.cosine_pairs(q, c, ["label"], floor=0.1, k=5), "score")


@query(
    "topk_candidates_lsh",
    f"""SELECT count(DISTINCT query_id) AS n_queries, CAST(0 AS BIGINT) AS not_exact, true AS recall_reached
        FROM ({_TOP})""",
)
def _(t: RetailTables) -> DataFrame:
    """Pairs of the approximate search that are no pair, or have another score, and its recall."""
    q, c = _vectors(t)
    # read by the check of its scores and by the recall
    found = cut_lineage(S.approximate_top_k(q, c, ["label"], dim=64, floor=0.1, k=5, tables=24, bits=3))
    every = S.cosine_pairs(q, c, ["label"], floor=0.1, among=found).withColumnRenamed("score", "exact")
    best = S.cosine_pairs(q, c, ["label"], floor=0.1, k=5).select("query_id", "corpus_id")
    key = ["query_id", "corpus_id"]
    right = F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-9, F.lit(False))
    checked = found.join(every, key, "left").agg(F.count_if(~right).alias("not_exact"))
    hit = best.join(found.select(*key, F.lit(1).alias("hit")), key, "left").agg(
        F.count_distinct("query_id").alias("n_queries"),
        (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )
    return hit.crossJoin(checked)


@query("topk_candidates_cells", f"SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM ({_TOP})")
def _(t: RetailTables) -> DataFrame:
    q, c = _vectors(t)
    return rounded(cells.nearest(q, c, ["label"], dim=64, floor=0.1, k=5, exact=True), "score")


@query("topk_candidates_probed")
def _(t: RetailTables) -> DataFrame:
    """The five nearest other vectors that 96 probes find for every id divisible by 20."""
    rows = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    quantiser = cells.fit(rows, 64, cell_rows=8)
    found = cells.nearest(rows.where("id % 20 = 0"), rows, [], quantiser=quantiser, probes=96, k=6, floor=-1.0)
    return S.best_k(found.where("query_id <> corpus_id"), 5)


_MATCHED = """SELECT category, query_id, corpus_id, query_text, corpus_text, rank,
  round(score, 4) AS dense_score"""


@query("match_products", f"{_MATCHED}, round(score, 4) AS rerank_score FROM matched")
def _(t: RetailTables) -> DataFrame:
    return M.match_products(t.catalog)


_JACCARD = """round(len(list_intersect(string_split(lower(query_text), ' '), string_split(lower(corpus_text), ' ')))
  / len(list_distinct(list_concat(string_split(lower(query_text), ' '),
                                  string_split(lower(corpus_text), ' '))))::DOUBLE, 4)"""


@query("rerank", f"{_MATCHED}, {_JACCARD} AS rerank_score FROM matched")
def _(t: RetailTables) -> DataFrame:
    return M.match_products(t.catalog, scorer=token_jaccard)


@query(
    "hybrid_score",
    """SELECT * FROM (WITH words AS (
         SELECT id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM texts),
       idf AS (
         SELECT w, ln((SELECT count(*) FROM texts) / count(*)::DOUBLE) + 1 AS weight
         FROM words GROUP BY w)
       SELECT query_id, corpus_id, round(score, 6) AS score, round(coalesce(lexical, 0), 6) AS lexical_score,
              round(0.7 * score + 0.3 * coalesce(lexical, 0), 6) AS hybrid_score
       FROM matched LEFT JOIN (
         SELECT query_id, corpus_id, sum(weight * weight) AS lexical
         FROM matched JOIN words a ON a.id = query_id JOIN words b ON b.id = corpus_id AND a.w = b.w
           JOIN idf ON idf.w = a.w
         GROUP BY query_id, corpus_id) USING (query_id, corpus_id))""",
)
def _(t: RetailTables) -> DataFrame:
    texts = M.listing_texts(t.catalog).select("id", "text")
    weights = S.idf_weights(texts)
    pairs = M.match_products(t.catalog).select("query_id", "corpus_id", "query_text", "corpus_text")
    q, c = text_features("query_text"), text_features("corpus_text")
    shared = F.size(F.array_intersect(q, c))
    dense = shared / F.sqrt((F.size(q) * F.size(c)).cast("double"))
    pairs = pairs.select("query_id", "corpus_id", dense.alias("score"))
    blended = S.hybrid_score(pairs, weights, DENSE_WEIGHT, LEXICAL_WEIGHT)
    return rounded(blended, "score", "lexical_score", "hybrid_score")


_DENSE = '''
  SELECT category, query_id, corpus_id, rank, round(score, 6) AS dense_score FROM (
    SELECT q.category, q.id AS query_id, a.id AS corpus_id,
           row_number() OVER (PARTITION BY q.id ORDER BY
             list_dot_product(q.v, a.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10)
                                         * (sqrt(list_dot_product(a.v, a.v)) + 1e-10)) DESC, a.id) AS rank,
           list_dot_product(q.v, a.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10)
                                       * (sqrt(list_dot_product(a.v, a.v)) + 1e-10)) AS score
    FROM {v} q JOIN {v} a ON a.category = q.category AND a.is_anchor AND NOT q.is_anchor)
  WHERE rank <= 5 AND score >= 0.4'''.format(v='''(
    SELECT id, category, is_anchor, list_transform(range(64), lambda j: CAST(
      len(list_filter(string_split(lower(text), ' '),
                      lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64 = j)) AS DOUBLE)) AS v
    FROM anchored)''')


@query("match_products_dense", _DENSE)
def _(t: RetailTables) -> DataFrame:
    found = M.match_products(t.catalog, encoder=hashed_counts)
    return rounded(found.select("category", "query_id", "corpus_id", "rank", "dense_score"), "dense_score")


@query("match_products_cells", _DENSE)
def _(t: RetailTables) -> DataFrame:
    search = partial(cells.nearest, dim=64, exact=True)
    found = M.match_products(t.catalog, encoder=hashed_counts, search=search)
    return rounded(found.select("category", "query_id", "corpus_id", "rank", "dense_score"), "dense_score")


def _features_sql(ngram: bool) -> str:
    """Distinct words of the anchored texts, with character 3-grams if asked."""
    grams = ''', list_transform(range(1, greatest(len(array_to_string(w, ' ')) - 2, 1) + 1),
                lambda i: '#' || substr(array_to_string(w, ' '), i, 3))'''
    return f'''SELECT id, category, is_anchor, w, list_distinct(list_concat(w{grams if ngram else ''})) AS f
      FROM (SELECT *, list_filter(s, lambda x, i: list_position(s, x) = i) AS w
            FROM (SELECT *, string_split(lower(text), ' ') AS s FROM anchored))'''


def _scored_sql(dense: float, lexical: float, floor: float, ngram: bool) -> str:
    return f'''SELECT category, query_id, corpus_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
      FROM (
        SELECT q.category, q.id AS query_id, a.id AS corpus_id,
               {dense}::DOUBLE * (len(list_intersect(q.f, a.f)) / sqrt(CAST(len(q.f) * len(a.f) AS DOUBLE)))
               + {lexical}::DOUBLE * (len(list_intersect(q.w, a.w)) / sqrt(CAST(len(q.w) * len(a.w) AS DOUBLE)))
                 AS score
        FROM ({_features_sql(ngram)}) q JOIN ({_features_sql(ngram)}) a
          ON a.category = q.category AND a.is_anchor AND NOT q.is_anchor)
      WHERE score >= {floor}::DOUBLE QUALIFY rank <= 5'''


_NGRAM = f'''SELECT category, query_id, corpus_id, rank, round(score, 4) AS score
  FROM ({_scored_sql(0.7, 0.3, 0.6, True)})'''
_COMPARED = f'''
  SELECT 'tokens' AS combo, count(*) AS num_scores, false AS failed FROM matched
  UNION ALL SELECT 'tokens + jaccard', count(*), false FROM matched
  UNION ALL SELECT 'blended', count(*), false FROM ({_scored_sql(0.7, 0.3, 0.4, False)})
  UNION ALL SELECT 'no model', NULL, true'''


@query("match_products_ngram", _NGRAM)
def _(t: RetailTables) -> DataFrame:
    found = M.match_products(
        t.catalog, features=lambda text: text_features(text, 3), use_lexical=True, floor=0.6
    )
    score = F.col("dense_score")
    return found.select("category", "query_id", "corpus_id", "rank", score.alias("score"))


@query("compare_matchers", _COMPARED)
def _(t: RetailTables) -> DataFrame:
    compared = M.compare_matchers(
        t.catalog,
        {
            "tokens": {},
            "tokens + jaccard": {"scorer": token_jaccard},
            "blended": {"use_lexical": True},
            "no model": {"encoder": lambda text: F.raise_error(F.concat(F.lit("no model for "), text)).cast("array<double>")},
        },
    )
    return compared.select("combo", "num_scores", F.col("error").isNotNull().alias("failed"))


def _vectors_sql() -> str:
    """Hashed TF-IDF of unit length by (id, term)."""
    return f'''SELECT * FROM (
      WITH tf AS (
        SELECT id, term, count(*) AS tf FROM (
          SELECT id, CAST('0x' || substr(md5(u), 1, 6) AS BIGINT) % {E.DIM} AS term
          FROM (SELECT id, unnest(f) AS u FROM ({_features_sql(True)})))
        GROUP BY id, term),
      idf AS (
        SELECT term, ln((1 + (SELECT count(*) FROM anchored)) / (1 + count(*))::DOUBLE) + 1 AS idf
        FROM tf GROUP BY term)
      SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight
      FROM tf JOIN idf USING (term))'''


@query("encode_tfidf", f"SELECT id, CAST(term AS INT) AS term, round(weight, 6) AS weight FROM ({_vectors_sql()})")
def _(t: RetailTables) -> DataFrame:
    texts = M.listing_texts(t.catalog).select("id", "text")
    vectors = E.encode_texts(texts, cut_lineage(E.fit_idf(texts)))
    entries = vectors.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    return rounded(entries.select("id", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight")), "weight")


@query(
    "hybrid_score_tfidf",
    f"""SELECT query_id, corpus_id, round(score, 4) AS score, round(coalesce(lexical, 0), 6) AS lexical_score
        FROM matched LEFT JOIN (
          SELECT m.query_id, m.corpus_id, sum(a.weight * b.weight) AS lexical
          FROM matched m JOIN ({_vectors_sql()}) a ON a.id = m.query_id
            JOIN ({_vectors_sql()}) b ON b.id = m.corpus_id AND b.term = a.term
          GROUP BY ALL) USING (query_id, corpus_id)""",
)
def _(t: RetailTables) -> DataFrame:
    texts = M.listing_texts(t.catalog).select("id", "text")
    vectors = cut_lineage(E.encode_texts(texts, cut_lineage(E.fit_idf(texts))))
    pairs = M.match_products(t.catalog).select("query_id", "corpus_id", F.col("dense_score").alias("score"))
    blended = S.hybrid_score(pairs, E.as_weights(vectors), DENSE_WEIGHT, LEXICAL_WEIGHT)
    return rounded(blended.select("query_id", "corpus_id", "score", "lexical_score"), "lexical_score")


# -------------------------------------------------------------------- assignment


def _matches(t: RetailTables) -> DataFrame:
    return M.acceptable_matches(t.catalog)


@query("best_match", "SELECT query_id, corpus_id, score FROM best")
def _(t: RetailTables) -> DataFrame:
    return M.best_match(_matches(t))


@query("match_guards", "SELECT query_id, corpus_id, score, reject_reason FROM guarded")
def _(t: RetailTables) -> DataFrame:
    guarded = M.match_guards(
        M.best_match(_matches(t)), t.catalog, latest_positive_mrp(t.obs)
    )
    return guarded.select("query_id", "corpus_id", "score", "reject_reason")


@query(
    "assign_canonicals",
    "SELECT id AS catalog_id, canonical_id, CAST(similarity_score AS DOUBLE) AS similarity_score FROM assigned",
)
def _(t: RetailTables) -> DataFrame:
    _, mappings, _ = M.assign_canonicals(
        t.catalog, _matches(t), t.catalog, latest_positive_mrp(t.obs)
    )
    return mappings


@query(
    "assign_canonicals_stats",
    """SELECT category, count(*) FILTER (NOT joined) AS canonical_products_created,
              count(*) AS mappings_created,
              count(*) FILTER (NOT joined AND NOT is_anchor) AS unmapped_count
       FROM assigned GROUP BY category""",
)
def _(t: RetailTables) -> DataFrame:
    _, _, stats = M.assign_canonicals(
        t.catalog, _matches(t), t.catalog, latest_positive_mrp(t.obs)
    )
    return stats


@query(
    "assign_without_matches",
    """SELECT category, count(*) AS canonical_products_created, count(*) AS mappings_created,
              count(*) FILTER (NOT is_anchor) AS unmapped_count FROM anchored GROUP BY category""",
)
def _(t: RetailTables) -> DataFrame:
    _, _, stats = M.assign_canonicals(t.catalog, None, t.catalog, latest_positive_mrp(t.obs))
    return stats


_INCREMENTAL = """
  SELECT u.id AS catalog_id,
         coalesce(CASE WHEN u.platform <> u.anchor THEN x.id END, u.id) AS canonical_id,
         CASE WHEN u.platform <> u.anchor AND x.id IS NOT NULL THEN g.score ELSE 1.0 END::DOUBLE
           AS similarity_score
  FROM unmapped u
  LEFT JOIN guarded g ON g.query_id = u.id AND g.reject_reason IS NULL
  LEFT JOIN unmapped x ON x.id = g.corpus_id AND x.platform = x.anchor AND x.category = u.category"""
_UNMAPPED = """
  SELECT c.*, CASE WHEN bool_or(platform = 'blinkit') OVER (PARTITION BY category) THEN 'blinkit'
                   ELSE first_value(platform) OVER (PARTITION BY category ORDER BY id) END AS anchor
  FROM catalog c WHERE id NOT IN (SELECT catalog_id FROM mappings)
  QUALIFY count(*) OVER (PARTITION BY category) >= 5"""


@query("incremental_normalize", f"SELECT * FROM (WITH unmapped AS ({_UNMAPPED}) {_INCREMENTAL})")
def _(t: RetailTables) -> DataFrame:
    _, mappings, _ = M.incremental_normalize(
        t.catalog, t.mappings, latest_positive_mrp(t.obs)
    )
    return mappings


# ----------------------------------------------------------------------- quality

_AMBIGUOUS = """
  SELECT a.catalog_id AS catalog_id_a, b.catalog_id AS catalog_id_b, a.brand AS brand_a, b.brand AS brand_b,
         a.unit AS unit_a, b.unit AS unit_b, b.canonical_id, b.similarity_score AS similarity
  FROM cluster b JOIN (
    SELECT * FROM cluster WHERE platform = 'blinkit'
    QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY catalog_id) = 1) a
    ON a.canonical_id = b.canonical_id
  WHERE b.similarity_score >= 0.80::DOUBLE AND b.similarity_score < 0.85::DOUBLE"""


def _pairs(t: RetailTables) -> DataFrame:
    return A.ambiguous_pairs(t.mappings, t.catalog)


@query(
    "ambiguous_pairs",
    f"""SELECT catalog_id_a, catalog_id_b, canonical_id, unit_a, unit_b, round(similarity, 6) AS similarity
        FROM ({_AMBIGUOUS})""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(_pairs(t), "similarity").select(
        "catalog_id_a", "catalog_id_b", "canonical_id", "unit_a", "unit_b", "similarity"
    )


def _verdicts(t: RetailTables) -> DataFrame:
    """A judge that goes by brand; pairs without both brands stay unjudged."""
    return (
        _pairs(t)
        .where(F.col("brand_a").isNotNull() & F.col("brand_b").isNotNull())
        .select(
            "catalog_id_a", "catalog_id_b", (F.col("brand_a") == F.col("brand_b")).alias("is_match")
        )
    )


@query(
    "apply_verdicts",
    f"""SELECT catalog_id_a, catalog_id_b, coalesce(brand_a = brand_b, false) AS verified_strict,
               coalesce(brand_a = brand_b, true) AS verified_lenient FROM ({_AMBIGUOUS})""",
)
def _(t: RetailTables) -> DataFrame:
    keys = ["catalog_id_a", "catalog_id_b"]
    strict = A.apply_verdicts(_pairs(t), _verdicts(t), missing_verdict=False)
    lenient = A.apply_verdicts(
        strict.withColumnRenamed("verified", "verified_strict"), _verdicts(t), missing_verdict=True
    )
    return lenient.select(*keys, "verified_strict", F.col("verified").alias("verified_lenient"))


@query(
    "drop_rejected_mappings",
    f"""SELECT catalog_id, canonical_id FROM mappings
        WHERE catalog_id NOT IN (SELECT catalog_id_b FROM ({_AMBIGUOUS}) WHERE brand_a <> brand_b)""",
)
def _(t: RetailTables) -> DataFrame:
    return W.drop_rejected_mappings(t.mappings, _verdicts(t)).select("catalog_id", "canonical_id")


@query(
    "export_judge_pairs",
    f"""SELECT catalog_id_a AS pair_id, catalog_id_a, catalog_id_b, round(similarity, 4) AS similarity,
               CASE WHEN brand_a = brand_b THEN 'YES' WHEN brand_a <> brand_b THEN 'NO' END AS truth_verdict
        FROM ({_AMBIGUOUS})""",
)
def _(t: RetailTables) -> DataFrame:
    pairs = W.judge_pairs(_pairs(t), _verdicts(t))
    return pairs.select(
        "pair_id", "catalog_id_a", "catalog_id_b", F.round("similarity", 4).alias("similarity"),
        "truth_verdict",
    )


def _truth(t: RetailTables) -> DataFrame:
    return _pairs(t).select(
        "catalog_id_a", "catalog_id_b", (F.col("similarity") >= 0.82).alias("is_match")
    )


_CONFUSION = f"""
  SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp,
         count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn
  FROM (SELECT brand_a = brand_b AS p, similarity >= 0.82::DOUBLE AS a FROM ({_AMBIGUOUS})
        WHERE brand_a IS NOT NULL AND brand_b IS NOT NULL)"""


@query(
    "judge_benchmark",
    f"""SELECT tp, fp, tn, fn, tp + fp + tn + fn AS total_pairs,
               round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0), 6) AS accuracy,
               round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
               round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
               coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 0) >= 0.95 AS passed
        FROM ({_CONFUSION})""",
)
def _(t: RetailTables) -> DataFrame:
    result = A.judge_benchmark(_verdicts(t), _truth(t))
    return rounded(result, "accuracy", "precision", "recall", "f1")


@query(
    "judge_mismatches",
    f"""SELECT catalog_id_a, catalog_id_b,
               CASE WHEN similarity >= 0.82::DOUBLE THEN 'false_negative' ELSE 'false_positive' END AS type
        FROM ({_AMBIGUOUS})
        WHERE (brand_a = brand_b) <> (similarity >= 0.82::DOUBLE)
        ORDER BY catalog_id_a, catalog_id_b LIMIT 20""",
)
def _(t: RetailTables) -> DataFrame:
    return A.judge_mismatches(_verdicts(t), _truth(t))


def _position_pairs(t: RetailTables) -> DataFrame:
    """A part's blinkit and zepto listings are the true pairs, by source position."""
    listings = t.catalog.select(
        "platform", F.col("platform_product_id").cast("bigint").alias("pos"), "id"
    )
    index = t.raw("part").select(
        F.lit("blinkit").alias("platform_a"), F.col("p_partkey").alias("pos_a"),
        F.lit("zepto").alias("platform_b"), F.col("p_partkey").alias("pos_b"),
    )
    return A.ground_truth_pairs(listings, index)


_TRUE_PAIRS = """
  SELECT b.id AS id_a, z.id AS id_b FROM catalog b JOIN catalog z
    ON z.platform_product_id = b.platform_product_id AND z.platform = 'zepto'
  WHERE b.platform = 'blinkit'"""


@query("ground_truth_pairs", _TRUE_PAIRS)
def _(t: RetailTables) -> DataFrame:
    return _position_pairs(t)


_ACTUAL_PAIRS = """
  SELECT corpus_id AS id_a, query_id AS id_b FROM best JOIN catalog c ON c.id = query_id
  WHERE c.platform = 'zepto'"""


def _actual_pairs(t: RetailTables) -> DataFrame:
    zepto = t.catalog.where(F.col("platform") == "zepto").select(F.col("id").alias("query_id"))
    best = M.best_match(_matches(t)).join(zepto, "query_id")
    return best.select(F.col("corpus_id").alias("id_a"), F.col("query_id").alias("id_b"))


@query(
    "pair_set_algebra",
    f"""SELECT id_a, id_b, CASE WHEN t IS NULL THEN 'fp' WHEN a IS NULL THEN 'fn' ELSE 'tp' END AS outcome
        FROM (SELECT *, 1 AS t FROM ({_TRUE_PAIRS})) FULL JOIN (SELECT *, 1 AS a FROM ({_ACTUAL_PAIRS}))
          USING (id_a, id_b)""",
)
def _(t: RetailTables) -> DataFrame:
    return A.pair_set_rows(_position_pairs(t), _actual_pairs(t))


@query(
    "pair_set_counts",
    f"""SELECT count(*) FILTER (t IS NOT NULL AND a IS NOT NULL) AS tp,
               count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn
        FROM (SELECT *, 1 AS t FROM ({_TRUE_PAIRS})) FULL JOIN (SELECT *, 1 AS a FROM ({_ACTUAL_PAIRS}))
          USING (id_a, id_b)""",
)
def _(t: RetailTables) -> DataFrame:
    return A.pair_set_counts(_position_pairs(t), _actual_pairs(t))


_SWEEP_AT = (0.10, 0.15, 0.20, 0.25, 0.30)


def _sweep(t: RetailTables) -> DataFrame:
    """A query's true partner is the first anchor with its label."""
    q, c = _vectors(t)
    first = c.groupBy("label").agg(F.min("id").alias("corpus_id"))
    truth = q.select(F.col("id").alias("query_id"), "label").join(first, "label")
    scored = S.cosine_pairs(q, c, ["label"], floor=0.1, k=5)
    return A.threshold_sweep(scored, truth, _SWEEP_AT)


_SWEEP = f"""
  WITH sweep_truth AS (
    SELECT q.vec_id AS query_id, min(-c.vec_id - 1) AS corpus_id
    FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id % 3 = 0
    WHERE q.vec_id % 3 <> 0 GROUP BY q.vec_id),
  sweep_best AS (SELECT query_id, corpus_id, score FROM ({_TOP}) WHERE rank = 1),
  sweep_counts AS (
    SELECT th::DOUBLE AS threshold, count(*) FILTER (b.score >= th AND t.corpus_id = b.corpus_id) AS tp,
           count(*) FILTER (b.score >= th) AS found, (SELECT count(*) FROM sweep_truth) AS n_true
    FROM sweep_best b LEFT JOIN sweep_truth t USING (query_id),
         (SELECT unnest([0.10::DOUBLE, 0.15::DOUBLE, 0.20::DOUBLE, 0.25::DOUBLE, 0.30::DOUBLE]) AS th)
    GROUP BY th)
  SELECT threshold, tp, found - tp AS fp, n_true - tp AS fn,
         coalesce(tp / nullif(found, 0)::DOUBLE, 0) AS precision, tp / n_true::DOUBLE AS recall,
         coalesce(2.0 * tp / nullif(found + n_true, 0), 0) AS f1
  FROM sweep_counts"""


@query(
    "threshold_sweep",
    f"""SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1 FROM ({_SWEEP})""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(_sweep(t), "precision", "recall", "f1")


@query(
    "recommend_threshold",
    f"""SELECT b.threshold AS recommended, round(b.f1, 6) AS f1,
               round((b.precision - c.precision) * 100, 6) AS precision_gain,
               round((c.recall - b.recall) * 100, 6) AS recall_loss
        FROM (SELECT * FROM ({_SWEEP}) ORDER BY round(f1, 12) DESC, threshold LIMIT 1) b,
             (SELECT * FROM ({_SWEEP}) WHERE abs(threshold - 0.2) < 0.001) c""",
)
def _(t: RetailTables) -> DataFrame:
    found = A.recommend_threshold(_sweep(t), current=0.20)
    return rounded(found, "f1", "precision_gain", "recall_loss")


_OVERSIZED = "SELECT canonical_id, count(*) AS cnt FROM mappings GROUP BY canonical_id HAVING count(*) > 3"


@query("oversized_clusters", _OVERSIZED)
def _(t: RetailTables) -> DataFrame:
    return A.oversized_clusters(t.mappings)


_CONFLICTS = f"""
  SELECT canonical_id, unit, n_units, trim(coalesce(p.brand, '') || ' ' || p.canonical_name) AS name
  FROM (SELECT canonical_id, unit, count(*) OVER (PARTITION BY canonical_id) AS n_units
        FROM (SELECT DISTINCT canonical_id, {unit_sql('unit')} AS unit FROM cluster)
        WHERE unit IS NOT NULL) u
  JOIN canonicals p ON p.id = u.canonical_id WHERE n_units > 1"""


@query("unit_conflicts", f"SELECT * FROM ({_CONFLICTS})")
def _(t: RetailTables) -> DataFrame:
    return A.unit_conflicts(t.canonicals, t.mappings, t.catalog)


_LOW = """
  SELECT * FROM (
    SELECT canonical_id, other_name, blinkit, other, similarity,
           len(list_intersect(string_split(lower(blinkit), ' '), string_split(lower(other), ' ')))
           / len(list_distinct(list_concat(string_split(lower(blinkit), ' '),
                                           string_split(lower(other), ' '))))::DOUBLE AS jaccard
    FROM (SELECT o.canonical_id, o.name AS other_name, o.similarity_score AS similarity,
                 trim(coalesce(b.brand, '') || ' ' || b.name) AS blinkit,
                 trim(coalesce(o.brand, '') || ' ' || o.name) AS other
          FROM cluster b JOIN cluster o ON o.canonical_id = b.canonical_id AND o.catalog_id <> b.catalog_id
          WHERE b.platform = 'blinkit' AND o.similarity_score >= 0.80::DOUBLE AND o.similarity_score < 1.0
          QUALIFY row_number() OVER (PARTITION BY o.canonical_id, o.name
                                     ORDER BY o.catalog_id, b.catalog_id) = 1))
  WHERE jaccard < 0.30"""


@query(
    "low_overlap_matches",
    f"""SELECT canonical_id, blinkit, other, round(similarity, 6) AS similarity, round(jaccard, 6) AS jaccard
        FROM ({_LOW})""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(A.low_overlap_matches(t.mappings, t.catalog), "similarity", "jaccard")


@query(
    "quality_summary",
    f"""SELECT oversized_clusters, unit_conflicts, low_overlap, total_canonicals,
               oversized_clusters + unit_conflicts + low_overlap AS total_flagged,
               round((oversized_clusters + unit_conflicts + low_overlap) * 100
                     / total_canonicals::DOUBLE, 6) AS flagged_pct
        FROM (SELECT (SELECT count(*) FROM ({_OVERSIZED})) AS oversized_clusters,
                     (SELECT count(DISTINCT canonical_id) FROM ({_CONFLICTS})) AS unit_conflicts,
                     (SELECT count(*) FROM ({_LOW})) AS low_overlap,
                     (SELECT count(*) FROM canonicals) AS total_canonicals)""",
)
def _(t: RetailTables) -> DataFrame:
    return rounded(A.quality_summary(t.canonicals, t.mappings, t.catalog), "flagged_pct")


@query(
    "unmapped_after_assignment",
    "SELECT count(*) AS still_unmapped FROM catalog c WHERE c.id NOT IN (SELECT id FROM assigned)",
)
def _(t: RetailTables) -> DataFrame:
    _, mappings, _ = M.assign_canonicals(
        t.catalog, _matches(t), t.catalog, latest_positive_mrp(t.obs)
    )
    return unmapped_listings(t.catalog, mappings).agg(F.count(F.lit(1)).alias("still_unmapped"))
