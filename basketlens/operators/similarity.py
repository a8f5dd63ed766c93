"""Exact top-k similarity joins that never emit all pairs of a group.

Rows of both sides are hashed into cells of bounded size and each cell is scored
as one numpy block that hands on at most k candidates per query.  A hot group
only means more cells.  Sparse token sets are first cut down with a prefix
filter: two sets that reach the floor share one of their rarest tokens, so a pair
is looked at only where it can still win.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scorers import text_features
from ..functions.text import cosine
from ..schemas import COSINE_FLOOR, TOP_K
from ..session import cut_lineage
from .stats import join_groups, top_n

#: Rows of a block of a key; a key of more than SIDE_BLOCKS blocks gets larger ones, up to MOST_ROWS,
#: as each row is copied once per block of the other side.
BLOCK_ROWS, SIDE_BLOCKS, MOST_ROWS = 1024, 16, 8192
HOT_FEATURE = 512
#: Floors that a search for k rows tries before its own.
HIGH_FLOORS = (0.8, 0.6)
EPS = 1e-10

Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


# ---------------------------------------------------------------- block scorers


def dense_cosine(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    def unit(rows: pd.Series) -> np.ndarray:
        m = np.asarray(rows.tolist(), dtype=np.float64)
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)

    return unit(q["vec"]) @ unit(c["vec"]).T


def _incidence(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(f) for f in q] + [len(f) for f in c]
    flat = np.concatenate([*q, *c]) if sum(sizes) else np.array([], dtype=object)
    _, codes = np.unique(flat if flat.dtype.kind == "i" else flat.astype(str), return_inverse=True)
    m = np.zeros((len(sizes), int(codes.max()) + 1 if len(codes) else 1), dtype=np.float32)
    m[np.repeat(np.arange(len(sizes)), sizes), codes] = 1.0
    return m[: len(q)], m[len(q) :]


def set_cosine(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """|A and B| / sqrt(|A| |B|): the cosine of two binary token vectors."""
    mq, mc = _incidence(q["features"], c["features"])
    nq, nc = mq.sum(axis=1, dtype=np.float64), mc.sum(axis=1, dtype=np.float64)
    return (mq @ mc.T).astype(np.float64) / np.sqrt(np.maximum(np.outer(nq, nc), 1.0))


def lexical_dot(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """Sum of weight products over shared tokens (``weights``: list of pairs)."""

    def as_dict(rows) -> list[dict]:
        return [dict(r) for r in rows]

    dq, dc = as_dict(q["weights"]), as_dict(c["weights"])
    vocab = {t: i for i, t in enumerate({t for d in dq + dc for t in d})}
    m = np.zeros((len(dq) + len(dc), max(len(vocab), 1)))
    for i, d in enumerate(dq + dc):
        for token, w in d.items():
            m[i, vocab[token]] = w
    return m[: len(dq)] @ m[len(dq) :].T


def hybrid(dense_weight: float, lexical_weight: float) -> Scorer:
    def score(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
        return dense_weight * dense_cosine(q, c) + lexical_weight * lexical_dot(q, c)

    return score


def _cell_top_k(scorer: Scorer, k: int | None, floor: float):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "corpus_id": [], "score": []}).astype(
                {"query_id": "int64", "corpus_id": "int64", "score": "float64"}
            )
        c = c.sort_values("id", kind="stable")
        # a block of one side is in memory whole, its scores are not
        parts = [part_of(q.iloc[at : at + BLOCK_ROWS], c) for at in range(0, len(q), BLOCK_ROWS)]
        return pd.concat(parts, ignore_index=True)

    def part_of(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        scores = scorer(q, c)
        if k is None or k >= len(c):
            qi, ci = np.nonzero(scores >= floor)
        else:
            kth = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k, None]
            qi, ci = np.nonzero(scores >= np.maximum(kth, floor))
            # Ascending ids: equal scores go to the lower id.
            order = np.lexsort((ci, -scores[qi, ci], qi))
            qi, ci = qi[order], ci[order]
            first = np.searchsorted(qi, qi)
            keep = np.arange(len(qi)) - first < k
            qi, ci = qi[keep], ci[keep]
        return pd.DataFrame(
            {
                "query_id": q["id"].to_numpy()[qi],
                "corpus_id": c["id"].to_numpy()[ci],
                "score": scores[qi, ci],
            }
        )

    return run


# ------------------------------------------------------------------- cell layout


def blocks_of(rows: Column, block_rows: int = BLOCK_ROWS, most_rows: int = MOST_ROWS) -> Column:
    """Blocks for a number of rows: ``SIDE_BLOCKS`` at most, until a block has ``most_rows``."""
    size = F.greatest(F.lit(block_rows), F.least(F.lit(most_rows), F.ceil(rows / SIDE_BLOCKS)))
    return F.ceil(rows / size).cast("int")


def _block_counts(df: DataFrame, keys: list[str], name: str, block_rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(blocks_of(F.count(F.lit(1)), block_rows).alias(name))


def _own_block(n_blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(n_blocks)).cast("int")


def cell_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    scorer: Scorer,
    *,
    k: int | None = TOP_K,
    floor: float = COSINE_FLOOR,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, corpus_id, score) candidates of all rows that share ``keys``.

    A key with n rows gets ceil(n / block_rows) hash blocks per side, fewer larger ones if
    these are many (:func:`blocks_of`); each query block meets each corpus block once.  Keys without a partner are dropped before
    anything is copied.  Candidates hold every query's top k over the key.
    """
    q_blocks = _block_counts(queries, keys, "_qb", block_rows)
    c_blocks = _block_counts(corpus, keys, "_cb", block_rows)
    if keys:
        sizes = q_blocks.join(c_blocks, keys)
        q, c = join_groups(queries, sizes, keys), join_groups(corpus, sizes, keys)
    else:
        layout = {"_qb": q_blocks.scalar(), "_cb": c_blocks.scalar()}
        q, c = queries.withColumns(layout), corpus.withColumns(layout)
    return _score_cells(q, c, keys, scorer, k, floor)


def _score_cells(
    queries: DataFrame, corpus: DataFrame, keys: list[str], scorer: Scorer, k: int | None, floor: float
) -> DataFrame:
    """Score rows whose key is laid out in ``_qb`` x ``_cb`` cells."""

    def spread(rows: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return (
            rows.withColumn(own, _own_block(own_blocks))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
            .drop("_qb", "_cb")
        )

    q = spread(queries, "_q", "_qb", "_c", "_cb")
    c = spread(corpus, "_c", "_cb", "_q", "_qb")
    # Both sides often come from one table; fresh names keep their columns apart.
    c = c.select(*[F.col(name).alias(name) for name in c.columns])
    cell = [*keys, "_q", "_c"]
    return (
        q.groupBy(*cell)
        .cogroup(c.groupBy(*cell))
        .applyInPandas(
            _cell_top_k(scorer, k, floor), "query_id BIGINT, corpus_id BIGINT, score DOUBLE"
        )
    )


def best_k(candidates: DataFrame, k: int) -> DataFrame:
    """k best corpus rows per query; equal scores go to the lower corpus id."""
    once = candidates.groupBy("query_id", "corpus_id").agg(F.max("score").alias("score"))
    return top_n(once, ["query_id"], [F.desc("score"), F.col("corpus_id")], k, "rank")


# ---------------------------------------------------------------------- dense


def collapse_copies(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One row per distinct value and key: lowest id and number of copies."""
    return rows.groupBy(*keys, value).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )


def cosine_pairs(
    queries: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    *,
    floor: float = COSINE_FLOOR,
    k: int | None = None,
    block_rows: int = BLOCK_ROWS,
    among: DataFrame | None = None,
) -> DataFrame:
    """Cosine of (query, corpus) pairs of a key that reach the floor.

    ``queries``/``corpus``: id, keys, vec.  Equal vectors are scored once and stand for
    all their ids afterwards.  With ``k`` only each query's k best pairs come out, which
    keeps the result linear in the queries.  So does ``among`` (query_id, corpus_id): only these
    pairs are asked for, and no others are scored.
    """
    if among is not None:
        if k is not None:
            raise ValueError("give k or the pairs, not both")
        return _cosine_among(among, queries, corpus, keys, floor)
    q, c = collapse_copies(queries, "vec", keys), collapse_copies(corpus, "vec", keys)
    pairs = cell_top_k(
        q.drop("copies"), c.drop("copies"), keys, dense_cosine, k=k, floor=floor, block_rows=block_rows
    )
    return expand_copies(pairs, members(queries, q, keys), members(corpus, c, keys), k)


def _cosine_among(
    pairs: DataFrame, queries: DataFrame, corpus: DataFrame, keys: list[str], floor: float
) -> DataFrame:
    def side(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
        return rows.select(F.col("id").alias(id_col), F.col("vec").alias(vec), *[F.col(x).alias(f"_{vec}_{x}") for x in keys])

    met = (
        pairs.select("query_id", "corpus_id").distinct()
        .join(side(queries, "query_id", "q"), "query_id")
        .join(side(corpus, "corpus_id", "c"), "corpus_id")
    )
    for x in keys:
        met = met.where(F.col(f"_q_{x}") == F.col(f"_c_{x}"))
    return met.select("query_id", "corpus_id", cosine("q", "c").alias("score")).where(F.col("score") >= floor)


def members(rows: DataFrame, collapsed: DataFrame, keys: list[str]) -> DataFrame:
    """(doc, id): the id that stands for a value, and every id that has it."""
    docs = collapsed.select(*keys, "vec", F.col("id").alias("doc"))
    return rows.select(*keys, "vec", "id").join(docs, [*keys, "vec"]).select("doc", "id")


def expand_copies(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int | None) -> DataFrame:
    """Pairs of values as pairs of ids; of equal corpus rows the k lowest ids are enough."""
    if k is not None:
        corpus = top_n(corpus, ["doc"], [F.col("id")], k, "_copy").drop("_copy")
        pairs = best_k(pairs, k).drop("rank")
    c = corpus.select(F.col("doc").alias("corpus_id"), F.col("id").alias("_corpus"))
    found = pairs.join(c, "corpus_id").select("query_id", F.col("_corpus").alias("corpus_id"), "score")
    if k is not None:
        found = best_k(found, k)
    rest = [x for x in found.columns if x != "query_id"]
    q = queries.select(F.col("doc").alias("query_id"), F.col("id").alias("_query"))
    return found.join(q, "query_id").select(F.col("_query").alias("query_id"), *rest)


def lsh_keys(rows: DataFrame, dim: int, tables: int, bits: int, seed: int = 7) -> DataFrame:
    """Sign-of-random-projection bucket per table, as an extra key column."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))

    @F.pandas_udf("array<long>")
    def buckets(vecs: pd.Series) -> pd.Series:
        signs = (np.asarray(vecs.tolist(), dtype=np.float64) @ planes.T) > 0
        powers = 1 << np.arange(bits)
        codes = (signs.reshape(len(vecs), tables, bits) * powers).sum(axis=2)
        return pd.Series(list(codes.astype(np.int64)))

    return rows.select(
        *rows.columns, F.posexplode(buckets("vec")).alias("lsh_table", "lsh_bucket")
    )


def bits_for(rows: int, bucket: int = 64) -> int:
    """Bits that leave about ``bucket`` rows in a bucket."""
    return max(1, math.ceil(math.log2(max(rows, 1) / bucket)))


def approximate_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    *,
    dim: int,
    k: int = TOP_K,
    floor: float = COSINE_FLOOR,
    tables: int = 16,
    bits: int = 4,
) -> DataFrame:
    """Top k by hyperplane hashing: scores are exact, recall is below 1.

    A bucket holds about one in 2^bits of a key's rows; for work in proportion to
    the input ``bits`` grows with the logarithm of its rows (:func:`bits_for`), and
    ``tables`` with it to hold the recall.  Equal vectors are hashed once and stand for all their
    ids; the many buckets are work enough for all tasks, so they are cut into the largest blocks only.
    """
    band = [*keys, "lsh_table", "lsh_bucket"]
    once = [cut_lineage(collapse_copies(side, "vec", keys).drop("copies")) for side in (queries, corpus)]
    q, c = (lsh_keys(side, dim, tables, bits) for side in once)
    found = cell_top_k(q, c, band, dense_cosine, k=k, floor=floor, block_rows=MOST_ROWS)
    return expand_copies(found, members(queries, once[0], keys), members(corpus, once[1], keys), k)


# --------------------------------------------------------------------- sparse


class SetScore:
    """A set similarity in both forms: per pair in the JVM, per block in numpy."""

    def __init__(self, dense_weight: float = 1.0, word_weight: float = 0.0):
        self.dense_weight, self.word_weight = dense_weight, word_weight

    def pair(self, a: Column, b: Column) -> Column:
        """Score of two features columns, of codes where the word part counts."""
        score = self.dense_weight * _set_cosine_column(a, b)
        if self.word_weight:
            score = score + self.word_weight * _set_cosine_column(_words(a), _words(b))
        return score

    def block(self, q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
        score = self.dense_weight * set_cosine(q, c)
        if self.word_weight:
            score = score + self.word_weight * set_cosine(_word_rows(q), _word_rows(c))
        return score

    def least_cosine(self, floor: float) -> float:
        """Set cosine a pair must have at least: the word part adds at most its weight."""
        return (floor - self.word_weight) / self.dense_weight


def _set_cosine_column(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return shared / F.sqrt(F.greatest(F.size(a) * F.size(b), F.lit(1)).cast("double"))


def coded(features: Column) -> Column:
    """Features as 64-bit codes, which are compared and sent in place of the strings; odd ones are words."""

    def code(f: Column) -> Column:
        return F.shiftleft(F.xxhash64(f), 1).bitwiseOR(F.when(f.startswith("#"), 0).otherwise(1))

    return F.transform(features, code)


def _words(codes: Column) -> Column:
    return F.filter(codes, lambda f: f.bitwiseAND(F.lit(1)) == 1)


def _word_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Only the words of features, as codes or as strings; character n-grams are marked with #."""

    def words(fs) -> np.ndarray:
        fs = np.asarray(fs)
        if fs.dtype.kind == "i":
            return fs[fs & 1 == 1]
        return np.array([f for f in fs if not f.startswith("#")], dtype=object)

    return rows.assign(features=[words(fs) for fs in rows["features"]])


def rarest_first(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with ``ranked``: the codes of their features with frequency, rarest in the key first.

    ``docs``: id, keys, features and any other columns.  Collecting a document's
    features again is bounded by its own text, whatever the size of its group.
    """
    other = [c for c in docs.columns if c not in {"features", "id", *keys}]
    exploded = docs.select(*keys, "id", *other, F.explode(coded(F.col("features"))).alias("feature"))
    frequency = exploded.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("df"))
    # every feature of every document: sized like the documents, it would be broadcast
    return (
        exploded.hint("merge").join(frequency, [*keys, "feature"])
        .groupBy(*keys, "id", *other)
        .agg(F.array_sort(F.collect_list(F.struct("df", "feature"))).alias("ranked"))
    )


def set_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    *,
    k: int = TOP_K,
    floor: float = COSINE_FLOOR,
    score: SetScore | None = None,
    hot: int = HOT_FEATURE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top k by set cosine between rows of ``rarest_first``.

    If cos(A, B) >= t then |A and B| >= t^2 |A|, so A's first
    |A| - ceil(t^2 |A|) + 1 features hold a shared one; the same for B.  With
    both sides ordered rarest first, comparing only rows that meet on such a
    feature loses no pair and keeps common features out of the join.

    The lower the floor, the more of a row's features are compared, the common ones last.  So
    the search goes down in floors: a query that has k rows at a higher floor, where every row
    of that score is found, has its result; only the others go on.

    Features of up to ``hot`` documents are joined and scored in the JVM, at most
    (hot / 2)^2 pairs each.  Hotter ones go to numpy cells of bounded size that
    hand on k candidates per query.
    """
    score = score or SetScore()
    if score.least_cosine(floor) <= 0:
        raise ValueError("the prefix filter needs a positive floor")
    settled = None
    for high in HIGH_FLOORS:
        if high <= floor:
            continue
        pairs = _set_pairs(queries, corpus, keys, k, high, score, hot, block_rows)
        # settles queries and gives their result
        best = cut_lineage(best_k(pairs, k))
        full = best.where(F.col("rank") == k).select("query_id")
        ready = best.join(full, "query_id", "left_semi")
        settled = ready if settled is None else settled.unionByName(ready)
        queries = queries.join(full.withColumnRenamed("query_id", "id"), "id", "left_anti")
    rest = best_k(_set_pairs(queries, corpus, keys, k, floor, score, hot, block_rows), k)
    return rest if settled is None else settled.unionByName(rest)


def _set_pairs(
    queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, floor: float, score: SetScore,
    hot: int, block_rows: int,
) -> DataFrame:
    """Pairs of a score of ``floor`` or more, each query's k best among them."""
    needed = score.least_cosine(floor)
    size = F.size("ranked")
    # The small margin keeps ceil() from rounding a whole product up.
    prefix = size - F.ceil(F.lit(needed * needed) * size - F.lit(1e-9)).cast("int") + 1

    def by_prefix(docs: DataFrame) -> DataFrame:
        return docs.select(
            *keys,
            "id",
            F.col("ranked.feature").alias("features"),
            F.posexplode(F.slice("ranked", F.lit(1), prefix)).alias("_at", "_p"),
        ).select(
            *keys, "id", "features", "_at", F.col("_p.df").alias("_df"), F.col("_p.feature").alias("_on")
        )

    on = [*keys, "_on"]
    q, c = by_prefix(queries), by_prefix(corpus)

    def few(docs: DataFrame, side: str) -> DataFrame:
        return docs.where(F.col("_df") <= hot).select(
            *on,
            F.col("id").alias(f"{side}_id"),
            F.col("features").alias(f"_{side}_features"),
            F.size("features").alias(f"_{side}_size"),
            (F.size("features") - F.col("_at")).alias(f"_{side}_left"),
        )

    # A pair shares nothing before its first common feature, so from there on the
    # shorter remainder must still reach the floor.  Cheap, and it turns down most
    # meetings on a common feature before any features are compared.
    reachable = F.least("_query_left", "_corpus_left") >= (
        needed * F.sqrt((F.col("_query_size") * F.col("_corpus_size")).cast("double")) - 1e-9
    )
    # as above: one row a feature is more than the size of the documents tells
    in_jvm = (
        few(q, "query")
        .hint("merge")
        .join(few(c, "corpus"), on)
        .where(reachable)
        .select(
            "query_id",
            "corpus_id",
            score.pair(F.col("_query_features"), F.col("_corpus_features")).alias("score"),
        )
        .where(F.col("score") >= floor)
    )
    # The frequency bounds the rows of either side, so no count is needed here.
    blocks = F.ceil(F.col("_df") / block_rows).cast("int")

    def hot_rows(docs: DataFrame) -> DataFrame:
        return docs.where(F.col("_df") > hot).withColumns({"_qb": blocks, "_cb": blocks}).drop("_df", "_at")

    in_cells = _score_cells(hot_rows(q), hot_rows(c), on, score.block, k, floor)
    return in_jvm.unionByName(in_cells)


def lexical_score(weights_a: Column, weights_b: Column) -> Column:
    """Sum of weight products over the tokens both maps hold."""
    shared = F.array_intersect(F.map_keys(weights_a), F.map_keys(weights_b))
    return F.aggregate(
        F.transform(shared, lambda t: F.element_at(weights_a, t) * F.element_at(weights_b, t)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def idf_weights(texts: DataFrame) -> DataFrame:
    """(id, weights): every word of a text with ln(N / documents with it) + 1."""
    words = texts.select("id", F.explode(text_features("text")).alias("word"))
    total = texts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    frequency = words.groupBy("word").agg((F.log(F.lit(float(total)) / F.count(F.lit(1))) + 1).alias("weight"))
    joined = join_groups(words, frequency, ["word"])
    return joined.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"))


def hybrid_score(
    pairs: DataFrame, weights: DataFrame, dense_weight: float, lexical_weight: float
) -> DataFrame:
    """Blend of the dense score and the lexical match of given pairs.

    ``weights``: id, weights (map).  Both lookups are by unique id, and the
    tokens of a pair are compared inside its row, so nothing is exploded.
    """
    q = weights.select(F.col("id").alias("query_id"), F.col("weights").alias("_wq"))
    c = weights.select(F.col("id").alias("corpus_id"), F.col("weights").alias("_wc"))
    lexical = F.coalesce(lexical_score(F.col("_wq"), F.col("_wc")), F.lit(0.0))
    return (
        pairs.join(q, "query_id", "left")
        .join(c, "corpus_id", "left")
        .withColumn("lexical_score", lexical)
        .withColumn(
            "hybrid_score", dense_weight * F.col("score") + lexical_weight * F.col("lexical_score")
        )
        .drop("_wq", "_wc")
    )

