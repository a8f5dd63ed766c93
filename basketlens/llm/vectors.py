"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors.  Every vector is represented by its nearest
pivots in order of nearness and posted, with the rank, in the inverted file of each of
them.  A query reads the files of its own nearest pivots, ranks the vectors by the
induced footrule distance (a pivot absent from a list counts as if it came right after
its end) and computes the exact inner product for the best part of them.

The index is cut into blocks of bounded size by the hash of the vector; a task holds one
block of vectors and one of queries, so its memory does not grow with the data, and hands
on ``k + 1`` neighbours for each query.  Equal vectors are indexed once: of a vector's
rows only those with the ``k + 1`` smallest ids can be neighbours.

Defined results: vectors that are null, zero, hold null or non-finite components, or have
another length than most (ties: the shorter) take no part, as query or as candidate; so do
null ids.  Neighbours with equal scores come in order of their id.  A row repeated under one
id counts once.  With fewer than ``k`` candidates all are returned; an empty table gives no
rows.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import about

#: Pivots, length of the ordered lists, vectors and queries of a task.
PIVOTS, LISTED, BLOCK, QUERIES_AT_ONCE = 256, 64, 16_384, 4_096
#: Part of a block that is reranked exactly, and the least number.
RERANKED, RERANKED_LEAST = 0.15, 400


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part, v as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(fine & F.exists("v", lambda x: x != 0))
    )
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size")
    most = sizes.first()
    return rows.where(F.size("v") == (most["size"] if most else 0))


def ordered_pivots(matrix: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The ``listed`` nearest pivots of each row, nearest first."""
    near = matrix @ pivots.T
    listed = min(listed, len(pivots))
    top = np.argpartition(-near, listed - 1, axis=1)[:, :listed]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


class InvertedFiles:
    """The posting lists of one block of vectors."""

    def __init__(self, matrix: np.ndarray, pivots: np.ndarray, listed: int) -> None:
        self.matrix, self.pivots = matrix, pivots
        self.listed = min(listed, len(pivots))
        lists = ordered_pivots(matrix, pivots, self.listed)
        flat = lists.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.listed).astype(np.int32)
        self.rank = (order % self.listed).astype(np.int32)
        self.start = np.searchsorted(flat[order], np.arange(len(pivots) + 1))

    def footrule(self, query_list: np.ndarray) -> np.ndarray:
        """Induced footrule distance of every vector to a query, up to a constant.

        Lists of equal length are compared: a shared pivot counts its difference of ranks in
        place of the two distances to the lists' ends.
        """
        saved = np.zeros(len(self.matrix), dtype=np.int32)
        for at, pivot in enumerate(query_list):
            a, b = self.start[pivot], self.start[pivot + 1]
            rank = self.rank[a:b]
            saved[self.vector[a:b]] += 2 * self.listed - at - rank - np.abs(rank - at)
        return -saved

    def search(self, queries: np.ndarray, k: int, part: float, least: int):
        """Per query: positions and exact inner products of its best ``k`` vectors."""
        wanted = min(len(self.matrix), max(least, int(part * len(self.matrix))))
        for query, listed in zip(queries, ordered_pivots(queries, self.pivots, self.listed)):
            if wanted < len(self.matrix):
                near = np.argpartition(self.footrule(listed), wanted - 1)[:wanted]
            else:
                near = np.arange(len(self.matrix))
            score = (self.matrix[near] * query).sum(axis=1)
            if len(near) > k:
                # all that tie with the k-th stay, so that ids decide later
                least_score = np.partition(score, len(score) - k)[len(score) - k]
                near, score = near[score >= least_score], score[score >= least_score]
            yield near, score


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    listed: int = LISTED,
    block: int = BLOCK,
    reranked: float = RERANKED,
) -> DataFrame:
    """Nearest ``k`` by inner product: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).withColumn("place", F.xxhash64("v"))
    first = Window.partitionBy("place", "v").orderBy("vec_id")
    ids = rows.dropDuplicates(["vec_id", "place", "v"])
    small = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = small.where("n = 1").select("place", "v")
    queries = ids.where(is_query)

    sampled = about(distinct, pivots, "place").orderBy("place", "v").collect()
    sampled = sampled or distinct.limit(1).collect()
    if not sampled:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(np.array([r["v"] for r in sampled]))
    blocks = -(-distinct.count() // block)

    asked = queries.select("place", "v").distinct()
    query_blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    spread = F.pmod(F.hash("place", "v"), F.lit(blocks))
    left = distinct.select(
        "v", "place", spread.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q")
    )
    right = asked.select(
        "v", "place",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
        F.pmod(F.hash("place", "v"), F.lit(query_blocks)).alias("q"),
    )

    def pairs(stored: pd.DataFrame, wanted: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(stored) and len(wanted):
            matrix = np.stack(stored["v"].to_numpy())
            places = stored["place"].to_numpy()
            files = InvertedFiles(matrix, sent.value, listed)
            asked_places = wanted["place"].to_numpy()
            found = files.search(np.stack(wanted["v"].to_numpy()), k + 1, reranked, RERANKED_LEAST)
            for at, (near, score) in enumerate(found):
                yield asked_places[at], places[near], score

    def task(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        parts = list(pairs(stored, wanted))
        return pd.DataFrame(
            {
                "query_place": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype("int64"),
                "place": np.concatenate([np.empty(0, "int64"), *[p[1] for p in parts]]),
                "score": np.concatenate([np.empty(0), *[p[2] for p in parts]]),
            }
        )

    near = (
        left.groupBy("b", "q")
        .cogroup(right.groupBy("b", "q"))
        .applyInPandas(task, "query_place long, place long, score double")
    )
    best = Window.partitionBy("query_place").orderBy(F.desc("score"), "vec_id")
    # each distinct vector stands for its smallest ids; k + 1 of them are enough
    members = small.select("place", "vec_id")
    top = (
        near.join(members, "place")
        .withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .select("query_place", "vec_id", "score")
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.select(F.col("place").alias("query_place"), F.col("vec_id").alias("query_id"))
        .join(top, "query_place")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
