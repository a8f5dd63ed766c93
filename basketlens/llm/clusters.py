"""Centroid clustering of integer vectors with bounds loosened by total displacement.

The centroids of all rounds are kept, and centroids are held in a few groups.  Every vector
carries its cluster, the distance to that centroid, a lower bound for the others of each group,
and the rounds in which these were measured.  In a later round the distance grows at most by the
norm of the displacement of its centroid *since its round*, and a bound shrinks at most by the
largest such norm in its group; a sum of the drifts round by round would be larger.  Where a
bound still lies beyond the distance, the group is left out.  If some do not, the distance to the
own centroid is measured anew, and then all distances to the groups that still fail, exactly.

Vectors never move between tasks.  A round is one pass over them, written to the shared
folder; per cluster, sums are combined within tasks before the exchange, and the driver gets
one row per cluster.

Defined results: vectors that are null, have another number of components, or hold a null or
non-finite one take no part.  Components are multiplied by ``scale`` and floored.  Equal
distances go to the smaller cluster number; empty clusters keep their centroid.  A null id
counts as an empty one for the choice of the first centroids, and equal ids are told apart by
their vectors.  With fewer vectors than clusters every vector founds one; an empty table gives
an empty result.  Components of 2**27 or more after scaling raise an error, because distances
would not fit a long.  Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LARGEST = 1 << 27
#: Float bounds are widened by this part, so that rounding cannot settle a vector.
SLACK = 1e-9
STATE = (
    "vec_id long, v array<int>, cluster int, own long, own_seen int, lower array<double>,"
    " lower_seen array<int>, scanned int"
)
#: Centroids of a group, on average.
GROUP = 10


def as_integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("v", lambda x: F.abs(x) < LARGEST)
    kept = vectors.where((F.size(vector) == dims) & finite)
    integers = kept.select(F.col(f"`{id_col}`").alias("vec_id"), as_integers(vector, scale).alias("v"))
    told = F.raise_error("a component is too large for distances of 64 bits")
    return integers.select("vec_id", F.when(fits, F.col("v").cast("array<int>")).otherwise(told).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.orderBy(F.sha2(text, 256), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; by floats where every partial sum is below 2**53."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * vectors.shape[1] * float(largest) ** 2 < 2**52 else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def groups_of(first: np.ndarray) -> list[np.ndarray]:
    """Numbers of the centroids by the nearest of the first few, in ascending order."""
    leaders = first[: max(1, len(first) // GROUP)]
    nearest = squared(first, leaders).argmin(1)
    return [np.flatnonzero(nearest == g) for g in range(len(leaders)) if (nearest == g).any()]


def assign(v: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray, groups: list[np.ndarray]) -> dict:
    """The state after one more round.

    own is the squared distance to the centroid of ``cluster`` in round ``own_seen``; lower
    bounds the distances to all others of a group in round ``lower_seen``.
    """
    now, every = len(history) - 1, np.arange(len(groups))
    moved = np.sqrt(((history - history[now]).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
    group_moved = np.stack([moved[:, g].max(1) for g in groups], 1)
    cluster, own, own_seen = (state[c].copy() for c in ("cluster", "own", "own_seen"))
    lower, lower_seen = state["lower"].copy(), state["lower_seen"].copy()
    scanned = np.zeros(len(v), np.int32)

    low = lower - group_moved[lower_seen, every]
    upper = np.sqrt(own) * (1 + SLACK) + moved[own_seen, cluster]
    rows = np.flatnonzero((low <= upper[:, None]).any(1))
    old = cluster[rows]
    to_old = ((v[rows].astype(np.int64) - history[now][old]) ** 2).sum(1)
    own[rows], own_seen[rows] = to_old, now
    scanned[rows] += 1
    fails = low[rows] <= (np.sqrt(to_old) * (1 + SLACK))[:, None]

    least = np.full((2, *fails.shape), np.iinfo(np.int64).max)  # the two smallest of each group
    least_at = np.full(fails.shape, -1)
    for g, members in enumerate(groups):
        at = np.flatnonzero(fails[:, g])
        if not len(at):
            continue
        distances = squared(v[rows[at]], history[now][members])
        scanned[rows[at]] += len(members)
        best, line = distances.argmin(1), np.arange(len(at))  # the first of equals
        found, number = distances[line, best], members[best]
        least[0, at, g], least_at[at, g] = found, number
        distances[line, best] = np.iinfo(np.int64).max
        least[1, at, g] = distances.min(1)
        mine, mine_at = own[rows[at]], cluster[rows[at]]
        nearer = (found < mine) | ((found == mine) & (number < mine_at))
        own[rows[at]], cluster[rows[at]] = np.where(nearer, found, mine), np.where(nearer, number, mine_at)

    new = cluster[rows]
    others = np.where(least_at == new[:, None], least[1], least[0])
    lower[rows] = np.where(fails, np.sqrt(others) * (1 - SLACK), lower[rows])
    lower_seen[rows] = np.where(fails, now, lower_seen[rows])
    # the centroid left is now one of the others of its group, measured or not
    group_of = np.zeros(history.shape[1], np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    left = np.flatnonzero((new != old) & ~fails[np.arange(len(rows)), group_of[old]])
    at, g = rows[left], group_of[old[left]]
    lower[at, g] = np.minimum(low[at, g], np.sqrt(to_old[left]) * (1 - SLACK))
    lower_seen[at, g] = now
    return {
        "cluster": cluster, "own": own, "own_seen": own_seen,
        "lower": lower, "lower_seen": lower_seen, "scanned": scanned,
    }


def one_round(state: DataFrame, history: np.ndarray, groups: list[np.ndarray]) -> DataFrame:
    dims, names = history.shape[2], state.columns

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "own", "own_seen")}
            known |= {c: matrix(batch.column(c), len(groups)) for c in ("lower", "lower_seen")}
            found = assign(matrix(batch.column("v"), dims), known, history, groups)
            columns = [
                pa.array(found["cluster"], pa.int32()), pa.array(found["own"], pa.int64()),
                pa.array(found["own_seen"], pa.int32()), pa.array(list(found["lower"]), pa.list_(pa.float64())),
                pa.array(list(found["lower_seen"]), pa.list_(pa.int32())), pa.array(found["scanned"], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *columns], names)

    return state.mapInArrow(step, STATE)


def centres(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floored means of the clusters; combined within tasks, one row per cluster is collected."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(before.shape[1])]
    after = before.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)), *sums).collect():
        after[row[0]] = [s // row[1] for s in row[2:]]
    return after


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: int = 2,
    dims: int = 64,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance, scanned) of every vector, and the centroids.

    ``scanned`` is the number of distances measured for the vector in the last round.
    """
    rows = usable(vectors, id_col, vector_col, dims, scale)
    first = first_centroids(rows, k, seed)
    if not len(first):
        nothing = {"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "scanned": F.lit(0)}
        return rows.select("vec_id", "v", *[c.alias(n) for n, c in nothing.items()]), first
    groups = groups_of(first)
    unmeasured = {
        "cluster": F.lit(0), "own": F.lit(0).cast("long"), "own_seen": F.lit(0),
        "lower": F.array_repeat(F.lit(float("-inf")), len(groups)),
        "lower_seen": F.array_repeat(F.lit(0), len(groups)), "scanned": F.lit(0),
    }
    state = rows.select("vec_id", "v", *[c.alias(n) for n, c in unmeasured.items()])
    history = first[None]
    for _ in range(rounds):
        state = cut_lineage(one_round(state, history, groups))
        history = np.concatenate([history, centres(state, history[-1])[None]])
    state = cut_lineage(one_round(state, history, groups))
    return measured(state, history[-1]), history[-1]


def measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """With the distance to the final centroid, as ``own`` may be of an earlier round."""
    rows = list(enumerate(centroids.tolist()))
    final = state.sparkSession.createDataFrame(rows, "cluster int, centre array<long>")
    apart = F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b))
    distance = F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x)
    return state.join(F.broadcast(final), "cluster").select(
        "vec_id", "v", "cluster", distance.alias("distance"), "scanned"
    )


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the sums of distances and a digest of each final centroid; joins one row per cluster."""
    spark = found.sparkSession
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, sums.get(i, 0), total, digest) for i, digest in enumerate(digests)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int, rounds: int, seed: int, dims: int, scale: int) -> str:
    """The same in SQL, with one row per component and every distance of every round."""
    parts = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
x AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS i, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(range({dims})) AS i, unnest(v) AS x
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM v)
  WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, min(c) AS c, min(d) AS d
  FROM (SELECT vec_id, c, d, min(d) OVER (PARTITION BY vec_id) AS least
        FROM (SELECT vec_id, c, CAST(sum((x.x - m.x) * (x.x - m.x)) AS BIGINT) AS d
              FROM x JOIN c{n} m USING (i) GROUP BY ALL))
  WHERE d = least GROUP BY vec_id)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(mean, old.x) AS x
  FROM c{n} old LEFT JOIN (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean
                           FROM x JOIN a{n} USING (vec_id) GROUP BY ALL) USING (c, i))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       h AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""
