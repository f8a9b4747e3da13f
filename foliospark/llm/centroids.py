"""Centroid clustering by plain Lloyd rounds on integers.

Every round broadcasts the centroids; each task takes its batches, computes the squared
differences to each centroid in NumPy integers, and the smallest one wins, the lowest number on
ties. A task sends one row for each centroid it met (a count and integer sums), and a ``groupBy``
adds those up, so what is shuffled is ``clusters`` rows a task. All vectors are read anew each round: a lost
executor costs its tasks only, and nothing has to be cached or written.

Sums and differences are exact: in 64-bit integers where they fit for sure, else in Python's.
The centroids (``clusters`` rows) are all that the driver holds.

Defined cases: vectors that are null, of another length, or with null, NaN or infinite components
are left out; floor goes down for negative numbers; fewer vectors than ``clusters`` make fewer clusters;
equal starting vectors leave the higher number empty, and an empty centroid stays where it is; rows with equal ids
are rows of their own, in the order of their vectors where the start needs one; a null id has no start hash and comes
last; an empty table gives no rows; extra columns are ignored. A distance beyond a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.vectors import column_sums, finite, safe, scaled

CLUSTERS, ROUNDS, DIM, FACTOR = 16, 3, 64, 64
#: Vectors that are compared at a time.
CHUNK = 8192
SUMS = "cluster int, n long, sums array<long>, distance long"
FOUND = "vec_id long, cluster int, distance long"


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (the lowest number on ties) and its squared distance."""
    if not safe(points, centroids, 1 << 63):
        points, centroids = points.astype(object), centroids.astype(object)
    distances = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(points)), best]


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), CHUNK):
            part = frame.iloc[at : at + CHUNK]
            yield part["vec_id"], np.stack(part["vector"].to_numpy()).astype(np.int64)


def _partial_sums(centroids):
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[int, tuple[int, list[int], int]] = {}
        for _, points in _chunks(frames):
            best, distance = nearest(points, centroids.value)
            for c in np.unique(best).tolist():
                own = best == c
                n, total, far = table.get(c, (0, [0] * points.shape[1], 0))
                table[c] = (n + int(own.sum()), [a + b for a, b in zip(total, column_sums(points[own]), strict=True)], far + sum(distance[own].tolist()))
        if table:
            yield pd.DataFrame([(c, *row) for c, row in table.items()], columns=["cluster", "n", "sums", "distance"])

    return sums


def _assigned(centroids):
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, points in _chunks(frames):
            best, distance = nearest(points, centroids.value)
            yield pd.DataFrame({"vec_id": ids.to_numpy(), "cluster": best.astype(np.int32), "distance": pd.Series(distance.tolist(), dtype="int64")})

    return assign


def start(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest SHA-256 of ``seed:id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "vector").select("vector").limit(clusters).collect()
    return np.array([r[0] for r in rows], np.int64)


def cluster_vectors(embeddings: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, factor: int = FACTOR, seed: int = 1) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(vec_id, embedding) -> rows(vec_id, cluster, distance), the centroids, and the inertia of each cluster that has vectors."""
    spark = embeddings.sparkSession
    kept = embeddings.where(finite("embedding") & (F.size("embedding") == dim))
    vectors = kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding", factor).alias("vector"))
    centroids = start(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], FOUND), centroids, {}
    merged = [F.sum("n").alias("n"), F.sum("distance").alias("distance"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim))]

    def added(now) -> list:
        return vectors.mapInPandas(_partial_sums(now), SUMS).groupBy("cluster").agg(*merged).collect()

    for _ in range(rounds):
        moved = centroids.copy()
        for r in added(spark.sparkContext.broadcast(centroids)):
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
        centroids = moved
    last = spark.sparkContext.broadcast(centroids)
    inertia = {r["cluster"]: r["distance"] for r in added(last)}
    return vectors.mapInPandas(_assigned(last), FOUND), centroids, inertia


def with_totals(found: DataFrame, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """Adds what each cluster and all of them sum up to, and the hash of the own centroid: one literal a cluster."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster"))
    return found.select(
        "*",
        of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, factor: int = FACTOR, seed: int = 1) -> str:
    """The same in DuckDB SQL, one pair of common tables a round."""
    bad = "x IS NULL OR NOT isfinite(x)"
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: {bad})) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {clusters}))",
    ]
    # integers below 2^53, so sums of doubles are exact
    distance = "CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT)"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v) AS v, min({{'d': {distance}, 'k': k}}) AS best FROM kept CROSS JOIN c{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT k, p, (s - ((s % n) + n) % n) // n AS x FROM (SELECT best.k AS k, p, CAST(sum(v[p]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) AS t(p) GROUP BY ALL))")
            steps.append(f"m{r} AS (SELECT k, list(x ORDER BY p) AS c FROM s{r} GROUP BY k)")
            steps.append(f"c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    last = f"SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k"
    return f"WITH {', '.join(steps)} {last}"
