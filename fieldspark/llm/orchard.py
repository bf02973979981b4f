"""Centroid clustering of integer vectors by Orchard's search.

Every centroid has the list of all centroids in the order of their distance from it. A
vector walks the list of the closest centroid known so far; when a listed one is closer
it jumps to that one's list and goes on there. Centroids already met are marked and not
measured again. By the triangle inequality nothing can be as close as the current one
once the list is strictly beyond twice the current distance, and the walk ends there; ties
are walked, so the smaller number wins them. Everything is exact 64-bit integer arithmetic.

Centroids are ``k`` rows, a parameter, so they travel with the tasks. Each round is one
scan of the written integer vectors: tasks return one sum per centroid, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise

#: Clusters, rounds of moving them, components, and steps per unit.
K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
SEED = 1
#: Vectors walked at once.
BATCH = 4096
#: Components from here on could carry squared distances, or four times them, past 64 bits.
LIMIT = 1 << 26


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of all centroids in ascending distance from each one, itself first."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(gaps - np.eye(len(gaps), dtype=np.int64), axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, 1)


def nearest(x: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of integer rows; ties go to the smaller number."""
    order, gaps = lists
    n, k = len(x), len(centroids)
    at, best = np.zeros(n, np.int64), ((x - centroids[0]) ** 2).sum(1)
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    step, live = np.ones(n, np.int64), np.arange(n)
    while len(live):
        live = live[step[live] < k]
        live = live[gaps[at[live], step[live]] <= 4 * best[live]]
        other = order[at[live], step[live]]
        step[live] += 1
        new = ~met[live, other]
        row, other = live[new], other[new]
        met[row, other] = True
        far = ((x[row] - centroids[other]) ** 2).sum(1)
        closer = (far < best[row]) | ((far == best[row]) & (other < at[row]))
        row = row[closer]
        at[row], best[row], step[row] = other[closer], far[closer], 1
    return at, best


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            part = b.slice(k, BATCH)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        lists = neighbours(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _batches(batches, dims):
            at, _ = nearest(x, centroids, lists)
            count += np.bincount(at, minlength=k)
            np.add.at(total, at, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])
    return run


def _assigned(centroids: np.ndarray):
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = neighbours(centroids)
        for part, x in _batches(batches, centroids.shape[1]):
            at, best = nearest(x, centroids, lists)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(best), pa.array([names[c] for c in at])],
                ["vec_id", "cluster", "distance", "centroid_sha256"])
    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of the mean of their vectors; empty ones stay."""
    parts = vectors.select("vec_id", "x").mapInArrow(_sums(centroids), "cluster long, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # k x components rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with ``dims`` finite components.

    Vectors with a component of ``LIMIT`` steps or more are left out like non-finite ones:
    their squared distances need not fit 64 bits.
    """
    v = F.col("v")

    def usable(c: Column) -> Column:
        return F.coalesce(F.abs(F.floor(c * scale)) < LIMIT, F.lit(False)) & ~F.isnan(c)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter((F.size(v) == dims) & F.forall(v, lambda c: (F.abs(c) < float(LIMIT)) & usable(c))).select(
        "vec_id", F.transform(v, lambda c: F.floor(c * scale).cast("int")).alias("x"))


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: vec_id, cluster, distance, centroid_sha256; final centroids).

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id``;
    vectors without an id come last there, equal ids by their components. Fewer vectors
    give fewer centroids, an empty table gives no rows. Repeated rows count each. Other
    columns of ``df`` are not read.
    """
    vectors = materialise(integer_vectors(df, id_col, vector_col, dims, scale), "integer_vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(key.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if first else 0):
        centroids = _moved(vectors, centroids)
    schema = "vec_id long, cluster int, distance long, centroid_sha256 string"
    return materialise(vectors.mapInArrow(_assigned(centroids), schema) if first
                       else vectors.sparkSession.createDataFrame([], schema), "assigned"), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the distances summed over each vector's cluster and over all."""
    by_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by_cluster.agg(F.sum("cluster_inertia")).first()[0]
    # one row per cluster, k at most
    return assigned.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """The same rounds as chained table expressions."""
    steps = [f"""
x AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS v FROM embeddings
      WHERE len(embedding) = {DIMS} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {DIMS}),
e AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM x),
c0 AS (SELECT k, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM
       (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM x) WHERE k < {K})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, k, sum((e.c - c.c) * (e.c - c.c)) AS d FROM e JOIN c{r} c USING (i) GROUP BY vec_id, k),
a{r} AS (SELECT vec_id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d{r}) WHERE n = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT k, i, sum(c) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY k, i),
c{r + 1} AS (SELECT k, i, CAST(CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c
       FROM c{r} LEFT JOIN m{r} USING (k, i))""")
    last = ROUNDS
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
USING (k)"""


SQL = _sql()
