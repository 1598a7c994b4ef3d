"""Integer k-means with bounds that are loosened by the norm of a centroid's whole displacement.

For every vector a lower bound of its distance to each centroid is kept with the round in which it was
found, and an upper bound of that to its own. All former centroids are kept as well. A bound found in round
t is loosened by the distance between the centroid of round t and that of now, which is never more, and
mostly much less, than the sum of the moves of the rounds between. A centroid whose lower bound is above
the upper bound cannot be the nearest; where a test fails, the distance is computed exactly, in integers.

The vectors with their bounds are a table in the shared folder; each round is a map over it that writes the
next one, and a sum for each cluster. The driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.llm.common import drop_stored, quoted, stored

#: Components may not be larger than this, so that any squared distance fits a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Means:
    """Number of clusters, rounds, components of a vector, factor before they are floored, and the seed of the start."""

    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    seed: int = 1


def integer_points(vector: Column, means: Means) -> Column:
    """Components times the scale, floored; null for a vector of another length or with a null or non-finite component."""
    good = (F.size(vector) == means.dims) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    floored = lambda x: F.floor(x.cast("double") * F.lit(float(means.scale))).cast("int")
    checked = lambda x: F.when(
        F.abs(x.cast("double") * F.lit(float(means.scale))) <= LARGEST, floored(x)
    ).otherwise(F.raise_error(F.lit("a component is too large for squared distances in 64 bits")).cast("int"))
    return F.when(good, F.transform(vector, checked))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Bounds:
    """Bounds of some vectors: ``lower`` (float, rounded down) and the round of each, ``upper`` and its round."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, upper_round: np.ndarray, lower: np.ndarray, lower_round: np.ndarray):
        self.cluster, self.upper, self.upper_round = cluster, upper, upper_round
        self.lower, self.lower_round = lower, lower_round

    @classmethod
    def none(cls, count: int, clusters: int) -> Bounds:
        return cls(
            np.zeros(count, np.int64), np.full(count, np.inf), np.zeros(count, np.int32),
            np.full((count, clusters), -np.inf, np.float32), np.zeros((count, clusters), np.int32),
        )


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = points - centroid
    return np.einsum("ij,ij->i", apart, apart)


def drifts(history: list[np.ndarray]) -> np.ndarray:
    """Distance of each centroid from where it was in every round (a row each), rounded up."""
    now = history[-1].astype(np.float64)
    return np.stack([np.sqrt(((now - then) ** 2).sum(axis=1)) for then in history]) * (1 + 1e-12)


def assign(points: np.ndarray, bounds: Bounds, history: list[np.ndarray]) -> np.ndarray:
    """Bring ``bounds`` to the nearest centroids of now (ties: the smaller number); exact distances computed for each vector."""
    centroids, now, drift = history[-1], len(history) - 1, drifts(history)
    own, count = np.arange(len(centroids)), np.zeros(len(points), np.int64)
    if not len(points):
        return count
    lower = bounds.lower.astype(np.float64) - drift[bounds.lower_round, own]
    lower[np.arange(len(points)), bounds.cluster] = np.inf
    upper = (bounds.upper + drift[bounds.upper_round, bounds.cluster]) * (1 + 1e-12)
    rows = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)

    def measure(at: np.ndarray, j: int) -> None:
        exact[at, j] = squared(points[rows[at]], centroids[j])
        bounds.lower[rows[at], j] = np.nextafter(np.sqrt(exact[at, j]).astype(np.float32), np.float32(-np.inf))
        bounds.lower_round[rows[at], j] = now
        count[rows[at]] += 1

    for j in own:
        measure(np.flatnonzero(bounds.cluster[rows] == j), j)
    tight = np.sqrt(exact[np.arange(len(rows)), bounds.cluster[rows]]) * (1 + 1e-12)
    for j in own:
        measure(np.flatnonzero(lower[rows, j] <= tight), j)
    bounds.cluster[rows] = exact.argmin(axis=1)
    bounds.upper[rows] = np.sqrt(exact.min(axis=1, initial=np.iinfo(np.int64).max))
    bounds.upper_round[rows] = now
    return count


STATE = "key {key}, point array<int>, cluster int, upper double, upper_round int, lower array<float>, lower_round array<int>, evaluated bigint"


def assigned(state: DataFrame, history: list[np.ndarray], means: Means, kind: str) -> DataFrame:
    """The next state: nearest centroids of now and the bounds brought up to date."""
    sent = state.sparkSession.sparkContext.broadcast(history)
    clusters, first = len(history[0]), len(history) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "key point cluster upper upper_round lower lower_round evaluated".split()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            points = matrix(column["point"], means.dims).astype(np.int64)
            bounds, former = Bounds.none(len(points), clusters), np.zeros(len(points), np.int64)
            if not first:
                plain = [column[c].to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "upper_round")]
                bounds = Bounds(*plain, *[matrix(column[c], clusters).copy() for c in ("lower", "lower_round")])
                former = column["evaluated"].to_numpy()
            count = former + assign(points, bounds, sent.value)
            edges = pa.array(np.arange(0, len(points) * clusters + 1, clusters), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.ravel())) for x in (bounds.lower, bounds.lower_round)]
            values = [
                column["key"], column["point"], pa.array(bounds.cluster, pa.int32()), pa.array(bounds.upper),
                pa.array(bounds.upper_round, pa.int32()), *lists, pa.array(count),
            ]
            yield pa.RecordBatch.from_arrays(values, names=names)

    return state.mapInArrow(run, STATE.format(key=kind))


def moved(state: DataFrame, former: np.ndarray) -> np.ndarray:
    """Floored means of the clusters; a cluster without vectors stays where it was."""
    sums = [F.sum(F.get("point", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(former.shape[1])]
    out = former.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(former.shape[1])]
    return out


def clustered(df: DataFrame, key: str, vector: str, means: Means = Means()) -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluated) for the usable vectors of ``df``.

    Vectors of another length or with a null or non-finite component are left out. The start is the
    vectors with the smallest hex SHA-256 of ``seed:key`` (null: no digits; equal keys by their components). Each round
    assigns all vectors and moves the centroids; they are assigned once more at the end. ``distance`` is
    squared, ``centroid_sha256`` that of the final centroid's components joined by commas, ``evaluated`` how many
    distances were computed exactly in all rounds. Repeated rows are vectors of their own. With fewer
    vectors than clusters each is a start; without any there is no row. A component that is so large that squared
    distances leave 64 bits is an error.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    points = df.select(quoted(key).alias("key"), integer_points(quoted(vector), means).alias("point")).where("point is not null")
    named = F.concat(F.lit(f"{means.seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    start = points.orderBy(F.sha2(named.cast("binary"), 256), "point").limit(means.clusters).collect()
    result = "key {}, cluster int, distance bigint, evaluated bigint".format(kind)
    if not start:
        return with_inertia(spark.createDataFrame([], result), [], key)
    history, state, path = [np.array([r["point"] for r in start], np.int64)], points, None
    for _ in range(means.rounds):
        before = path
        state, path = stored(assigned(state, history, means, kind), "vectors")
        drop_stored(spark, before)
        history.append(moved(state, history[-1]))
    last = assigned(state, history, means, kind)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            distance = squared(matrix(batch.column("point"), means.dims).astype(np.int64), centroids[cluster])
            values = [batch.column("key"), batch.column("cluster"), pa.array(distance), batch.column("evaluated")]
            yield pa.RecordBatch.from_arrays(values, names=["key", "cluster", "distance", "evaluated"])

    sent = spark.sparkContext.broadcast(history[-1])
    found, _ = stored(last.select("key", "point", "cluster", "evaluated").mapInArrow(measured, result), "clusters")
    drop_stored(spark, path)
    return with_inertia(found, history[-1].tolist(), key)


def with_inertia(found: DataFrame, centroids: list[list[int]], key: str) -> DataFrame:
    """Rows with the distances summed over each cluster and over all (a row for each cluster), and the centroids' hashes."""
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()} if centroids else {}
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        F.col("key").alias(key), "cluster", "distance", of([sums.get(j, 0) for j in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"), "evaluated",
    )


def sql(means: Means = Means()) -> str:
    """The same in SQL, a set of common tables for each round."""
    parts = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {means.scale}) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = {means.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {means.dims}
), parts AS (SELECT r, unnest(p) AS v, unnest(range(1, {means.dims + 1})) AS i FROM kept
), start AS (SELECT p, row_number() OVER (ORDER BY sha256('{means.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), p) - 1 AS j FROM kept
  QUALIFY j < {means.clusters}
), c0 AS (SELECT j, unnest(p) AS c, unnest(range(1, {means.dims + 1})) AS i FROM start)"""]  # fmt: skip
    for t in range(means.rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT r, j, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM parts JOIN c{t} USING (i) GROUP BY r, j) GROUP BY r)""")
        if t < means.rounds:
            parts.append(f"""
s{t} AS (SELECT j, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN parts USING (r) GROUP BY j, i
), c{t + 1} AS MATERIALIZED (SELECT j, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{t} LEFT JOIN s{t} USING (j, i))""")
    last = means.rounds
    return "WITH " + ",".join(parts) + f""",
sums AS (SELECT j, CAST(sum(d) AS BIGINT) AS within FROM a{last} GROUP BY j
), hashes AS (SELECT j, sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM c{last} GROUP BY j)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, within AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN sums USING (j) JOIN hashes USING (j)"""  # fmt: skip
