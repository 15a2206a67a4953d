"""Centroid clustering with Orchard's search.

Each centroid has a list of all centroids, nearest first. A vector starts at centroid 0 and walks down that
centroid's list; whenever an entry is closer to the vector, the walk goes on at the top of the closer one's list.
Entries that were measured before are passed over, and the walk stops at the first entry that is strictly
farther from the list's centroid than twice the vector's distance: by the triangle inequality no later one is
closer, or as close with a smaller number. All is whole numbers, so results are the same whatever the order of
rows, tasks and retries. All vectors of a batch walk at once.

A round is one pass over the table: tasks send a count and a sum for each centroid and component, never vectors.
What comes to the driver and goes to the tasks is ``k`` centroids and their k * k lists, whatever the table's size;
``k`` is at most ``MOST_CENTROIDS``.

Defined results: vectors that are null, have another number of components or a null or non-finite one are left
out, in the fit and in the result. Repeated rows count as often as they occur. Starts with the same hash (a
repeated vec_id) follow their components; a null vec_id has no hash and comes last. With fewer than ``k``
vectors each is a start. Empty tables give no rows, extra columns are ignored. A distance that does not fit a
long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import materialize, table
from kithgraph.llm.vector_rows import LARGE, scaled

MOST_CENTROIDS = 2048
SLICE_ROWS = 4096


class Centroids:
    """k points and, for each, all points by distance (ties by number) with their squared distances."""

    def __init__(self, points: list[list[int]]) -> None:
        small = all(abs(x) <= LARGE for p in points for x in p)
        self.points = np.array(points, dtype=np.int64 if small else object)
        apart = np.stack([squared(self.points, p) for p in self.points])
        self.near = np.stack([np.argsort(row, kind="stable") for row in apart])
        self.far = np.take_along_axis(apart, self.near, axis=1)


def squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    apart = points - other
    return (apart * apart).sum(axis=-1)


def search(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller) and squared distance of each vector; distances measured."""
    n, k = len(vectors), len(centroids.points)
    seen = np.zeros((n, k), dtype=bool)
    best, at, walking = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
    seen[:, 0] = True
    close, measured = squared(vectors, centroids.points[0]), n
    while len(walking):
        here, place = best[walking], at[walking]
        on = place < k
        place = np.minimum(place, k - 1)
        on &= ~(centroids.far[here, place] > 4 * close[walking]).astype(bool)
        walking, here, place = walking[on], here[on], place[on]
        entry = centroids.near[here, place]
        at[walking] += 1
        new = ~seen[walking, entry]
        asked, entry, here = walking[new], entry[new], here[new]
        seen[asked, entry] = True
        measured += len(asked)
        apart = squared(vectors[asked], centroids.points[entry])
        better = ((apart < close[asked]) | ((apart == close[asked]) & (entry < here))).astype(bool)
        jump = asked[better]
        best[jump], close[jump], at[jump] = entry[better], apart[better], 0
    return best, close, measured


def starts(vectors: DataFrame, size: int, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes, scaled; each task hands on k rows at most."""
    x = F.col("embedding")
    whole = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.filter(x.isNotNull()).filter(whole).select(key.alias("key"), x.cast("array<double>").alias("embedding"))
    rows = first.orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k).collect()
    return [[int(np.floor(scale * c)) for c in row.embedding] for row in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean of their vectors, or where they were if they have none."""
    size, known = len(centroids[0]), Centroids(centroids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), size), dtype=object)
        for batch in batches:
            _, rows = scaled(batch.column(0), size, scale)
            for low in range(0, len(rows), SLICE_ROWS):
                part = rows[low : low + SLICE_ROWS]
                found, _, _ = search(part, known)
                order = np.argsort(found, kind="stable")
                edges = np.flatnonzero(np.append(True, np.diff(found[order]) > 0))
                own = found[order][edges]
                counts[own] += np.diff(np.append(edges, len(order)))
                sums[own] += np.add.reduceat(part[order], edges, axis=0).astype(object)
        for c in np.flatnonzero(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c)] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([int(counts[c])] * size, pa.int64()), pa.array([int(s) for s in sums[c]], pa.int64())],
                names=["cluster", "place", "n", "total"],
            )

    parts = vectors.select("embedding").mapInArrow(gather, "cluster int, place int, n long, total long")
    out = [list(c) for c in centroids]
    for row in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[row.cluster][row.place] = row.total // row.n
    return out


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster, distance of every vector that has a place."""
    size, known = len(centroids[0]), Centroids(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = scaled(batch.column(1), size, scale)
            for low in range(0, len(rows), SLICE_ROWS):
                found, close, _ = search(rows[low : low + SLICE_ROWS], known)
                ids = batch.column(0).take(pa.array(at[low : low + SLICE_ROWS]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array([int(d) for d in close], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia of every vector that has a place; the final centroids."""
    if k > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids: each task holds the k * k lists")
    spark, vectors = vectors.sparkSession, vectors.select("vec_id", "embedding")
    centroids = starts(vectors, size, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    found = materialize(assign(vectors, centroids, scale), "clusters")
    totals = [(r.cluster, r.total) for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()]
    own = spark.createDataFrame(totals, "cluster int, cluster_inertia long")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(t for _, t in totals)).cast("long").alias("inertia")), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    digest = F.element_at(F.array(*map(F.lit, hashes)), F.col("cluster") + 1) if hashes else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", digest)


def _round(r: int) -> str:
    """DuckDB: a{r} is the assignment to c{r}, c{r + 1} the centroids after it."""
    return f"""
a{r} AS (SELECT r, c, d FROM (SELECT e.r, c.c, sum((e.a - c.a) * (e.a - c.a))::BIGINT AS d FROM e JOIN c{r} c USING (i) GROUP BY e.r, c.c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
m{r} AS (SELECT c, i, sum(a)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN e USING (r) GROUP BY c, i),
c{r + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN a ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS a FROM c{r} LEFT JOIN m{r} USING (c, i))"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT r, unnest(x) AS a, unnest(range(64)) AS i FROM v),
c0 AS (SELECT c, unnest(x) AS a, unnest(range(64)) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < 16)),
{",".join(_round(r) for r in range(4))},
h AS (SELECT c, sha256(string_agg(a::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN v USING (r) JOIN h USING (c)
"""
