"""Centroid clustering by plain Lloyd rounds in exact integers.

Vectors of exactly `width` components, none null or not finite, are kept; a component x becomes floor(scale * x), x as double. They are written once,
and every round is one pass over them: the centroids (k * width numbers) are broadcast, a task takes the squared difference of its rows
to one centroid after the other, the smaller number winning ties, and emits one row a centroid with its componentwise sum and count; those rows
meet in a groupBy, whose k rows give the next centroids by exact floor division. A centroid without vectors stays where it is. No row of a vector is
shuffled, so that one vector that makes up most of the table costs what any other does.

The first centroids are the k kept vectors with the smallest lower-case sha256 of `2:<vec_id>`, in that order; rows that repeat a vec_id are ordered by their
components, and rows without one come after all others. Fewer than k kept vectors give fewer centroids. Repeated rows count as often as they occur. A null vec_id
stays null. An empty table, or one without a vector to keep, gives no rows. Columns other than vec_id and embedding are ignored. Components of 2**27
units and more would leave the exact range of a long distance and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

K, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
LIMIT = 1 << 27
ROWS = 4096  # vectors in a numpy step
ASSIGNED = "id long, bare boolean, cluster int, distance long"
SUMS = "cluster int, n long, sums array<long>"


def integer_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components in units, of every vector that is kept."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    units = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.where(F.size("embedding") == width).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), units.alias("v"))
    within = F.forall("v", lambda x: F.abs(x) < LIMIT)
    return kept.withColumn("v", F.when(within, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} units or more"))))


def first_centroids(kept: DataFrame, k: int = K) -> np.ndarray:
    key = F.coalesce(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), F.lit("g"))  # g: after every digest
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each point; the smaller number wins ties."""
    apart = np.empty((len(centroids), len(points)), np.int64)
    for i, c in enumerate(centroids):
        gap = points - c
        apart[i] = np.einsum("ij,ij->i", gap, gap)
    best = apart.argmin(axis=0)
    return best, apart[best, np.arange(len(points))]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for lo in range(0, len(frame), ROWS):
            part = frame.iloc[lo : lo + ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Count and componentwise sum of every centroid that has vectors."""
    known, width = kept.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(known.value)
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, points in _blocks(frames):
            best, _ = nearest(points, known.value)
            order = np.argsort(best, kind="stable")
            own, first = np.unique(best[order], return_index=True)
            total[own] += np.add.reduceat(points[order], first, axis=0)
            n += np.bincount(best, minlength=k)
        own = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": own.astype(np.int32), "n": n[own], "sums": list(total[own])})

    found = kept.select("v").mapInPandas(run, SUMS).groupBy("cluster")
    return found.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))


def lloyd(kept: DataFrame, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after all rounds; the driver sees k rows a round."""
    centroids = first_centroids(kept, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for r in sums(kept, centroids).collect():
            centroids[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    known = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, points in _blocks(frames):
            best, apart = nearest(points, known.value)
            yield pd.DataFrame({"id": part["id"], "bare": part["bare"], "cluster": best.astype(np.int32), "distance": apart})

    rows = kept.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.isnull("vec_id").alias("bare"), "v")  # pandas makes a long with nulls a float
    return rows.mapInPandas(run, ASSIGNED).select(F.when(~F.col("bare"), F.col("id")).alias("vec_id"), "cluster", "distance")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = materialise(integer_vectors(vectors, width, scale), "integer-vectors")
    centroids = lloyd(kept, k, rounds)
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    assigned = materialise(assign(kept, centroids), "assigned")
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = own.agg(F.sum("cluster_inertia").alias("inertia"))
    of_cluster = own.join(F.broadcast(names), "cluster").join(F.broadcast(whole), F.lit(True))  # k rows and one row
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """The rounds one after the other, as views of (cluster, pos, c) and of (vec_id, cluster, distance)."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, m.cluster, m.distance FROM (SELECT vec_id, v, min({{'distance': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'cluster': cluster}}) AS m FROM kept, c{i} GROUP BY vec_id, v))")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {width + 1})) AS pos FROM a{i}) GROUP BY cluster, pos)")
            steps.append(f"n{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (cluster))")
    body = f"SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    return f"WITH {', '.join(steps)} {body}"


ORACLE = _oracle()
