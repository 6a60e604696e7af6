"""Centroid clustering of integer vectors, exact, with bounds that geometry tightens.

A round assigns every vector to its nearest centroid (squared Euclidean distance, ties: the smaller number) and moves
each centroid to the floor of the mean of its vectors. All distances and sums are integers, so results do not depend on
partitions or on the order of rows.

*Bounds.* With its cluster a vector carries a lower bound on its distance to every other centroid. When centroids have
moved, a vector whose (exact) distance to its own centroid is below its bound keeps its cluster; the others are ambiguous
and scanned exactly, and get a new bound, the distance to the second nearest.

*Geometric drift tightening.* A bound must be loosened by what a foreign centroid came nearer, at most by its full drift
``D``. The vectors of a cluster lie in a sphere around its old centroid, whose radius is known from their distances.
Turned around the line of the drift, the worst point lies in the plane through that line and the sphere's centre. There, a
point seen from the middle of the drift at an angle ``t`` to its direction came nearer by at most ``D cos t`` (the
hyperbola's asymptote), so a sphere at angle ``phi`` of half-width ``psi = asin(r / distance)`` loosens its bound by
``D cos(phi - psi)`` at most, by ``D`` where it holds the direction, and by nothing where it lies behind. The largest
such value over the foreign centroids is what the bounds of this cluster lose.

Rows are placed by the scan and never exchanged; per round, one row per cluster (counts, sums, radius) comes to the driver,
and the centroids go back with the tasks: the number of clusters times the components, bounded by parameters. The vectors
of a round are written with their bounds, so a lost executor repeats its tasks of that round only.

Vectors that are null, of another length, or hold a null, NaN or infinite component are left out. Components beyond
``LARGEST`` after scaling have no distance in 64 bits: they stop the job with an error. A null key is hashed as ``null``.
Repeated rows are vectors of their own; equal centroids keep their numbers, and ties leave the later ones empty. Fewer
vectors than clusters give as many clusters as vectors, an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.session import discard, stage

#: Largest component in integers whose squared distances fit 64 bits at 64 components.
LARGEST = 1 << 27
#: Up to this, matrix products of 64 components are exact in doubles.
_EXACT_IN_DOUBLES = 1 << 22
#: What bounds give way for rounding.
_SLACK = 1e-9
#: Rows of a step, so that the distances of a step stay small.
_STEP = 1 << 14


@dataclass
class Clusters:
    """``key, v, cluster, own, low, scanned`` per vector (``own`` the squared distance), the centroids they refer to, and
    how many vectors each round scanned."""

    members: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def integer_vectors(df: DataFrame, key: str, vector: str, length: int, scale: int) -> DataFrame:
    """``key, v`` with ``v`` the floor of ``scale`` times each component, for whole finite vectors of this length."""
    x = F.col(f"`{vector}`")
    finite = (F.size(x) == length) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))

    def whole(e: Column) -> Column:
        scaled = F.floor(e.cast("double") * scale)
        return F.when(F.abs(e.cast("double") * scale) <= LARGEST, scaled).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("bigint"))

    return df.where(finite).select(F.col(f"`{key}`").alias("key"), F.transform(x, whole).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of salt and key, in that order (equal keys: by components)."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    return [list(r["v"]) for r in vectors.orderBy(digest, "v").select("v").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``, exact."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT_IN_DOUBLES
    kind = np.float64 if small and x.shape[1] <= 64 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What the lower bounds of each cluster lose when the centroids move: at most the largest drift of another one."""
    old, new = old.astype(float), new.astype(float)
    drift = new - old
    length = np.sqrt((drift * drift).sum(1))
    middle = (old + new) / 2
    out = np.zeros(len(old))
    for i in range(len(old)):
        away = old[i] - middle
        distance = np.sqrt((away * away).sum(1))
        with np.errstate(all="ignore"):
            phi = np.arccos(np.clip((away * drift).sum(1) / (distance * length), -1.0, 1.0))
            psi = np.arcsin(np.clip(radius[i] / distance, 0.0, 1.0))
            lost = length * np.clip(np.cos(np.maximum(phi - psi, 0.0)), 0.0, 1.0)
        lost = np.where((distance <= radius[i]) | ~np.isfinite(lost), length, lost)
        lost[length == 0] = 0.0
        lost[i] = 0.0
        out[i] = lost.max(initial=0.0)
    return out


def full_drift(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The same without geometry, for comparison: the largest drift of another centroid."""
    length = np.sqrt(((new - old).astype(float) ** 2).sum(1))
    return np.array([np.delete(length, i).max(initial=0.0) for i in range(len(old))])


_STATE = "v array<int>, cluster int, own bigint, low double, scanned boolean"


def _assigned(rows: DataFrame, centroids: np.ndarray, lost: np.ndarray | None) -> DataFrame:
    """``key`` and the state of every vector: scanned without ``lost``, else only where the bound leaves it open."""
    key = rows.schema["key"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
        cluster, own, low = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n)
        open_ = np.ones(n, bool)
        if lost is not None:
            cluster = np.array(batch.column("cluster"), dtype=np.int32)
            gap = x - centroids[cluster]
            own = (gap * gap).sum(1)
            low = np.array(batch.column("low"), dtype=float)
            low = low - lost[cluster] - _SLACK * (1.0 + np.abs(low) + lost[cluster])
            open_ = ~(np.sqrt(own) * (1 + _SLACK) < low)
        if open_.any():
            d = squared(x[open_], centroids)
            near = d.argmin(1)
            at = np.arange(len(d))
            cluster[open_], own[open_] = near, d[at, near]
            d[at, near] = np.iinfo(np.int64).max
            low[open_] = np.sqrt(d.min(1)) * (1 - _SLACK)
        columns = [batch.column("key"), batch.column("v"), pa.array(cluster), pa.array(own), pa.array(low), pa.array(open_)]
        return pa.RecordBatch.from_arrays(columns, ["key", "v", "cluster", "own", "low", "scanned"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                yield step(batch.slice(at, _STEP))

    return rows.mapInArrow(run, f"key {key}, {_STATE}")


def clustered(vectors: DataFrame, centroids: list[list[int]], rounds: int, loosen=loosening) -> Clusters:
    """``rounds`` rounds of assignment and move over ``key, v``, then a last assignment."""
    rows = stage(vectors, "vectors")
    now, lost, scanned = np.array(centroids, np.int64), None, []
    for turn in range(rounds + 1):
        before, rows = rows, stage(_assigned(rows, now, lost), "assigned")
        discard(before)
        totals = [F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(now.shape[1])] if turn < rounds else []
        per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("own").alias("far"), F.count_if("scanned").alias("k"), *totals).collect()
        scanned.append(sum(r["k"] for r in per))
        if turn == rounds:
            return Clusters(rows, now.tolist(), scanned)
        moved, radius = now.copy(), np.zeros(len(now))
        for r in per:  # one row per cluster
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(now.shape[1])]
            radius[r["cluster"]] = np.sqrt(r["far"]) * (1 + _SLACK)
        lost = loosen(now, moved, radius)
        now = moved
    raise ValueError("rounds must not be negative")


def embedding_clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, length: int = 64, scale: int = 256) -> DataFrame:
    """The columns of query ``op13_centroids``."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    vectors = integer_vectors(embeddings, "vec_id", "embedding", length, scale)
    start = first_centroids(vectors, k, "2:")
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = clustered(vectors, start, rounds)
    sums = {r["cluster"]: r["s"] for r in found.members.groupBy("cluster").agg(F.sum("own").alias("s")).collect()}  # one row per cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    at = F.col("cluster") + 1
    return found.members.select(
        F.col("key").alias("vec_id"),
        "cluster",
        F.col("own").alias("distance"),
        F.element_at(F.array(*[F.lit(sums.get(i, 0)).cast("bigint") for i in range(len(digests))]), at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digests]), at).alias("centroid_sha256"),
    )


def _sql(k: int = 40, rounds: int = 5, length: int = 64, scale: int = 256) -> str:
    parts = [f"""
WITH kept AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS id, v
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {length})),
cells AS (SELECT id, unnest(generate_series(1, {length})) AS i, unnest(v) AS x FROM kept),
c0 AS (SELECT CAST(id AS INTEGER) AS c, i, x FROM cells WHERE id < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT id, c, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d FROM cells a JOIN c{r} b USING (i) GROUP BY id, c),
a{r} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY id)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r} JOIN cells USING (id) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c, i))""")
    parts.append(f"""digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (id) JOIN digest ON digest.c = a.c
"""


SQL = _sql()
