"""Centroid clustering with a pivot table (LAESA).

Vectors become integers ``floor(scale * c)``; all distances are exact.

1. The first centroids are the ``k`` vectors with the smallest
   ``sha256("<seed>:<id>")``. The first ``pivots`` of them are also the pivots.
2. The pivot table is written once: each vector's integers, as bytes, and its
   distances to the pivots, which never change.
3. A round reads the table in tasks. The distances of a centroid to the pivots and
   the stored ones give a lower bound of the vector's distance to the centroid,
   the greatest difference over the pivots (triangle inequality). The centroid
   of the least bound gets its exact distance first; then, in the order of
   their numbers, only those whose bound does not pass the best distance so far. Bounds are
   doubles and give way by ``SLACK``, so rounding never loses a centroid; exact
   distances and ties (the smaller number) are 64-bit integers.
4. Each task adds up its vectors per cluster and dimension; one aggregate sums
   the tasks' rows, and the driver gets k * d sums. A third of all vectors in one
   cluster is one row per task and dimension. New centroids are exact floors.

Bounded on the driver and sent to tasks: k centroids, their k * pivots distances.

Cases: null vectors, those with another number of components than ``dim`` and
those with null or non-finite components go; with fewer than ``k`` vectors all
of them are centroids; equal vectors, ids and rows are vectors of their own
(among equal hashes the smaller vector comes first, vectors without an id come
after all others); an empty table gives an empty table; other columns are
ignored. Components beyond 2^26 after scaling raise an error: their squares
would pass 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import written

#: Greatest size of an integer component.
LIMIT = 1 << 26
#: Bounds are lowered by this share and this much before they rule out a centroid.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dim: int) -> DataFrame:
    """``id, x`` of the vectors that count, x as longs."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(scale * c))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter((F.size(v) == dim) & ~bad).select("id", x.alias("x"))
            .withColumn("x", F.when(F.exists("x", lambda c: F.abs(c) > LIMIT), F.raise_error(F.lit(
                f"components beyond {LIMIT} after scaling"))).otherwise(F.col("x"))))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector or to as many rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))


def lower_bounds(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Rows by centroids: no distance is less."""
    out = np.zeros((len(table), len(own)))
    for p in range(table.shape[1]):
        np.maximum(out, np.abs(table[:, p:p + 1] - own[None, :, p]), out=out)
    return out * (1 - SLACK) - SLACK


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance, and how many exact distances that took."""
    bounds = lower_bounds(table, own)
    first = bounds.argmin(axis=1)
    number, best = first.copy(), squared(x, centroids[first])
    reach, used = np.sqrt(best.astype(np.float64)), len(x)
    for j in range(len(centroids)):
        at = np.flatnonzero((bounds[:, j] <= reach) & (first != j))
        used += len(at)
        d = squared(x[at], centroids[j])
        nearer = (d < best[at]) | ((d == best[at]) & (j < number[at]))
        at, d = at[nearer], d[nearer]
        number[at], best[at], reach[at] = j, d, np.sqrt(d.astype(np.float64))
    return number, best, used


def _unpacked(pdf: pd.DataFrame, dim: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(pdf["x"]), dtype="<i4").reshape(len(pdf), dim).astype(np.int64)
    return x, np.frombuffer(b"".join(pdf["pivots"]), dtype="<f8").reshape(len(pdf), pivots)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, x, pivots``, the last two as little-endian bytes, written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_list()).astype(np.int64)
                d = pivot_distances(x, pivots).astype("<f8")
                yield pd.DataFrame({"id": pdf["id"], "x": [r.tobytes() for r in x.astype("<i4")],
                                    "pivots": [r.tobytes() for r in d]})

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInPandas(run, f"id {kind}, x binary, pivots binary"), "pivot_table")


def cluster_sums(table: DataFrame, centroids: np.ndarray, own: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums per non-empty cluster."""
    k, dim = centroids.shape
    n_pivots = own.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Python's integers do not overflow, whatever a task holds; a batch's sums fit 64 bits.
        counts, sums = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
        for pdf in batches:
            if len(pdf):
                x, stored = _unpacked(pdf, dim, n_pivots)
                number, _, _ = nearest(x, stored, centroids, own)
                for j in np.unique(number):
                    mine = x[number == j]
                    counts[j] += len(mine)
                    sums[j] += mine.sum(axis=0).astype(object)
        js, ds = np.nonzero(np.repeat(counts[:, None] > 0, dim, axis=1))
        yield pd.DataFrame({"j": js, "d": ds, "n": [str(counts[j]) for j in js],
                            "s": [str(sums[j, d]) for j, d in zip(js, ds)]})

    parts = table.mapInPandas(run, "j int, d int, n string, s string")
    total = parts.groupBy("j", "d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s")])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("j", "d").collect():  # k * dim rows at most
        out.setdefault(r["j"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def centroid_clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64,
                      scale: int = 64, k: int = 16, rounds: int = 3, pivots: int = 16, seed: int = 1) -> DataFrame:
    """Per kept vector: ``vec_id``, ``cluster``, ``distance`` (squared, to its centroid), ``exact`` (exact
    distances that its task computed, per vector, in the last assignment), ``cluster_inertia``, ``inertia``,
    ``centroid`` (array of longs)."""
    rows = whole_vectors(vectors, id_col, vector_col, scale, dim)
    kind = rows.schema["id"].dataType.simpleString()
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.select(sha.alias("sha"), "x").orderBy(F.asc_nulls_last("sha"), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in start], dtype=np.int64).reshape(len(start), dim)
    fixed = centroids[:pivots].copy()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], (
            f"vec_id {kind}, cluster int, distance long, exact double, cluster_inertia long, inertia long, "
            "centroid array<long>"))
    table = pivot_table(rows, fixed)
    for _ in range(rounds):
        for j, (n, sums) in cluster_sums(table, centroids, pivot_distances(centroids, fixed)).items():
            centroids[j] = [s // n for s in sums]
    own = pivot_distances(centroids, fixed)
    final = centroids.copy()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                number, best, used = nearest(*_unpacked(pdf, dim, len(fixed)), final, own)
                yield pd.DataFrame({"id": pdf["id"], "cluster": number, "distance": best, "exact": used / len(pdf)})

    found = written(table.mapInPandas(assign, f"id {kind}, cluster int, distance long, exact double"), "pivot_assigned")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia").alias("s")).first()["s"] or 0
    centres = vectors.sparkSession.createDataFrame([(j, c.tolist()) for j, c in enumerate(final)], "cluster int, centroid array<long>")
    return found.join(inertia.join(centres, "cluster"), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "exact", "cluster_inertia",
        F.lit(int(total)).cast("long").alias("inertia"), "centroid")


def digest(centroid) -> Column:
    """Lowercase hex sha256 of a centroid's components, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda c: c.cast("string")), ","), 256)
