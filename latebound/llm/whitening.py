"""Embedding whitening with MLlib's distributed block matrices.

Every entry of a vector becomes the integer ``floor(scale * c)``. The mean and
the covariance are those of the different integer vectors (the fit list), so
that copies weigh nothing; all vectors are projected.

1. The vectors are written with a dense row number; the fit list is one
   aggregate by the integer vector (partial before the shuffle, so a vector that
   a third of all rows hold moves as a row per task) that keeps its least number.
2. The exact integer sums of the fit list give centred rows ``(n * x - S) / n``.
   Numbered centred rows are an ``IndexedRowMatrix`` and then a ``BlockMatrix``
   of ``rows_per_block`` rows a block; rows that are not in the fit list are
   absent from its matrix, which counts as zero.
3. Scatter: the transposed block matrix times itself. The middle dimension is
   split over as many partial products as there are partitions, so that no task
   adds up all blocks. The result has d * d numbers; its eigenvectors are found
   locally (``eigh``).
4. The block matrix of all rows times the whitening matrix (eigenvectors over the
   square roots of their eigenvalues) projects every row.

Bounded on the driver: d sums, the d * d scatter, and a pair of numbers per block
(MLlib plans its products by block coordinates; ``rows_per_block`` sets how many).

Cases: null vectors and vectors with null or non-finite entries go, and so do
empty ones and those of another number of entries than most vectors have (of
equally many, the larger number). Components whose eigenvalue is zero to
double precision (at most ``least`` of the trace) cannot be whitened and are left
out, so equal vectors, or one alone, have none. Equal ids and repeated rows are rows of
their own, null ids stay; an empty table gives an empty table; other columns
are ignored. Entries so large that n * x passes 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written

#: Eigenvalues up to this share of the trace are rounding errors of zero.
LEAST = 1e-12


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x`` of the vectors that count, x as longs."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter((F.size(v) > 0) & ~bad)
            .select("id", F.transform(v, lambda c: F.floor(scale * c)).alias("x")))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with ``idx``, numbers from 0 without gaps: the place in the written partition and the
    partition's offset, a running sum over one count per partition."""
    placed = written(df.select("*", F.spark_partition_id().alias("_part"),
                               F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos")), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_offset") + F.col("_pos")).cast("long").alias("idx"))


def centred(n: int, sums: list[int]) -> Column:
    """``(n * x - S) / n`` of the column ``x``: exact but for the division."""
    return F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]),
                      lambda a, s: (F.lit(n).cast("long") * a - s).cast("double") / F.lit(float(n)))


def block_matrix(rows: DataFrame, n_rows: int, dim: int, rows_per_block: int) -> BlockMatrix:
    """The rows ``idx, v`` as a block matrix with one block across."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select("idx", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(frame, n_rows, dim).toBlockMatrix(rows_per_block, dim)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right`` with the middle dimension in ``splits`` parts; Python's ``multiply`` lacks the
    argument that MLlib's own has."""
    made = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def principal(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of the covariance, falling, their unit vectors as columns, and the trace."""
    cov = (scatter + scatter.T) / (2.0 * n)
    values, vecs = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    top = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST * trace]
    return values[top], vecs[:, top], trace


def identity_error(fitted: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of ``y`` minus the identity, centred before multiplying."""
    if not k:
        return 0.0
    means = fitted.agg(*[F.avg(F.col("y")[i]) for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    part = lambda i: F.col("y")[i] - F.lit(means[i])
    sums = fitted.agg(*[F.sum(part(i) * part(j)) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, sums))


def whitened_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
                     components: int = 4, rows_per_block: int = 1024) -> DataFrame:
    """Per remaining vector: ``vec_id``, ``x`` (array of longs), ``n`` (length of the fit list), ``deviation``
    (decimal: the sum over dimensions of (n * x - S)^2), ``whitened`` (array of doubles, a component each),
    ``explained`` (the components' shares of the variance) and ``identity_error``."""
    spark = vectors.sparkSession
    sound = integer_vectors(vectors, id_col, vector_col, scale)
    most = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 1
    rows = numbered(sound.filter(F.size("x") == dim), "white_rows")
    n_rows = most["count"] if most else 0
    fit = written(rows.groupBy("x").agg(F.min("idx").alias("idx")), "white_fit")
    n, *sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i]) for i in range(dim)]).first()
    if not n:
        k, whiten, explained, error = 0, None, [], 0.0
    else:
        own = block_matrix(fit.select("idx", centred(n, sums).alias("v")), n_rows, dim, rows_per_block)
        splits = spark.sparkContext.defaultParallelism
        scatter = product(own.transpose(), own, splits).toLocalMatrix().toArray()
        values, vecs, trace = principal(scatter, n, components)
        k, whiten, explained = len(values), vecs / np.sqrt(values), [float(e) for e in values / trace]
    if k:
        whole = block_matrix(rows.select("idx", centred(n, sums).alias("v")), n_rows, dim, rows_per_block)
        side = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dim, k, whiten.ravel("F")))], 1), dim, k)
        made = product(whole, side, 1).toIndexedRowMatrix()
        frame = MLUtils.convertVectorColumnsToML(
            callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model).toDF("idx", "y"), "y")
        projected = written(frame.select("idx", vector_to_array("y").alias("y")), "white_projected")
        error = identity_error(projected.join(fit.select("idx"), "idx", "left_semi"), n, k)
        rows = rows.join(projected, "idx")
    else:
        rows, error = rows.withColumn("y", F.array().cast("array<double>")), 0.0
    whole_sum = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(s or 0).cast("long") for s in sums]),
                   lambda a, s: (F.lit(n).cast("long") * a - s).cast("decimal(19,0)")),
        F.lit(0).cast("decimal(38,0)"), lambda total, c: (total + c * c).cast("decimal(38,0)"))
    return rows.select(F.col("id").alias("vec_id"), "x", F.lit(n).cast("long").alias("n"), whole_sum.alias("deviation"),
                       F.col("y").alias("whitened"),
                       F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
                       F.lit(float(error)).alias("identity_error"))


def by_component(found: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1; ``deviation`` as a long (an error if it does not fit)."""
    rows = found.select("vec_id", "n", "deviation", "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n",
                       F.col("deviation").cast("long").alias("deviation"), F.col("c.whitened").alias("whitened"),
                       F.col("c.explained").alias("explained"), "identity_error")
