"""Whitening of embeddings with MLlib block matrices.

Entries become whole numbers, ``floor(64 * c) + 1000000``, whose sums are exact.
Rows are numbered, centred and dealt into a block matrix A. Its transpose times
A is the scatter, summed over splits of the rows, so no task multiplies all
blocks. The driver solves the eigenproblem of that one (dimension x dimension)
matrix, and A times the whitening matrix projects every row. The projected rows
give their own covariance in the same way, whose distance from the identity is
measured, not derived.

Rows whose vector is null, empty, or holds a null or non-finite entry, or one
beyond 2^52 in whole numbers, take no part. Vectors of another length are another
space: every length is whitened by itself (one pass of jobs per length). Repeated
rows count and come back as often as they stand there; rows without an id are
kept. A component without variance (its eigenvalue is nought to the precision of
the others) has a null ``whitened`` and takes no part in ``identity_error``; an
exact deviation that no long holds is null. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.ordering import positions
from tallyroom.session import cut_lineage

#: Rows of a block; a product over the rows is summed in so many splits.
BLOCK_ROWS, SPLITS = 1024, 64
KEPT = StorageLevel.MEMORY_AND_DISK
COMPONENTS = 32
OUT = "n bigint, deviation bigint, component int, whitened double, explained double, identity_error double"


def whole(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of every entry, or null where the vector takes no part."""
    sound = (F.size(vector) > 0) & F.forall(
        vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < 2.0**52, F.lit(False)) & ~F.isnan(c)
    )
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift))


def times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b; a long inner dimension is cut into splits that are summed afterwards."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def gram(a: BlockMatrix) -> np.ndarray:
    """The transpose of ``a`` times ``a``: columns x columns, on the driver."""
    splits = max(1, min(SPLITS, -(-a.numRows() // a.rowsPerBlock)))
    return times(a.transpose(), a, splits).toLocalMatrix().toArray()


def block_matrix(rows: DataFrame, count: int, width: int) -> BlockMatrix:
    """A block matrix of rows (index, vector), one column of blocks."""
    vectors = rows.select("index", array_to_vector("vector").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, width)
    return indexed.toBlockMatrix(BLOCK_ROWS, width)


def row_table(matrix: BlockMatrix) -> DataFrame:
    """Rows (index, vector) of a block matrix as arrays."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("vector"))


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def whitened_space(vectors: DataFrame, keep: list[str], width: int, components: int) -> DataFrame:
    """``vectors``: columns ``keep`` and ``_x``, whole numbers of one width."""
    spark = vectors.sparkSession
    entries = vectors.select(F.posexplode("_x").alias("at", "x"))
    sums = {r.at: (int(r.s), r.n) for r in entries.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("x").alias("n")).collect()}
    n = sums[0][1]
    mean, rest = zip(*(divmod(sums[k][0], n) for k in range(width)))
    # x - S/n, from the exact x - floor(S/n) and the remainder; and n*x - S, exact.
    apart = F.zip_with("_x", longs(list(mean)), lambda x, m: x - m)
    away = F.zip_with("_apart", longs(list(rest)), lambda d, r: F.try_subtract(F.try_multiply(d, F.lit(n).cast("bigint")), r))
    deviation = F.aggregate(away, F.lit(0).cast("bigint"), lambda s, a: F.try_add(s, F.try_multiply(a, a)))
    # A last column of ones carries the means of the columns through every product.
    part = F.array(*(F.lit(r / n) for r in rest))
    centred = F.array_append(F.zip_with("_apart", part, lambda d, r: d.cast("double") - r), F.lit(1.0))
    rows = positions(vectors, [F.col("_x"), *(F.col(f"`{c}`") for c in keep)], "_index").select(
        *(F.col(f"`{c}`") for c in keep), (F.col("_index") - 1).alias("_index"), apart.alias("_apart")
    )

    a = block_matrix(rows.select(F.col("_index").alias("index"), centred.alias("vector")), n, width + 1).persist(KEPT)
    scatter = gram(a)
    variance, trace, whitening = solved(scatter[:width, :width] / n, components)
    k = whitening.shape[1]
    down = np.zeros((width + 1, k + 1))
    down[:width, :k], down[width, k] = whitening, 1.0
    block = [((0, 0), DenseMatrix(width + 1, k + 1, down.ravel(order="F").tolist()))]
    projected = times(a, BlockMatrix(spark.sparkContext.parallelize(block, 1), width + 1, k + 1, width + 1, k + 1)).persist(KEPT)
    square = gram(projected)
    turned = cut_lineage(row_table(projected))
    for matrix in (a, projected):
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    centre = square[:k, k] / n
    error = float(np.abs(square[:k, :k] / n - np.outer(centre, centre) - np.eye(k)).max()) if k else None

    explained = [float(v / trace) if trace > 0 else None for v in variance]
    values = F.transform(F.sequence(F.lit(1), F.lit(len(variance))), lambda c: F.struct(
        c.alias("component"), F.when(c <= k, F.element_at("vector", F.least(c, F.lit(k + 1)))).alias("whitened"),
        F.element_at(F.array(*(F.lit(v).cast("double") for v in explained)), c).alias("explained"),
    ))
    ids = rows.select(*(F.col(f"`{c}`") for c in keep), F.col("_index").alias("index"), "_apart").withColumn("deviation", deviation)
    return ids.drop("_apart").join(turned, "index").select(
        *(F.col(f"`{c}`") for c in keep), F.lit(n).cast("bigint").alias("n"), "deviation", F.explode(values).alias("_value")
    ).select(
        *(F.col(f"`{c}`") for c in keep), "n", "deviation", "_value.*", F.lit(error).cast("double").alias("identity_error")
    )


def solved(covariance: np.ndarray, components: int) -> tuple[np.ndarray, float, np.ndarray]:
    """The largest eigenvalues, the trace, and the whitening matrix of those that
    are above the rounding of the largest."""
    covariance = (covariance + covariance.T) / 2
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    held = value > max(value[0], 0.0) * len(covariance) * 1e-13 if len(value) else value > 0
    return np.maximum(value, 0.0), float(np.trace(covariance)), vector[:, held] / np.sqrt(value[held])


def whiten(vectors: DataFrame, keep: list[str], embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: the columns ``keep``, ``n``, ``deviation``,
    ``component``, ``whitened``, ``explained`` and ``identity_error``."""
    spark: SparkSession = vectors.sparkSession
    sound = vectors.select(*(F.col(f"`{c}`") for c in keep), whole(F.col(f"`{embedding}`")).alias("_x")).filter("_x IS NOT NULL")
    widths = sorted(r.w for r in sound.select(F.size("_x").alias("w")).distinct().collect())
    spaces = [whitened_space(sound.filter(F.size("_x") == w), keep, w, components) for w in widths]
    if spaces:
        return reduce(DataFrame.unionByName, spaces)
    none = spark.createDataFrame([], OUT)
    return vectors.limit(0).select(*(F.col(f"`{c}`") for c in keep)).join(none, F.lit(False))
