"""Embedding whitening with distributed block matrices.

Vectors become integers, ``floor(64 c) + 1000000`` per entry. The fit list holds
each distinct vector once. Its centred rows are indexed into a ``BlockMatrix``;
the transpose times the matrix, over slices of blocks, is the scatter, whose
eigenvectors are found on the driver: the matrix has as many rows as a vector has
entries, ``MAX_DIMENSIONS`` at most. All rows, repeated ones too, are indexed
into a second block matrix and multiplied by the whitening matrix, so no join on
a vector is needed and a frequent vector burdens no task.

A row is left out if its vector is null, empty, or holds a null or non-finite
entry, or has another length than most vectors (of equally frequent lengths the
greatest holds). Directions without variance have ``whitened`` and ``explained``
0 and do not count in ``identity_error``. Null and repeated vec_ids are ids like
others. An empty table gives no rows. A deviation that does not fit a long
raises. Columns other than vec_id and embedding are not read.
"""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MAX_DIMENSIONS = 4096
BLOCK_VALUES = 1 << 18          # of a block
SLICE_BLOCKS = 8                # blocks of one slice of the scatter
LEAST = 1e-12                   # variance of a direction, as a share of the largest


def integers(embedding: Column) -> Column:
    """The entries as integers; null if an entry is null or not finite."""
    def finite(c):
        return F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))

    whole = F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return F.when(F.forall(embedding, finite), whole)


def indexed(rows: DataFrame) -> DataFrame:
    """Stored rows with a number ``at`` from 0 on, without gaps.

    Row numbers of a partition are shifted by the counts of the partitions before.
    """
    numbered = stored(rows.withColumn("_row_", F.monotonically_increasing_id()))
    part = F.shiftright("_row_", 33)
    before = Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(part.alias("_part_")).agg(F.count("*").alias("n"))     # a row per partition
    offsets = counts.select("_part_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before_"))
    return numbered.join(F.broadcast(offsets), part == F.col("_part_")).withColumn(
        "at", F.col("_before_") + F.col("_row_").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row_", "_part_", "_before_")


def summed(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exact."""
    sums = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()   # a row per dimension
    by = {r["pos"]: r for r in sums}
    return (by[0]["n"] if by else 0), [int(by[k]["s"]) for k in range(len(by))]


def offsets_from_mean(n: int, sums: list[int]) -> Column:
    """``n x - S`` per entry, exact."""
    listed = F.array(*[F.lit(s) for s in sums])
    return F.zip_with("x", listed, lambda v, s: v * F.lit(n) - s)


def block_matrix(rows: DataFrame, n: int, sums: list[int], height: int) -> BlockMatrix:
    """Centred rows (``at``, ``x``) as a block matrix of ``height`` rows."""
    width = len(sums)
    centred = F.transform(offsets_from_mean(n, sums), lambda v: v / F.lit(float(n)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector(centred).alias("v")), "v")
    return IndexedRowMatrix(vectors, height, width).toBlockMatrix(max(1, BLOCK_VALUES // width), width)


def product(left: BlockMatrix, right: BlockMatrix, slices: int = 1) -> BlockMatrix:
    """Product of block matrices; the inner dimension is summed in ``slices`` apart, so that no task takes all of it."""
    inner = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, slices)
    return BlockMatrix(inner, left.rowsPerBlock, right.colsPerBlock)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix; as many rows as the matrix has columns."""
    slices = -(-matrix.numRowBlocks // SLICE_BLOCKS)
    found = product(matrix.transpose(), matrix, slices).toLocalMatrix().toArray()
    return (found + found.T) / 2


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs


def local_blocks(spark, matrix: np.ndarray, height: int) -> BlockMatrix:
    """A small matrix as one block."""
    block = Matrices.dense(*matrix.shape, matrix.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), height, matrix.shape[1], *matrix.shape)


def vectors_of(table: DataFrame) -> DataFrame:
    """vec_id and integers ``x`` of the rows that stay, before lengths are compared."""
    return table.select("vec_id", integers(F.col("embedding")).alias("x")).filter("size(x) > 0")


def whiten(table: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every remaining row."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    rows = indexed(vectors_of(table))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    width = lengths[0]["d"]
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; at most {MAX_DIMENSIONS}")
    height = rows.agg(F.max("at")).first()[0] + 1
    rows = rows.filter(F.size("x") == width)
    fit = indexed(rows.groupBy("x").agg(F.lit(1)).select("x"))
    n, sums = summed(fit)
    fitted = block_matrix(fit, n, sums, n)
    values, vectors = components(gram(fitted) / n)
    count = min(count, width)
    live = values[:count] > LEAST * max(values[0], np.finfo(float).tiny)
    whitening = np.where(live, vectors[:, :count] / np.sqrt(np.where(live, values[:count], 1)), 0)
    weights = local_blocks(spark, whitening, width)
    again = gram(product(fitted, weights)) / n
    error = float(np.abs(again - np.eye(count))[np.ix_(live, live)].max(initial=0))
    trace = float(values.sum())
    explained = F.array(*[F.lit(float(v) / trace if trace else 0.0) for v in values[:count]])
    projected = product(block_matrix(rows, n, sums, height), weights).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    whitened = found.select(F.col("index").alias("_index_"), vector_to_array("vector").alias("w"))
    squares = F.aggregate(offsets_from_mean(n, sums), F.lit(0).cast("long"), lambda acc, v: acc + v * v)
    told = rows.select("at", "vec_id", squares.alias("deviation"))
    return told.join(whitened, F.col("at") == F.col("_index_")).select(
        "vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
