"""Whitening of vectors with Spark MLlib's distributed block matrices.

Vectors become whole numbers x = floor(scale * c) + shift.  Each distinct x is one row of the fit list, centred by exact whole numbers,
(n * x - S) / n, before anything is multiplied.  The centred rows, indexed without gaps, become a BlockMatrix A of ``rows_per_block`` rows;
A' A (the middle dimension is split, so no task has all blocks) gives the scatter, its eigenvectors come from a local ``eigh`` of
d x d numbers, and A W projects the rows.  Rows with equal vectors are projected once and joined by a digest.

MLlib keeps the places of all blocks on the driver to plan a product: one pair of numbers for each ``rows_per_block`` rows.  Nothing else of
the driver's or a task's grows with the table but d x d sums.

Defined cases: rows whose vector is null, empty or has null or non-finite entries are left out; equal rows each have their result;
vectors of several lengths are an error (ValueError); an eigenvalue that is zero up to rounding has no whitened values (null), and such components do not
count for ``identity_error``; an empty table has no rows; fewer dimensions than ``components`` give fewer components.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import scratch
from .numbering import in_order

ROWS_PER_BLOCK = 4096
#: Blocks of either side that a task multiplies.
BLOCKS_A_TASK = 8


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift for each entry; null unless all entries are finite numbers."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift))


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the middle dimension cut into ``splits`` (an argument that only MLlib's JVM method has)."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def gram(a: BlockMatrix) -> np.ndarray:
    """A' A as a local matrix of (columns of A) squared numbers."""
    splits = max(1, -(-a.numRowBlocks // BLOCKS_A_TASK))
    return _times(a.transpose(), a, splits).toLocalMatrix().toArray()


def eigen(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    e, q = np.linalg.eigh((v + v.T) / 2)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return e, q * np.where(np.take_along_axis(q, np.abs(q).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """key, component (from 1), n, deviation (decimal, exact), whitened, explained, identity_error of each row and component."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    src = rows.select(F.col(key).alias("key"), whole_numbers(F.col(vector), scale, shift).alias("x")).where("x is not null")
    src = src.withColumn("digest", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)))
    members = scratch.materialize(src.select("key", "digest"), "members")
    fit = scratch.materialize(in_order(src.groupBy("digest", "x").agg(F.count("*").alias("copies")).drop("copies"), [], [], "index"), "fit")
    n, d, most = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if d != most:
        raise ValueError(f"vectors of {d} and of {most} entries")
    sums = list(fit.agg(*[F.sum(F.col("x")[i]) for i in range(d)]).first())
    off = F.zip_with("x", F.array(*map(F.lit, sums)), lambda x, s: x * F.lit(n) - s)
    centred = fit.select("index", array_to_vector(F.transform(off, lambda c: c.cast("double") / n)).alias("vector"))
    a = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d).toBlockMatrix(rows_per_block, d)
    a.persist(StorageLevel.MEMORY_AND_DISK)

    v = gram(a) / n
    e, q = eigen(v, components)
    trace, good = float(np.trace(v)), e > d * np.finfo(float).eps * max(e[0], 0)
    w = np.where(good, q / np.sqrt(np.where(good, e, 1)), 0.0)
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(*w.shape, w.ravel(order="F").tolist()))], 1), d, w.shape[1])
    y = a.multiply(weights)
    y.persist(StorageLevel.MEMORY_AND_DISK)
    projected = callMLlibFunc("getIndexedRows", y.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = scratch.materialize(projected.select("index", vector_to_array("vector").alias("whitened")), "projected")
    second = gram(y) / n
    mean = np.array(projected.agg(*[F.sum(F.col("whitened")[i]) for i in range(len(e))]).first(), float) / n
    left = np.abs(second - np.outer(mean, mean) - np.eye(len(e)))[np.ix_(good, good)]
    error = float(left.max()) if left.size else None
    for m in (a, y):
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)

    wide = F.transform(off, lambda c: c.cast("decimal(19,0)"))
    deviation = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + c * c).cast("decimal(38,0)"))
    done = fit.select("digest", "index", deviation.alias("deviation")).join(projected, "index").select(F.col("digest").alias("known"), "deviation", "whitened")
    whole = members.join(done, F.col("digest") == F.col("known"))
    part = F.array(*[F.lit(float(x / trace)) if trace > 0 else F.lit(None).cast("double") for x in e])
    usable = F.array(*[F.lit(bool(g)) for g in good])
    whole = whole.select("key", "deviation", F.posexplode("whitened").alias("at", "value"))
    return whole.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(usable[F.col("at")], F.col("value")).alias("whitened"), part[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def brute_force(rows: list[tuple], components: int = 16) -> tuple[list[tuple], np.ndarray]:
    """(vec_id, n, deviation) of each row of op12 for (vec_id, vector), and whitened values (rows x components), for tests."""
    kept = [(k, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: [(n * c - s) / n for c, s in zip(x, sums, strict=True)]
    f = np.array([centred(x) for x in fit])
    e, q = eigen(f.T @ f / n, components)
    head = [(k, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for k, x in kept]
    return head, np.array([centred(x) for _, x in kept]) @ q / np.sqrt(e)
