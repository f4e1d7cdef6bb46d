"""Embedding whitening on MLlib block matrices.

Vectors become integers, so that their sums are exact. Rows are indexed without
gaps, centred, and cut into a distributed BlockMatrix. Its transpose times itself
is the scatter; a local `eigh` of that one (dimension x dimension) matrix gives
the components; and a BlockMatrix product with the whitening matrix projects the
rows.

Scale. A product of block matrices deals its result by a grid over result
blocks: a tall product gets the square root of its operands' partitions. So rows
are held in stripes of at most `STRIPE` blocks, each stripe a BlockMatrix whose
row partitions are the square of the tasks it shall have, and the scatter splits
its middle dimension by blocks, which bounds what a task holds. Nothing else
than (dimension x dimension) numbers and block indices passes the driver. Rows
with equal vectors, however many, are rows of their own: no key is shared.

Which rows take part: a vector that is null, or has a null or non-finite entry,
is dropped, as is one of another dimension than most rows have (ties: the larger)
and one with an entry of 2^20 or more, beyond which no deviation fits a long.
Null ids and repeated rows stay, each a row. Components whose eigenvalue is under
1e-12 of the largest are left out, as the rows do not vary along them: fewer than
two different vectors give no rows. Empty tables give an empty result. Other
columns do not enter.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import stored, table

#: rows and columns of a block; blocks that a task of a product gets; blocks in a stripe
ROWS, COLS, HELD, STRIPE = 4096, 1024, 8, 1024
LARGEST = float(1 << 20)
SCALE, SHIFT = 1024, 100_000
FLAT = 1e-12
BLOCK = T.StructType([T.StructField("at", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])), T.StructField("matrix", MatrixUDT())])


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors that take part, as whole numbers."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = (df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0)))
    return rows.select("id", F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def indexed(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """((index from 0 without gaps, id, x), rows, dimension).

    Each row is written with its task and its number there; the tasks' counts,
    one row a task, give where each begins."""
    rows = _usable(df, id_col, vector_col)
    rows = stored(rows.withColumn("task", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id() - F.shiftleft(F.col("task").cast("bigint"), 33)), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.select(F.col("number").alias("index"), "id", "x"), 0, 0
    d = sizes["d"]
    mixed = rows.where(F.size("x") != d).limit(1).count() > 0
    if mixed:
        rows = stored(rows.where(F.size("x") == d).select("id", "x").withColumn("task", F.spark_partition_id())
                      .withColumn("number", F.monotonically_increasing_id() - F.shiftleft(F.col("task").cast("bigint"), 33)), "vectors")
    begin, n = [], 0
    for r in rows.groupBy("task").count().orderBy("task").collect():  # as many as the scan has tasks
        begin.append((r["task"], n))
        n += r["count"]
    first = df.sparkSession.createDataFrame(begin, "task int, begin bigint")
    return rows.join(F.broadcast(first), "task").select((F.col("begin") + F.col("number")).alias("index"), "id", "x"), n, d


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Per dimension, the exact sum (2^53 rows of 2^31 would exceed a long)."""
    parts = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    found = {r.k: int(r.s) for r in parts.collect()}
    return [found[k] for k in range(d)]


def _blocks(rows: DataFrame, at: int, n: int, d: int, rows_per_block: int) -> tuple[BlockMatrix, int]:
    """The stripe of `n` rows from index `at` as a BlockMatrix, and its tasks."""
    tasks = ceil(n / rows_per_block / HELD) if n > rows_per_block * HELD * 64 else ceil(n / rows_per_block)
    part = rows.where((F.col("index") >= at) & (F.col("index") < at + n)).select((F.col("index") - at).alias("index"), array_to_vector("y").alias("vector"))
    part = MLUtils.convertVectorColumnsFromML(part.repartition(tasks * tasks), "vector")
    return IndexedRowMatrix(part, n, d).toBlockMatrix(rows_per_block, min(d, COLS)), tasks


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, the middle dimension dealt to so many tasks."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _local_blocks(spark: SparkSession, w: np.ndarray, rows_per_block: int, cols_per_block: int, partitions: int) -> BlockMatrix:
    """A small matrix as a BlockMatrix over so many partitions."""
    d, k = w.shape
    cut = [((i // rows_per_block, j // cols_per_block), w[i:i + rows_per_block, j:j + cols_per_block]) for i in range(0, d, rows_per_block) for j in range(0, k, cols_per_block)]
    held = spark.createDataFrame([(at, Matrices.dense(*m.shape, m.flatten(order="F"))) for at, m in cut], BLOCK).repartition(partitions)
    made = callMLlibFunc("createBlockMatrix", held, rows_per_block, cols_per_block, d, k)
    return BlockMatrix(made, rows_per_block, cols_per_block)


def components(scatter: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance,
    at most k, without those along which rows do not vary; and its trace."""
    v = (scatter + scatter.T) / (2 * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = np.flatnonzero(e > FLAT * max(e[0], 0))[:k] if len(e) and e[0] > 0 else []
    return e[keep], u[:, keep], float(np.trace(v))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of `w` (arrays of k) minus 1."""
    one = F.col("w")
    means = whitened.agg(*[F.avg(one[i]).alias(f"m{i}") for i in range(k)]).first()
    at = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.sum((one[i] - means[i]) * (one[j] - means[j])).alias(f"c{i}_{j}") for i, j in at]).first()
    return max(abs(found[f"c{i}_{j}"] / n - (i == j)) for i, j in at)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rows_per_block: int = ROWS, stripe: int = STRIPE) -> DataFrame:
    """(id_col, n, deviation decimal(38,0), whitened array<double>, explained
    array<double>, identity_error): a row for each vector that takes part.

    deviation: the sum over dimensions of (n * x - S)^2, exact, null beyond 38 digits.
    """
    spark = df.sparkSession
    rows, n, d = indexed(df, id_col, vector_col)
    none = {"n": "bigint", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
    nothing = rows.where("false").select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    if not n:
        return nothing
    # x - S/n = (x - q) - r/n with S = q n + r: whole numbers up to the last step
    q, r = zip(*[divmod(s, n) for s in _sums(rows, d)], strict=True)
    x_q = F.zip_with("x", F.array(*[F.lit(v).cast("bigint") for v in q]), lambda x, m: x - m)
    big = lambda c: c.cast("decimal(38,0)")
    add = lambda a, b: F.try_add(a, b).cast("decimal(38,0)")
    squares = F.aggregate(F.col("z"), big(F.lit(0)), lambda s, z: add(s, big(z * z)))
    mixed = F.aggregate(F.zip_with("z", F.array(*[F.lit(v).cast("bigint") for v in r]), lambda z, m: F.try_multiply(big(z), big(m)).cast("decimal(38,0)")), big(F.lit(0)), add)
    c = F.lit(sum(v * v for v in r)).cast("decimal(38,0)")
    whole = F.lit(n).cast("decimal(19,0)")
    times = lambda a, b: F.try_multiply(a, b).cast("decimal(38,0)")
    deviation = add(add(times(whole, times(whole, F.col("a"))), times(F.lit(-2 * n).cast("decimal(20,0)"), F.col("b"))), c)
    centred = F.zip_with("z", F.array(*[F.lit(v / n) for v in r]), lambda z, m: z.cast("double") - m)
    held = stored(rows.select("index", "id", x_q.alias("z")).select("index", "id", centred.alias("y"), squares.alias("a"), mixed.alias("b"))
                  .select("index", "id", "y", deviation.alias("deviation")), "centred")

    cuts = range(0, n, stripe * rows_per_block)
    scatter = np.zeros((d, d))
    stripes = []
    for at in cuts:
        size = min(stripe * rows_per_block, n - at)
        m, tasks = _blocks(held, at, size, d, rows_per_block)
        scatter += _product(m.transpose(), m, max(1, ceil(size / rows_per_block / HELD))).toLocalMatrix().toArray()
        stripes.append((at, m, tasks))
    e, u, trace = components(scatter, n, k)
    if not len(e):
        return nothing
    w = u / np.sqrt(e)
    projected = []
    for at, m, tasks in stripes:
        made = _product(m, _local_blocks(spark, w, m.colsPerBlock, len(e), tasks * tasks), 1).toIndexedRowMatrix()
        part = callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model)
        projected.append(part.select((F.col("index") + at).alias("index"), vector_to_array("vector").alias("w")))
    projected = stored(reduce(DataFrame.unionByName, projected), "whitened")
    error = identity_error(projected, n, len(e))
    explained = F.array(*[F.lit(float(v / trace)) for v in e])
    return (held.join(projected, "index")
            .select(F.col("id").alias(id_col), F.lit(n).cast("bigint").alias("n"), "deviation", F.col("w").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; `deviation` is null where it is beyond a long."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return (rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"))
