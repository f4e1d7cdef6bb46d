"""Vectors of short texts, learned in Spark (inventory I7, H13).

The vector column of the code master: terms become TF-IDF rows over hashed words
and letter groups, and a truncated singular value decomposition of that matrix
(MLlib, distributed: the driver holds vectors of `n_features` numbers only) gives
each term a dense vector of length 1. Terms that share words or stems are near.
"""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxspark.operators.features import TOKEN_PATTERN, tokens


def term_parts(text, letters: int = 4) -> Column:
    """Words of a term, and every `letters` neighbouring letters of its words."""
    words = tokens(text, TOKEN_PATTERN)
    padded = F.transform(words, lambda w: F.concat(F.lit("<"), w, F.lit(">")))
    groups = F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (letters - 1))), lambda i: F.substring(w, i, letters))))
    return F.coalesce(F.concat(words, groups), F.array().cast("array<string>"))


def term_vectors(terms: DataFrame, text: str, k: int = 64, n_features: int = 1 << 12) -> DataFrame:
    """(text, vector array<double>) of every different term: unit length, or zeros for
    a term without a word. Fewer than `k` directions are given where the terms do
    not have more."""
    distinct = terms.select(F.col(text).alias("term")).where("term IS NOT NULL").distinct()
    rows = distinct.withColumn("parts", term_parts("term")).checkpoint()
    # a term's number: its task and its place there, made gapless per task by the counts
    numbered = rows.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).checkpoint()
    sizes = numbered.groupBy("task").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    begin = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    indexed = numbered.join(begin, "task").select((F.col("begin") + F.col("at")).alias("index"), "term", "parts").checkpoint()
    n = indexed.count()
    if not n:
        return indexed.select(F.col("term").alias(text), F.array().cast("array<double>").alias("vector"))
    counted = HashingTF(inputCol="parts", outputCol="tf", numFeatures=n_features).transform(indexed)
    weighted = IDF(inputCol="tf", outputCol="w").fit(counted).transform(counted)
    unit = Normalizer(inputCol="w", outputCol="vector").transform(weighted).select("index", "vector")
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(unit, "vector"), n, n_features)
    svd = matrix.computeSVD(min(k, n, n_features), computeU=True)
    scale = [float(s) for s in svd.s]
    left = callMLlibFunc("getIndexedRows", svd.U._java_matrix_wrapper._java_model)
    dense = left.select("index", F.zip_with(vector_to_array("vector"), F.array(*[F.lit(s) for s in scale]), lambda u, s: u * s).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dense = dense.select("index", F.transform("v", lambda x: F.when(norm > 1e-9, x / norm).otherwise(F.lit(0.0))).alias("vector"))
    return indexed.join(dense, "index").select(F.col("term").alias(text), "vector")


def cosine(a, b) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
