"""Tables that runs merge into by key (inventory M1, M2, D9).

A table is a folder of Parquet files, one partition a bucket of the key's hash. A
run reads and rewrites only the buckets that its rows fall in, as a dynamic
partition overwrite: Spark writes them aside and puts them in place when the whole
job has succeeded, so a failed run leaves what was there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table without its bucket column; None where there is none."""
    try:
        return spark.read.parquet(path).drop(_BUCKET)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_into(path: str, incoming: DataFrame, keys: Sequence[str], ord_col: str | None = None, buckets: int = BUCKETS) -> int:
    """Merge `incoming` by `keys`; the last write wins: the row of the largest
    `ord_col`, of equal ones that of this run. Rows with a null key are rejected.
    Returns how many buckets were rewritten. A table keeps its number of buckets."""
    spark = incoming.sparkSession
    keyed = incoming.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    new = keyed.withColumn(_BUCKET, bucket_of(keys, buckets)).withColumn("_new", F.lit(1)).checkpoint()
    touched = [r[_BUCKET] for r in new.select(_BUCKET).distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    try:
        old = spark.read.parquet(path).where(F.col(_BUCKET).isin(touched)).withColumn("_new", F.lit(0))
        rows = old.select(*new.columns).unionByName(new)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = new
    values = [c for c in incoming.columns if c not in keys]
    order = F.struct(*([F.col(ord_col)] if ord_col else []), F.col("_new"))
    last = F.max_by(F.struct(*values), order) if values else F.max("_new")
    merged = rows.groupBy(_BUCKET, *keys).agg(last.alias("_v"))
    out = merged.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values], _BUCKET).select(*incoming.columns, _BUCKET)
    (out.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path))
    return len(touched)
