"""Global positions and running sums without a single-partition window.

`Window.orderBy(...)` without `partitionBy` moves every row to one task. Here
the rows are range-partitioned on the sort key instead; each range bucket is
numbered locally and shifted by the row counts (and partial sums) of the
buckets before it. The per-bucket totals have at most
`n_buckets x n_groups` rows, so only that small table is windowed globally.
The bucketed table is checkpointed (reliably, into the shared checkpoint
folder) so that bucket numbers stay fixed if an executor is lost and a stage
is recomputed. Positions alone need a single shuffle (rows are sorted inside
their range partition before the checkpoint); running sums add one window
pass partitioned by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxspark.session import ensure_checkpoint_dir

_B = "_bucket"


def _sort_expr(o) -> Column:
    return F.col(o).asc_nulls_first() if isinstance(o, str) else o


def join_groups(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, null matching null; the keys stand once in the result."""
    right = other.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    cond = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(right, cond, how).drop(*[f"_g_{k}" for k in keys])


def ordered_running(df: DataFrame, order: Sequence, groups: Sequence[str] = (),
                    sums: Sequence[str] = (), pos: str | None = "pos",
                    n_buckets: int | None = None, cum_prefix: str = "cum_") -> DataFrame:
    """Add a 1-based position (restarting per `groups`) and inclusive running
    sums of `sums` in the order `order` (names or sort Columns). The sort key
    must be unique within a group for the result to be deterministic."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = list(groups)
    order_exprs = [_sort_expr(o) for o in order]
    range_exprs = [F.col(g).asc_nulls_first() for g in groups] + order_exprs
    if pos and not sums:
        return _positions_only(df, range_exprs, groups, pos, n_buckets)
    ranged = (df.repartitionByRange(n_buckets, *range_exprs)
              .withColumn(_B, F.spark_partition_id())
              .checkpoint(eager=True))
    totals = ranged.groupBy(_B, *groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _B, *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    out = join_groups(ranged, offsets, [_B, *groups])
    local = Window.partitionBy(_B, *groups).orderBy(*order_exprs)
    if pos:
        out = out.withColumn(pos, (F.col("_o_n") + F.row_number().over(local)).cast("long"))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in sums:
        out = out.withColumn(f"{cum_prefix}{s}", F.col(f"_o_{s}") + F.sum(s).over(running))
    drop = [_B, "_o_n", *[f"_o_{s}" for s in sums]]
    return out.drop(*drop)


def _positions_only(df: DataFrame, range_exprs: list, groups: list, pos: str, n_buckets: int) -> DataFrame:
    """Positions with a single shuffle: rows are sorted inside each range
    partition before the checkpoint, so the partition-local ordinal of
    `monotonically_increasing_id` (partition index in the upper bits, record
    number in the lower 33) is the rank inside the bucket; the checkpoint
    fixes it. Only the per-bucket totals (buckets x groups rows) are
    aggregated and windowed; they reach the rows through a small join."""
    ranked = (df.repartitionByRange(n_buckets, *range_exprs)
              .sortWithinPartitions(*range_exprs)
              .withColumn(_B, F.spark_partition_id())
              .withColumn("_L", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    totals = ranked.groupBy(_B, *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_L").alias("_l0"))
    before = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_B, *groups, "_l0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"))
    out = join_groups(ranked, offsets, [_B, *groups])
    return out.withColumn(pos, (F.col("_o_n") + F.col("_L") - F.col("_l0") + 1).cast("long")) \
        .drop(_B, "_L", "_l0", "_o_n")
