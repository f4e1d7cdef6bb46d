"""Aggregation, ordering and set operators (inventory E1-E12, F2-F9, G1-G2).

Aggregates use Spark's partial + final hash aggregation, so a hot group is
combined map-side before the shuffle. Per-row windows are partitioned by a
row key with a bounded number of entries; global orders go through
`ordering.ordered_running` (range buckets) instead of a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxspark.functions.scalars import col, split_codes_comma, strip_text
from dxspark.operators.ordering import ordered_running


def count_by_keys(df: DataFrame, keys: Sequence, name: str = "frecuencia") -> DataFrame:
    """Rows per key combination; a null key is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_exploded(df: DataFrame, group: Sequence, list_col, out: str = "code",
                   name: str = "frecuencia") -> DataFrame:
    """Split a comma list, one row per code (a null list keeps one null
    row), then count per (group, code). A visit counts once per code."""
    exploded = df.select(*group, F.explode_outer(split_codes_comma(list_col)).alias(out))
    return exploded.groupBy(*exploded.columns).agg(F.count(F.lit(1)).alias(name))


def count_per_value_by_area(df: DataFrame, value: str, area: str, name: str = "frecuencia") -> DataFrame:
    """One groupBy(value, area) instead of one pass per value; value
    stripped first; null value or area dropped (pandas groupby)."""
    v = strip_text(value)
    return (df.select(v.alias(value), F.col(area)).where(F.col(value).isNotNull() & F.col(area).isNotNull())
            .groupBy(value, area).agg(F.count(F.lit(1)).alias(name)))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Null is one value."""
    return df.select(c).distinct()


def distinct_codes(df: DataFrame, cols: Sequence[str], out: str = "diagnostico") -> DataFrame:
    """G2 / E5 core: every comma-split, stripped, non-empty code of the columns, once."""
    cells = F.array(*[col(c).cast("string") for c in cols])
    codes = df.select(F.explode(cells).alias("_cell")).where(F.col("_cell").isNotNull()) \
        .select(F.explode(split_codes_comma("_cell")).alias(out))
    return codes.where(F.col(out) != "").distinct()


def distinct_codes_sorted(df: DataFrame, cols: Sequence[str], out: str = "diagnostico") -> DataFrame:
    """E5: sorted (byte order) distinct codes; a range-partitioned sort."""
    return distinct_codes(df, cols, out).orderBy(out)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """E6."""
    return df.dropDuplicates()


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    """One-row count."""
    return df.agg(F.count(F.lit(1)).alias(name))


def class_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label with share (within `by`). The window runs over the
    aggregated table (one row per label), not over the data."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def collapse_to_list(df: DataFrame, row_key: Sequence[str], pos: str, value: str,
                     out: str, sep: str = ", ", wrap: tuple[str, str] | None = None,
                     drop_empty: bool = True) -> DataFrame:
    """Per row key, values re-joined in `pos` order. Each row key holds a
    bounded list (the codes of one visit), so collecting per key is safe."""
    v = F.col(value)
    if wrap:
        v = F.when(v.isNotNull() & (v != ""), F.concat(F.lit(wrap[0]), v, F.lit(wrap[1])))
    src = df.select(*row_key, F.struct(F.col(pos).alias("p"), v.alias("v")).alias("_pv"))
    if drop_empty:
        src = src.where(F.col("_pv.v").isNotNull() & (F.col("_pv.v") != ""))
    return src.groupBy(*row_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_pv")), lambda x: x["v"]), sep).alias(out))


def first_occurrences(df: DataFrame, row_key: Sequence[str], pos: str, code: str) -> DataFrame:
    """E10 core: dict semantics, a repeated code keeps its first position."""
    return df.groupBy(*row_key, code).agg(F.min(pos).alias(pos))


def mean_abs_by_feature(df: DataFrame, feature: str, value: str, out: str = "importance") -> DataFrame:
    """mean(|value|) per feature, over occurrences."""
    return df.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias(out))


def node_out_degree(nodes: DataFrame, node_key: str, edges: DataFrame, src: str,
                    out: str = "degree") -> DataFrame:
    """Edges per source node; 0 for nodes without edges."""
    deg = edges.groupBy(F.col(src).alias("_s")).agg(F.count(F.lit(1)).alias(out))
    return (nodes.select(node_key).distinct().join(deg, F.col(node_key) == F.col("_s"), "left")
            .select(node_key, F.coalesce(F.col(out), F.lit(0)).alias(out)))


# ------------------------------------------------------------------ F: order

def second_half(df: DataFrame, order: Sequence, pos: str = "pos") -> DataFrame:
    """rows from position floor(n/2) on (0-based), over a total order."""
    ranked = ordered_running(df, order, pos=pos)
    n = ranked.count()  # one scalar to the driver
    return ranked.where(F.col(pos) > n // 2)


def head_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """first n rows of a defined order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def sort_desc(df: DataFrame, c: str, tie: Sequence[str] = ()) -> DataFrame:
    """descending with explicit tie-breakers."""
    return df.orderBy(F.col(c).desc(), *tie)


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """k best rows; give a tie-breaker in `order`."""
    return df.orderBy(*order).limit(k)


def composite_score(f1, recall, w_f1: float = 0.6, w_recall: float = 0.4) -> Column:
    """F6 score."""
    return w_f1 * col(f1) + w_recall * col(recall)


def top_abs_per_row(df: DataFrame, row: str, feature: str, value: str, rank: str = "rank") -> DataFrame:
    """features of each row by |value| desc (sign kept). One row's features
    are a bounded set, so a window partitioned by row is safe."""
    w = Window.partitionBy(row).orderBy(F.abs(F.col(value)).desc(), F.col(feature), F.col(value))
    return df.withColumn(rank, F.row_number().over(w))


def best_per_group(df: DataFrame, group: str, item: str, value: str, out: str = "best") -> DataFrame:
    """F8: per group the item with the largest value; ties to the smallest item
    name. An aggregate (partial + final), not a window."""
    key = F.struct((-F.col(value)).alias("v"), F.col(item).alias("i"))
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(F.col(item), key).alias(out))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """reproducible fixed-size sample: the n smallest md5(seed|id)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(n).drop("_h")


# --------------------------------------------------------------- G: set ops

def union_all(*dfs: DataFrame) -> DataFrame:
    """G1: stack tables by column name, missing columns filled with null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
