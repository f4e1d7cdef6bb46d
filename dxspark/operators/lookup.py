"""Joins and dictionary lookups (inventory D1-D12, F1).

Dictionary sides are never broadcast by hint: their size grows with the data
here, so the choice is left to Spark, which broadcasts a side only when its
(planned or, under AQE, measured) size is below
`spark.sql.autoBroadcastJoinThreshold` and otherwise shuffles both sides,
splitting skewed partitions (`spark.sql.adaptive.skewJoin.enabled`).
Lookups first reduce the probe side to distinct codes, so a hot code costs one
row in the lookup join. Where the result is joined back to all rows, its key is
made anew (`rekeyed`): without that the aggregation's partitioning is reused,
no exchange lies on that side, and AQE cannot split a hot (or null) key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxspark.functions.scalars import col
from dxspark.session import to_all_tasks
from dxspark.sources.keyed import merge_into, read_keyed


def first_row_per_key(df: DataFrame, key: str, cols: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """F1 / D4 dictionary side: the row with the smallest `ord` per key.
    `min_by` aggregates partially before the shuffle, so a hot key is cheap."""
    packed = F.min_by(F.struct(*[F.col(c) for c in cols], F.col(ord_col).alias("_ord")), F.col(ord_col))
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols], F.col("_r._ord").alias(ord_col)))


def rekeyed(df: DataFrame, key: str, out: str) -> DataFrame:
    """`df` with the text column `key` as `out`, an expression over it, so that a
    join on `out` exchanges both sides and AQE's skew rule applies."""
    new = F.concat(F.col(key), F.lit("")).alias(out)
    return df.select(new, *[c for c in df.columns if c != key])


def lookup_first(df: DataFrame, code: str, dictionary: DataFrame, key: str,
                 values: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """Exact lookup, first dictionary row in `ord` order wins."""
    first = first_row_per_key(dictionary, key, values, ord_col).drop(ord_col)
    return df.join(rekeyed(first, key, "_key"), F.col(code) == F.col("_key"), "left").drop("_key")


def variant_stems(key) -> Column:
    """D5 index: the probe codes under which a dictionary key is found, with the
    probe's priority. A probe code X (no dot) tries X, X., X.0..X.9, X.00..X.99;
    a dotted code C tries C, C0..C9, C00..C99; the first hit wins. Inverting that
    gives at most five (stem, priority) pairs per key."""
    k = col(key)
    n = F.length(k)
    last1 = F.substring(k, -1, 1)
    last2 = F.substring(k, -2, 2)
    opts = [
        F.struct(k.alias("stem"), F.lit(0).alias("pri")),
        F.when(k.rlike(r"^[^.]*\.$"),
               F.struct(k.substr(F.lit(1), n - 1).alias("stem"), F.lit(1).alias("pri"))),
        F.when(k.rlike(r"^[^.]*\.[0-9]$"),
               F.struct(k.substr(F.lit(1), n - 2).alias("stem"), (F.lit(2) + last1.cast("int")).alias("pri"))),
        F.when(k.rlike(r"^[^.]*\.[0-9][0-9]$"),
               F.struct(k.substr(F.lit(1), n - 3).alias("stem"), (F.lit(12) + last2.cast("int")).alias("pri"))),
        F.when(k.rlike(r"(?s)^.*\..*[0-9]$"),
               F.struct(k.substr(F.lit(1), n - 1).alias("stem"), (F.lit(2) + last1.cast("int")).alias("pri"))),
        F.when(k.rlike(r"(?s)^.*\..*[0-9][0-9]$"),
               F.struct(k.substr(F.lit(1), n - 2).alias("stem"), (F.lit(12) + last2.cast("int")).alias("pri"))),
    ]
    return F.filter(F.array(*opts), lambda x: x.isNotNull())


def variant_index(dictionary: DataFrame, key: str, value: str, ord_col: str = "ord",
                  guard: Column | None = None) -> DataFrame:
    """(stem, pri, value) for the first row of every key that passes `guard`."""
    first = first_row_per_key(dictionary, key, [value] if value != key else [], ord_col)
    if value == key:
        first = first.withColumn("_v", F.col(key))
        value_col = "_v"
    else:
        value_col = value
    if guard is not None:
        first = first.where(guard)
    return first.select(F.col(value_col).alias("value"), F.explode(variant_stems(key)).alias("_s")) \
        .select(F.col("_s.stem").alias("stem"), F.col("_s.pri").alias("pri"), "value")


def resolve_variants(codes: DataFrame, code: str, index: DataFrame) -> DataFrame:
    """D5 core: distinct codes -> (code, value, pri) of the best hit (misses absent)."""
    distinct = codes.select(F.col(code).alias("_code")).where(F.col("_code").isNotNull()).distinct()
    return (distinct.join(index, F.col("_code") == F.col("stem"))
            .groupBy("_code").agg(F.min_by(F.struct("value", "pri"), F.col("pri")).alias("_h"))
            .select(F.col("_code"), F.col("_h.value").alias("_value"), F.col("_h.pri").alias("_pri")))


def lookup_with_variants(df: DataFrame, code: str, dictionary: DataFrame, key: str, value: str,
                         out: str, ord_col: str = "ord", guard: Column | None = None) -> DataFrame:
    """Attach `out` = value of the exact key or of the first variant; null on a miss."""
    hits = resolve_variants(df, code, variant_index(dictionary, key, value, ord_col, guard))
    return (df.join(rekeyed(hits, "_code", "_key"), F.col(code) == F.col("_key"), "left")
            .drop("_key", "_pri").withColumnRenamed("_value", out))


def not_found_codes(codes: DataFrame, code: str, found: DataFrame, found_key: str,
                    distinct: bool = True) -> DataFrame:
    """Codes that no lookup resolved (left anti join)."""
    out = codes.select(code).where(F.col(code).isNotNull()) \
        .join(found.select(F.col(found_key).alias("_k")), F.col(code) == F.col("_k"), "left_anti")
    return out.distinct() if distinct else out


def membership_flag(df: DataFrame, code: str, members: DataFrame, member_key: str,
                    flag: str = "is_member") -> DataFrame:
    """Boolean flag, is `code` among `members[member_key]`."""
    m = members.select(F.col(member_key).alias("_m")).where(F.col("_m").isNotNull()).distinct()
    return (df.join(rekeyed(m, "_m", "_m"), F.col(code) == F.col("_m"), "left")
            .withColumn(flag, F.col("_m").isNotNull()).drop("_m"))


def left_join_attach_column(df: DataFrame, key: str, other: DataFrame, other_key: str,
                            attach: str, default: str = "NN", null_safe: bool = True) -> DataFrame:
    """Attach one column by key (duplicates on the right multiply rows),
    default for misses, attached column first. pandas-style null-safe match."""
    right = other.select(F.col(other_key).alias("_k"), F.col(attach).alias("_a"))
    cond = F.col(key).eqNullSafe(F.col("_k")) if null_safe else F.col(key) == F.col("_k")
    out = df.join(right, cond, "left").withColumn(attach, F.coalesce(F.col("_a"), F.lit(default)))
    return out.select(attach, *df.columns)


def left_join_composite(df: DataFrame, keys: Sequence[str], other: DataFrame, value: str,
                        default: str) -> DataFrame:
    """Left join on several keys (nulls do not match) + default text. A key that
    stands often on both sides multiplies rows: with a broadcast side the join is
    done where `df` is read, so `df` is dealt to all tasks first."""
    right = other.select(*keys, value)
    return to_all_tasks(df).join(right, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def left_join_twice(pairs: DataFrame, a: str, b: str, dictionary: DataFrame, key: str,
                    name: str, out_a: str, out_b: str) -> DataFrame:
    """D3: name both ends of a pair from one dictionary (fan-out kept)."""
    da = dictionary.select(F.col(key).alias("_ka"), F.col(name).alias(out_a))
    db = dictionary.select(F.col(key).alias("_kb"), F.col(name).alias(out_b))
    return (pairs.join(da, F.col(a) == F.col("_ka"), "left")
            .join(db, F.col(b) == F.col("_kb"), "left").drop("_ka", "_kb"))


def zip_join_rows(left: DataFrame, right: DataFrame, row_key: str, suffix: str = "_r") -> DataFrame:
    """Cell-by-cell combination of two tables by an explicit row key."""
    r = right.select(row_key, *[F.col(c).alias(c + suffix) for c in right.columns if c != row_key])
    return left.join(r, row_key, "inner")


def prefix_index(dictionary: DataFrame, key: str, value: str, ord_col: str = "ord") -> DataFrame:
    """(prefix, value) of the first dictionary row (by `ord`) whose key starts
    with `prefix`; one row per key prefix (keys are short codes, <= len(key) rows each)."""
    k = F.col(key)
    exploded = dictionary.where(k.isNotNull() & F.col(value).isNotNull()).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: k.substr(F.lit(1), i))).alias("prefix"),
        F.col(value), F.col(ord_col))
    return exploded.groupBy("prefix").agg(F.min_by(F.col(value), F.col(ord_col)).alias(value))


def lookup_with_cache_default(codes: DataFrame, code: str, cache: DataFrame, cache_key: str,
                              cache_text: str, dictionary: DataFrame, key: str, text: str,
                              default: str, out: str, ord_col: str = "ord") -> DataFrame:
    """Cache text, else the first exact dictionary hit, else the first key
    starting with the code, else `default`. Null texts never count as hits."""
    distinct = codes.select(F.col(code).alias("_c")).where(F.col("_c").isNotNull()).distinct()
    c = cache.groupBy(F.col(cache_key).alias("_c")).agg(F.min(cache_text).alias("_cache"))  # of repeated keys the first text
    exact = first_row_per_key(dictionary.where(F.col(text).isNotNull()), key, [text], ord_col) \
        .select(F.col(key).alias("_c"), F.col(text).alias("_exact"))
    pref = prefix_index(dictionary, key, text, ord_col).select(F.col("prefix").alias("_c"), F.col(text).alias("_any"))
    resolved = (distinct.join(c, "_c", "left").join(exact, "_c", "left").join(pref, "_c", "left")
                .select("_c", F.coalesce("_cache", "_exact", "_any", F.lit(default)).alias(out)))
    return codes.join(rekeyed(resolved, "_c", "_key"), F.col(code) == F.col("_key"), "left").drop("_key")


def lookup_with_stored_cache(codes: DataFrame, code: str, path: str, dictionary: DataFrame, key: str, text: str,
                             default: str, out: str, ord_col: str = "ord") -> DataFrame:
    """D9 with its cache at `path`: texts that were found anew are written back, so
    that a later run has them without the dictionary. Defaults are not cached."""
    spark = codes.sparkSession
    cache = read_keyed(spark, path)
    cache = cache if cache is not None else spark.createDataFrame([], "code string, text string")
    found = lookup_with_cache_default(codes, code, cache, "code", "text", dictionary, key, text, default, out, ord_col).checkpoint()
    new = found.select(F.col(code).alias("code"), F.col(out).alias("text")).where(F.col("code").isNotNull() & (F.col("text") != default)).distinct()
    merge_into(path, new.join(cache.select("code"), "code", "left_anti"), ["code"])
    return found


def edge_endpoint_join(edges: DataFrame, src: str, dst: str, nodes: DataFrame, node_key: str) -> DataFrame:
    """An edge survives only when both end nodes exist (names matching
    several nodes fan out)."""
    ns = nodes.select(F.col(node_key).alias("_ns"))
    nd = nodes.select(F.col(node_key).alias("_nd"))
    return (edges.join(ns, F.col(src) == F.col("_ns"))
            .join(nd, F.col(dst) == F.col("_nd")).drop("_ns", "_nd"))


def geo_left_join(features: DataFrame, feature_key: str, counts: DataFrame, count_key: str) -> DataFrame:
    """Every polygon with its count or null (null = no data, not 0)."""
    c = counts.withColumnRenamed(count_key, "_ck")
    return features.join(c, F.col(feature_key) == F.col("_ck"), "left").drop("_ck")


def neighbour_join(nodes: DataFrame, node_key: str, edges: DataFrame, src: str, dst: str,
                   out_src: str = "term", out_dst: str = "neighbour") -> DataFrame:
    """Targets of the edges leaving each node (directed), both ends existing."""
    n1 = nodes.select(F.col(node_key).alias(out_src))
    n2 = nodes.select(F.col(node_key).alias("_n2"))
    return (n1.join(edges, F.col(out_src) == F.col(src))
            .join(n2, F.col(dst) == F.col("_n2"))
            .select(out_src, F.col(dst).alias(out_dst)))
