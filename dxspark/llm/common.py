"""Helpers shared by the text-corpus operators.

Everything here is general: the word pattern, scratch tables in the shared
folder, and connected components as DataFrame joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.session import scratch_path

#: what separates words: space, tab, newline, vertical tab, form feed, return
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    """How many words a text has (null: none), without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage: what follows does not recompute `df`, survives a lost
    executor, and shares no partitioning with it, so that joins on the result
    get an exchange on both sides and AQE can split a skewed key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    edges: columns `a`, `b` (bigint, not null, any direction, repeats and loops
    allowed). Returns (`node`, `root`). Alternates large-star and small-star
    steps over joins; each round is written to the shared folder, and the loop
    ends when the set of edges no longer changes. Raises if `max_rounds` is not
    enough (the number of rounds grows with the logarithm of the nodes).
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = stored(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"components: not stable after {max_rounds} rounds")
