"""A hot key holding a third of all rows must not change results: the lookup
join-back, exploded counts and first-row reductions are checked against
brute force on such a table (AQE skew-join splitting is on in the session)."""

import collections
import random

from pyspark.sql import functions as F

from dxspark.operators import agg
from dxspark.operators import codes as C
from dxspark.operators.lookup import first_row_per_key
from dxspark.plans.fixtures import fx
from tests.conftest import SF_SMALL


def _hot_table(spark, n=30000):
    rnd = random.Random(3)
    cw = fx(spark, SF_SMALL, "fx_crosswalk").select("icd9").distinct().collect()
    pool = [r["icd9"] for r in cw][:300]
    rows = []
    for i in range(n):
        code = "295.3" if i % 3 == 0 else rnd.choice(pool + ["V23.", "123.4", "X1"])
        rows.append((i, code, "A, " + code if i % 2 else code))
    return spark.createDataFrame(rows, "row_id long, code string, codes string"), rows


def test_skew_settings_are_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_lookup_join_back_with_hot_code(spark):
    df, rows = _hot_table(spark)
    cw = fx(spark, SF_SMALL, "fx_crosswalk")
    out = C.with_variant(df, "code", C.icd9_to_icd10_index(cw), "icd10")
    got = {r["row_id"]: r["icd10"] for r in out.collect()}
    assert len(got) == len(rows)
    per_code = {r["code"]: r["icd10"] for r in
                C.with_variant(df.select("code").distinct(), "code", C.icd9_to_icd10_index(cw), "icd10").collect()}
    assert all(got[i] == per_code[c] for i, c, _ in rows)
    assert sum(1 for _, c, _ in rows if c == "295.3") == len(rows) // 3


def test_exploded_count_with_hot_code(spark):
    df, rows = _hot_table(spark)
    got = {(r["code"]): r["n"] for r in agg.count_exploded(df, [], "codes", out="code", name="n").collect()}
    exp = collections.Counter(c.strip() for _, _, cs in rows for c in cs.split(","))
    assert got == dict(exp)


def test_first_row_with_hot_key(spark):
    df, rows = _hot_table(spark)
    got = {r["code"]: r["row_id"] for r in first_row_per_key(df.withColumnRenamed("row_id", "ord"), "code", [], "ord")
           .select("code", F.col("ord").alias("row_id")).collect()}
    exp = {}
    for i, c, _ in rows:
        exp.setdefault(c, i)
    assert got == exp


def test_composite_join_of_one_partition_uses_all_tasks(spark):
    """Rows that one task reads, and that a join multiplies, are dealt out first."""
    from dxspark.operators.lookup import left_join_composite
    df = spark.range(300).select("id", (F.col("id") % 3).alias("a"), F.lit("k").alias("b")).coalesce(1)
    other = spark.range(200).select((F.col("id") % 2).alias("a"), F.lit("k").alias("b"), F.concat(F.lit("d"), F.col("id")).alias("d"))
    out = left_join_composite(df, ["a", "b"], F.broadcast(other), "d", "none")
    assert out.groupBy("a").count().orderBy("a").collect() == [(0, 10000), (1, 10000), (2, 100)]
    held = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism
