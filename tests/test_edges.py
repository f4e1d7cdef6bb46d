"""Null labels and groups, equal rows, headers of several files, odd values in
CSV, near ties, groups of one class, and the split of a hot key in the plan."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from dxspark.functions.scalars import split_codes_comma, strip_text
from dxspark.operators import codes as C
from dxspark.operators import features as J
from dxspark.operators import lookup as L
from dxspark.operators import metrics as K
from dxspark.sources import io

CROSSWALK = [(1, "295.3", "F20", "paranoid"), (2, "V23.1", "Z35", "supervision"), (3, "300", "F41", None)]


def crosswalk(spark):
    return spark.createDataFrame(CROSSWALK, "ord long, icd9 string, icd10 string, description string")


def test_split_cuts_by_brute_force(spark):
    ids = [*range(3000), None, 7, 7]
    df = spark.createDataFrame([(i, None if i is not None and i % 4 == 0 else 1) for i in ids], "id long, label int")
    key = lambda i: "" if i is None else hashlib.md5(f"42|{i}".encode()).hexdigest()

    def expected(rows, share):
        ranked = sorted(map(key, rows))
        n = min(len(ranked), math.ceil(len(ranked) * share))
        return sorted(i if i is not None else -1 for i in rows if n and key(i) <= ranked[n - 1])

    for share in (0.0, 0.001, 0.3, 1.0, 2.0):
        got = J.split_random(df, "id", share).where("split = 'test'").collect()
        assert sorted(r["id"] if r["id"] is not None else -1 for r in got) == expected(ids, share)
        got = J.split_stratified(df, "id", "label", share).where("split = 'test'").collect()
        for y in (None, 1):
            of = [i for i in ids if (i is not None and i % 4 == 0) == (y is None)]
            assert sorted(r["id"] if r["id"] is not None else -1 for r in got if r["label"] == y) == expected(of, share)
    assert J.split_stratified(df.where("id < 0"), "id", "label").count() == J.split_random(df.where("id < 0"), "id").count() == 0
    plan = J.split_stratified(df, "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "NestedLoop" not in plan


def test_null_labels_stay(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(100)], "id long, label int")
    split = J.split_stratified(df, "id", "label").collect()
    assert len(split) == 100
    assert collections.Counter(r["label"] for r in split if r["split"] == "test") == {None: 8, 0: 8, 1: 15}
    assert J.kfold_assign(df, "id", "label").count() == 100
    assert {r["label"]: round(r["weight"], 6) for r in J.class_weights(df, "label").collect()} == {
        None: round(100 / 75, 6), 0: round(100 / 75, 6), 1: round(100 / 150, 6)}


def test_null_group_and_one_class(spark):
    rows = [(None, 1, 1, 0.9), (None, 0, 0, 0.1), ("one", 1, 1, 0.8), ("one", 1, 0, 0.2)]
    s = spark.createDataFrame(rows, "g string, y int, pred int, score double")
    assert {r["g"]: r["auc"] for r in K.roc_auc(s, "g").collect()} == {None: 1.0, "one": None}
    cells = {(r["g"], r["y"], r["pred"]): r["n"] for r in K.confusion_matrix(s, "g").collect()}
    assert cells[None, 1, 1] == cells[None, 0, 0] == cells["one", 1, 0] == 1 and len(cells) == 8
    points = K.roc_curve(s, "g").collect()
    assert len(points) == 6 and all(r["fpr"] is None for r in points if r["g"] == "one" and r["threshold"] < 1)


def test_best_model_on_unrounded_values(spark):
    n = 100_000
    df = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("m"), (F.col("id") % 2).cast("int").alias("y"), "id")
    right = F.col("id") < F.when(F.col("m") == "a", n // 2 + 1).otherwise(n // 2 + 2)
    s = df.withColumn("pred", F.when(right, F.col("y")).otherwise(1 - F.col("y"))).withColumn("score", F.lit(0.5))
    got = {r["metric"]: r for r in K.compare_models(s, "m", ["a", "b"]).collect()}
    assert got["accuracy"]["a"] == got["accuracy"]["b"] and got["accuracy"]["best"] == "b"
    assert got["auc"]["best"] == "a"  # a tie


def test_strip_takes_what_python_takes(spark):
    texts = ["\xa0F20\xa0", "\u3000\u2003 x\ty \x1f", "", " \u2028 ", "\u200bz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip_text("t")).collect()] == [t.strip() for t in texts]
    codes = spark.createDataFrame([("F20,\xa0F22",)], "t string").select(split_codes_comma("t"))
    assert codes.first()[0] == ["F20", "F22"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "x\ny"), (2, ""), (3, None), (4, 'say "hi", | or \\'), (5, " b ")]
    df = spark.createDataFrame(rows, "id long, v string")
    path = io.write_delimited(df, str(tmp_path / "out"), null_mark="\\N")
    back = io.read_delimited(spark, path, "id long, v string", header=True, null_mark="\\N", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    path = io.write_delimited(df, str(tmp_path / "plain"))
    back = io.read_delimited(spark, path, "id long, v string", header=True, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted((i, v or None) for i, v in rows)


def test_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h|k\n1|x\nh|k\n2|y|z\n")
    (tmp_path / "b.txt").write_text("H|K\n3\n\"4|w\n")
    got = io.read_ragged(spark, str(tmp_path), ["p", "q"], header=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "x"), ("h", "k"), ("2", "y"), ("3", None), ('"4', "w")], key=str)


def test_json_map_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"F20": "a",\n "F21": "b"}')
    assert {tuple(r) for r in io.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {("F20", "a"), ("F21", "b")}
    assert io.read_json_map(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        io.read_json_map(spark, "nosuch://x/y")


def test_equal_rows_and_keys_stay_apart(spark):
    rows = [(1, "295.3", "295.3", None), (1, "295.3", "295.3", None), (1, "295.3", None, "295.3"), (None, "", "null", "V23.1"),
            (2, "F20", "295.3", "F41")]
    wide = spark.createDataFrame(rows, "id long, psq string, d1 string, d2 string")
    got = collections.Counter(map(tuple, C.standardise_row_codes(wide, "id", ["d1", "d2"], "psq", crosswalk(spark)).collect()))
    assert got == {(1, "295.3", "F20", None): 2, (1, "295.3", None, "F20"): 1, (None, "", "", "Z35"): 1, (2, "F20", "295.3", "F41"): 1}
    got = collections.Counter(map(tuple, C.describe_codes(wide, "id", ["d1", "d2"], "psq", crosswalk(spark)).collect()))
    assert got == {(1, "No encontrado", None, None): 3, (None, "No encontrado", None, None): 1, (2, "paranoid", None, None): 1}


def test_label_encode_blanks(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "", "x"), (3, None, "y"), (4, "a", "x"), (4, "a", "x")], "id long, c string, d string")
    got = sorted(tuple(r) for r in J.label_encode(df, ["c", "d"]).select("id", "c_idx", "d_idx").collect())
    assert got == [(1, 2, 0), (2, 0, 1), (3, 0, 2), (4, 1, 1), (4, 1, 1)]
    long = sorted(tuple(r) for r in J.label_encode_long(df, ["id"], ["c", "d"]).collect())
    assert long == sorted((i, k, x) for i, c, d in got for k, x in (("c", c), ("d", d)))


def test_one_hot_rows(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (1, "b", 0.5), (2, None, 1.0)], "id long, c string, x double")
    got = J.one_hot(df, ["id"], "c", numeric=["x"])
    assert got.columns == ["id", "x", "a", "b"]
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 0, 1), (1, 2.5, 1, 0), (2, 1.0, 0, 0)]


@pytest.mark.parametrize("lookup", [
    lambda df, cw: L.lookup_first(df, "code", cw, "icd9", ["description"]),
    lambda df, cw: L.membership_flag(df, "code", cw, "icd9"),
    lambda df, cw: C.with_variant(df, "code", C.icd9_to_icd10_index(cw), "to10"),
    lambda df, cw: J.label_encode(df, ["code"]),
    lambda df, cw: J.label_encode_long(df, ["id", "pad"], ["code"])])
def test_hot_key_is_split(spark, lookup):
    hot = spark.range(300_000, numPartitions=8).select("id", F.when(F.col("id") % 3 > 0, "295.3").otherwise(F.col("id").cast("string")).alias("code"),
                                                       F.md5(F.col("id").cast("string")).alias("pad"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = lookup(hot, crosswalk(spark))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
