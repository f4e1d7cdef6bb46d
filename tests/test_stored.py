"""Numbered lines of files, tables that runs merge into, and term vectors."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from dxspark.operators import graph as G
from dxspark.operators import lookup as L
from dxspark.operators import vectors as V
from dxspark.sources import keyed, lines


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "40"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    """Blank lines, lines longer than a split, a file without a last newline, an empty file."""
    rng = random.Random(4)
    files = {}
    for k in range(4):
        text = "\n".join("" if rng.random() < 0.1 else ",".join("f" * rng.randrange(9) for _ in range(rng.randrange(1, 5))) for _ in range(1500))
        files[f"f{k}.txt"] = f"a,b,c\n{text}" + ("x" * 9000 + "\n" if k == 1 else "\n" if k == 2 else "")
    files["empty.txt"] = ""
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = sorted((os.path.basename(r.file), r.line_no, r.line) for r in got.collect())
    want = sorted((name, i, line) for name, text in files.items() for i, line in enumerate(text.splitlines(), 1))
    assert rows == want
    audit = sorted((os.path.basename(r.file), r.line_no, r.n_fields, r.line) for r in lines.audit_ragged_file(spark, str(tmp_path), ",").collect())
    assert audit == [(n, i, len(x.strip().split(",")), x.strip()) for n, i, x in want if len(x.strip().split(",")) != 3]
    kept = lines.read_ragged_numbered(spark, str(tmp_path), ["a", "b"], ",", "skip").collect()
    assert sorted((os.path.basename(r.file), r.line_no) for r in kept) == [(n, i) for n, i, x in want if len(x.split(",")) <= 2]


SCHEMA = "k string, ord int, v string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_merge_and_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.read_keyed(spark, path) is None
    first = [(f"k{i}", i, "first") for i in range(200)] + [(None, 1, "rejected")]
    assert keyed.merge_into(path, spark.createDataFrame(first, SCHEMA), ["k"], "ord") > 50
    second = [("k3", 5, "later"), ("k4", 1, "earlier"), ("k5", 5, "same"), ("new", 0, "new"), ("new", 9, "newest"), ("odd", None, None)]
    assert keyed.merge_into(path, spark.createDataFrame(second, SCHEMA), ["k"], "ord") <= 6
    want = {f"k{i}": (f"k{i}", i, "first") for i in range(200)} | {"k3": ("k3", 5, "later"), "k5": ("k5", 5, "same"), "new": ("new", 9, "newest"), "odd": ("odd", None, None)}
    assert sorted(map(str, rows_of(keyed.read_keyed(spark, path)))) == sorted(map(str, want.values()))
    assert keyed.merge_into(path, spark.createDataFrame([], SCHEMA), ["k"], "ord") == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.merge_into(path, spark.createDataFrame([(f"k{i}", i, "a") for i in range(500)], SCHEMA), ["k"], "ord")
    stamp = {d: os.stat(os.path.join(path, d)).st_mtime_ns for d in os.listdir(path) if d.startswith("_bucket")}
    keyed.merge_into(path, spark.createDataFrame([("k7", 999, "b")], SCHEMA), ["k"], "ord")
    changed = {d for d in stamp if os.stat(os.path.join(path, d)).st_mtime_ns != stamp[d]}
    assert len(changed) == 1
    assert keyed.read_keyed(spark, path).count() == 500


def test_failed_run_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.merge_into(path, spark.createDataFrame([(f"k{i}", i, "a") for i in range(50)], SCHEMA), ["k"], "ord")
    before = rows_of(keyed.read_keyed(spark, path))
    bad = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("ord"),
                                 F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.lit("b")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        keyed.merge_into(path, bad, ["k"], "ord")
    assert rows_of(keyed.read_keyed(spark, path)) == before


def test_graph_over_two_runs(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y")], "term string, ord int, p string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "s string, t string")
    G.store_nodes(path, nodes, "term")
    assert rows_of(G.store_edges(path, edges, "s", "t", "term")) == [("a", "b")]
    got = G.store_nodes(path, spark.createDataFrame([("c", 1, "z"), ("a", 2, "old")], "term string, ord int, p string"), "term")
    assert rows_of(got) == [("a", 3, "y"), ("b", 2, "x"), ("c", 1, "z")]
    assert rows_of(G.store_edges(path, edges, "s", "t", "term")) == [("a", "b"), ("a", "c")]


def test_cache_is_written_back(spark, tmp_path):
    path = str(tmp_path / "c")
    dictionary = spark.createDataFrame([("A1", "one", 1), ("B22", "two", 2)], "icd10 string, description string, ord int")
    codes = spark.createDataFrame([("A1",), ("B2",), ("Z",), (None,)], "code string")
    args = ("icd10", "description", "none", "text")
    first = {r.code: r.text for r in L.lookup_with_stored_cache(codes, "code", path, dictionary, *args).collect()}
    assert first == {"A1": "one", "B2": "two", "Z": "none", None: None}
    assert rows_of(keyed.read_keyed(spark, path)) == [("A1", "one"), ("B2", "two")]
    nothing = dictionary.where("false")
    assert {r.code: r.text for r in L.lookup_with_stored_cache(codes, "code", path, nothing, *args).collect()} == first


def test_term_vectors(spark):
    terms = ["acute kidney failure", "chronic kidney failure", "kidney failures", "broken arm", "broken left arm", "schizophrenia", "", None, "broken arm"]
    got = {r.t: r.vector for r in V.term_vectors(spark.createDataFrame([(t,) for t in terms], "t string"), "t", k=5).collect()}
    assert set(got) == {t for t in terms if t is not None}
    assert all(abs(sum(x * x for x in v) - (1 if t else 0)) < 1e-9 for t, v in got.items())
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    nearest = {t: max((u for u in got if u and u != t), key=lambda u: dot(t, u)) for t in got if t}  # noqa: B023
    assert nearest["acute kidney failure"] in ("chronic kidney failure", "kidney failures")
    assert nearest["broken arm"] == "broken left arm" and nearest["broken left arm"] == "broken arm"
    assert dot("broken arm", "broken left arm") > 0.3 > abs(dot("broken arm", "schizophrenia"))
    assert V.term_vectors(spark.createDataFrame([], "t string"), "t").collect() == []


# ------------------------------------------------------------------ GeoJSON

def collection(rng: random.Random, n: int, loose: bool) -> dict:
    odd = ['}', '{"type": "Feature"}', '\\"', 'a"b', "\\", '"features": [', "ñ}]"]
    features = []
    for k in range(n):
        rings = [[[k, 0], [k + 4, 0], [k + 4, 2], [k, 2], [k, 0]]] + [[[k + 1, 0.5], [k + 2, 0.5], [k + 2, 1.5], [k + 1, 1.5], [k + 1, 0.5]]] * (k % 3 == 0)
        kind = {"type": "Polygon", "coordinates": rings} if k % 2 else {"type": "MultiPolygon", "coordinates": [rings, [[[k, 9], [k + 1, 9], [k + 1, 10], [k, 9]]]]}
        features.append({"type": "Feature", "properties": {"COD_POSTAL": f"{k:05d}", "name": rng.choice(odd) * rng.randrange(1, 40)}, "geometry": kind})
    out = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features}
    return out | ({"links": [{"a": {"b": 1}}], "bbox": [1, 2]} if loose else {})


def test_features_over_many_splits(spark, tmp_path, small_splits):
    """Compact and loose files; braces, quotes and escapes in values; features longer
    than a split; an empty collection."""
    from dxspark.sources import geo

    rng = random.Random(8)
    made = {"a": (collection(rng, 160, True), None), "b": (collection(rng, 90, False), 2), "c": (collection(rng, 0, True), None)}
    made["a"][0]["features"][50]["properties"]["name"] = "long } " * 3000
    for name, (data, indent) in made.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(data, indent=indent, ensure_ascii=name == "b"))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = geo.read_features(spark, str(tmp_path))
    got = sorted((r.cod_postal, r.properties["name"], json.dumps(json.loads(r.geometry))) for r in rows.collect())
    want = sorted((f["properties"]["COD_POSTAL"], f["properties"]["name"], json.dumps(f["geometry"])) for d, _ in made.values() for f in d["features"])
    assert got == want
    p = geo.polygons(F.col("geometry"))
    for r in rows.select("cod_postal", geo.area(p).alias("area"), geo.holes(p).alias("holes"), geo.box(p).alias("box")).collect():
        k = int(r.cod_postal)
        hole = k % 3 == 0
        assert (r.area, r.holes) == (8.0 - hole + (0 if k % 2 else 0.5), int(hole))
        assert tuple(r.box) == (k, 0, k + 4, 2 if k % 2 else 10)


def test_stream_merges_like_runs(spark, tmp_path):
    """Files that arrive one after the other, read in batches; a second start takes
    only what is new, and a repeated batch changes nothing."""
    from dxspark.streaming import merge_stream

    source, path, state = (str(tmp_path / x) for x in ("in", "t", "state"))
    spark.createDataFrame([(f"k{i}", i, "a") for i in range(60)], SCHEMA).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    merge_stream(stream, path, ["k"], "ord", state).awaitTermination(120)
    assert keyed.read_keyed(spark, path).count() == 60
    spark.createDataFrame([("k1", 99, "b"), ("k2", 0, "old"), ("new", 1, "c")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for again in (state, str(tmp_path / "other")):  # a new state reads every file again
        merge_stream(stream, path, ["k"], "ord", again).awaitTermination(120)
        got = {r.k: (r.ord, r.v) for r in keyed.read_keyed(spark, path).collect()}
        assert len(got) == 61 and got["k1"] == (99, "b") and got["k2"] == (2, "a") and got["new"] == (1, "c")
