"""Registered queries: sources and sinks (A*). Each writes Spark-derived data
to a fresh folder under the shared checkpoint directory and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import pad_postal, split_codes_comma, upper_text
from dxspark.operators.lookup import not_found_codes
from dxspark.plans.fixtures import fx
from dxspark.plans.registry import query
from dxspark.plans.sql_snippets import STRIP
from dxspark.session import scratch_path
from dxspark.sources import geo, io, lines

CROSSWALK_SCHEMA = "ord bigint, icd9 string, icd10 string, description string"


@query("read_delimited", "SELECT * FROM fx_crosswalk")
def q_read_delimited(spark, sf):
    path = io.write_delimited(fx(spark, sf, "fx_crosswalk"), scratch_path(spark, "crosswalk"), sep="|", header=False)
    return io.read_delimited(spark, path, CROSSWALK_SCHEMA, sep="|", header=False)


@query("read_delimited_usecols", "SELECT ord, icd9 FROM fx_crosswalk")
def q_read_delimited_usecols(spark, sf):
    path = io.write_delimited(fx(spark, sf, "fx_crosswalk"), scratch_path(spark, "crosswalk"), sep=",", header=True)
    return io.read_delimited(spark, path, CROSSWALK_SCHEMA, sep=",", header=True, usecols=["ord", "icd9"])


def _ragged_file(spark, sf) -> str:
    """visit_id | provincia | one field per code of the comma list: rows with
    several codes have more fields, rows without codes fewer."""
    v = fx(spark, sf, "fx_visits")
    line = F.concat_ws("|", F.col("visit_id").cast("string"), F.coalesce("provincia", F.lit("")),
                       F.array_join(split_codes_comma("psq"), "|"))
    return io.write_text_lines(v, line, scratch_path(spark, "ragged"))


RAGGED_SQL = f"""
SELECT CAST(visit_id AS VARCHAR) AS visit_id, nullif(provincia, '') AS provincia,
       nullif(l[1], '') AS code1
FROM (SELECT visit_id, provincia, list_transform(string_split(psq, ','), lambda s: {STRIP.format('s')}) AS l
      FROM fx_visits) t"""


@query("read_ragged", RAGGED_SQL)
def q_read_ragged(spark, sf):
    return io.read_ragged(spark, _ragged_file(spark, sf), ["visit_id", "provincia", "code1"], mode="truncate")


@query("read_ragged_skip", RAGGED_SQL + " WHERE l IS NULL OR len(l) <= 1")
def q_read_ragged_skip(spark, sf):
    return io.read_ragged(spark, _ragged_file(spark, sf), ["visit_id", "provincia", "code1"], mode="skip")


@query("audit_ragged_lines", f"""
WITH d AS (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1)
                                            ELSE text END, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no,
             len(string_split({STRIP.format('l[1]')}, ',')) AS h FROM d),
f AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
             CAST(len(string_split({STRIP.format('line')}, ',')) AS INTEGER) AS n_fields,
             {STRIP.format('line')} AS line, h FROM e)
SELECT doc_id, line_no, n_fields, line FROM f WHERE n_fields <> h""")
def q_audit_ragged_lines(spark, sf):
    return io.audit_ragged_lines(fx(spark, sf, "documents"), "doc_id", "text", sep=",")


@query("audit_ragged_file", f"""
WITH t AS (SELECT visit_id % 8 AS file, row_number() OVER (PARTITION BY visit_id % 8 ORDER BY visit_id) AS line_no,
                  {STRIP.format("CAST(visit_id AS VARCHAR) || ',' || coalesce(psq, '')")} AS line FROM fx_visits),
f AS (SELECT *, CAST(len(string_split(line, ',')) AS INTEGER) AS n_fields FROM t)
SELECT f.file, f.line_no, f.n_fields, f.line FROM f JOIN (SELECT file, n_fields AS h FROM f WHERE line_no = 1) g ON f.file = g.file
WHERE f.n_fields <> g.h""")
def q_audit_ragged_file(spark, sf):
    """Eight files, each in the order of its visits, audited by their own line numbers."""
    path = scratch_path(spark, "ragged_files")
    v = fx(spark, sf, "fx_visits").select((F.col("visit_id") % 8).alias("file"), "visit_id",
                                          F.concat(F.col("visit_id").cast("string"), F.lit(","), F.coalesce("psq", F.lit(""))).alias("value"))
    v.repartition("file").sortWithinPartitions("file", "visit_id").select("file", "value").write.partitionBy("file").text(path)
    out = lines.audit_ragged_file(spark, path, ",")
    return out.select(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("bigint").alias("file"), "line_no", "n_fields", "line")


@query("write_delimited", "SELECT * FROM fx_pairs")
def q_write_delimited(spark, sf):
    path = io.write_delimited(fx(spark, sf, "fx_pairs"), scratch_path(spark, "pairs"), sep="|", header=True)
    return io.read_delimited(spark, path, "nombre_diagnostico string, nombre_diagnostico_psiquiatrico string",
                             sep="|", header=True)


@query("write_partitioned_by_value", """
SELECT upper(provincia) AS provincia,
       CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal,
       count(*) AS frecuencia
FROM fx_visits WHERE provincia IS NOT NULL GROUP BY 1, 2""")
def q_write_partitioned_by_value(spark, sf):
    v = fx(spark, sf, "fx_visits")
    counts = v.groupBy(upper_text("provincia").alias("provincia"), pad_postal("cod_postal").alias("cod_postal")) \
        .agg(F.count(F.lit(1)).alias("frecuencia"))
    path = io.write_partitioned_by_value(counts, scratch_path(spark, "by_province"), "provincia")
    back = io.read_partitioned(spark, path, io.StructType.fromDDL(
        "cod_postal string, frecuencia bigint, provincia string"))
    return back.select("provincia", "cod_postal", "frecuencia")


@query("read_json_map", """
SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) t""")
def q_read_json_map(spark, sf):
    return io.json_map_entries(fx(spark, sf, "events"), "props", keep=["event_id"])


@query("read_param_table", """
SELECT model AS dataset, 'run_' || CAST(run_id AS VARCHAR) AS model, 'f1' AS param, CAST(f1 AS VARCHAR) AS value FROM fx_grid
UNION ALL
SELECT model, 'run_' || CAST(run_id AS VARCHAR), 'recall', CAST(recall AS VARCHAR) FROM fx_grid""")
def q_read_param_table(spark, sf):
    g = fx(spark, sf, "fx_grid")
    params = F.create_map(F.lit("f1"), F.col("f1").cast("string"), F.lit("recall"), F.col("recall").cast("string"))
    doc = F.to_json(F.create_map(F.col("model"), F.create_map(F.concat(F.lit("run_"), F.col("run_id").cast("string")),
                                                              params)))
    path = io.write_text_lines(g, doc, scratch_path(spark, "params"))
    return io.read_param_table(spark, path)


@query("read_geo_features", "SELECT cod_postal, name FROM fx_areas")
def q_read_geo_features(spark, sf):
    a = fx(spark, sf, "fx_areas")
    # a file with one FeatureCollection for each thousand areas
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(F.col("cod_postal").alias("COD_POSTAL"), F.col("name")).alias("properties"),
                       F.struct(F.lit("Point").alias("type"),
                                F.array(F.col("ord").cast("double"), F.col("ord").cast("double")).alias("coordinates"))
                       .alias("geometry"))
    fc = a.groupBy(F.floor(F.col("ord") / 1000).alias("doc")).agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    path = scratch_path(spark, "geo")
    fc.write.partitionBy("doc").text(path)
    g = io.read_geo_features(spark, path)
    return g.select("cod_postal", F.col("properties.name").alias("name"))


@query("read_geo_polygons", """
SELECT cod_postal, name, CASE WHEN ord % 3 = 0 THEN 7.0 ELSE 8.0 END::DOUBLE AS area, CAST(CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS holes,
       CAST(ord AS DOUBLE) AS west, 0.0::DOUBLE AS south, CAST(ord + 4 AS DOUBLE) AS east, 2.0::DOUBLE AS north
FROM fx_areas""")
def q_read_geo_polygons(spark, sf):
    """A8 over files that are cut into splits, with the areas' outlines: a rectangle
    each, every third with a hole."""
    a = fx(spark, sf, "fx_areas")
    x = F.col("ord").cast("double")
    ring = lambda *points: F.array(*[F.array(x + dx, F.lit(y)) for dx, y in points])
    border = ring((0, 0.0), (4, 0.0), (4, 2.0), (0, 2.0), (0, 0.0))
    hole = ring((1, 0.5), (2, 0.5), (2, 1.5), (1, 1.5), (1, 0.5))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("cod_postal").alias("COD_POSTAL"), "name").alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), F.when(F.col("ord") % 3 == 0, F.array(border, hole)).otherwise(F.array(border)).alias("coordinates"))
                       .alias("geometry"))
    fc = a.groupBy(F.floor(F.col("ord") / 1000).alias("doc")).agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    path = scratch_path(spark, "geo")
    fc.write.partitionBy("doc").text(path)
    p = geo.polygons(F.col("geometry"))
    return geo.read_features(spark, path).select("cod_postal", F.col("properties")["name"].alias("name"), geo.area(p).alias("area"),
                                                 geo.holes(p).alias("holes"), geo.box(p).alias("box")).select("cod_postal", "name", "area", "holes", "box.*")


@query("export_rejects", """
SELECT DISTINCT code AS codigo_perdido FROM fx_diag_long d
WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_crosswalk c WHERE c.icd10 = d.code)""")
def q_export_rejects(spark, sf):
    rejects = not_found_codes(fx(spark, sf, "fx_diag_long"), "code", fx(spark, sf, "fx_crosswalk"), "icd10") \
        .withColumnRenamed("code", "codigo_perdido")
    path = io.export_rejects(rejects, scratch_path(spark, "rejects"))
    return io.read_delimited(spark, path, "codigo_perdido string", sep="|", header=True)
