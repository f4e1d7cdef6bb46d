"""Registered queries: graph (M*) and geography (N*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import NATIONAL_SCALE, PROVINCE_SCALE, bin_frequency_sql, pad_postal, split_codes_comma
from dxspark.operators import graph as G
from dxspark.plans import sql_snippets as Q
from dxspark.plans.fixtures import fx
from dxspark.plans.registry import query
from dxspark.session import scratch_path

NODES_SQL = """(SELECT term, icd10, icd9, embedding_text, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord DESC) AS rn_ FROM fx_nodes WHERE term IS NOT NULL) n
  WHERE rn_ = 1)"""
EDGES_SQL = f"""(SELECT DISTINCT p.nombre_diagnostico AS source, p.nombre_diagnostico_psiquiatrico AS target
  FROM fx_pairs p JOIN {NODES_SQL} a ON p.nombre_diagnostico = a.term
  JOIN {NODES_SQL} b ON p.nombre_diagnostico_psiquiatrico = b.term)"""


def _nodes(spark, sf):
    return G.upsert_nodes(None, fx(spark, sf, "fx_nodes"), "term")


def _edges(spark, sf):
    return G.merge_edges(fx(spark, sf, "fx_pairs"), "nombre_diagnostico", "nombre_diagnostico_psiquiatrico",
                         _nodes(spark, sf), "term")


@query("upsert_nodes", f"SELECT * FROM {NODES_SQL} n")
def q_upsert_nodes(spark, sf):
    return _nodes(spark, sf)


@query("merge_edges", f"SELECT * FROM {EDGES_SQL} e")
def q_merge_edges(spark, sf):
    return _edges(spark, sf)


def _stored_graph(spark, sf):
    """A stored graph after two runs: odd rows and pairs first, then all of them."""
    path = scratch_path(spark, "graph")
    nodes, pairs = fx(spark, sf, "fx_nodes"), fx(spark, sf, "fx_pairs")
    ends = ("nombre_diagnostico", "nombre_diagnostico_psiquiatrico", "term")
    G.store_nodes(path, nodes.where("ord % 2 = 1"), "term")
    G.store_edges(path, pairs.where(F.length("nombre_diagnostico") % 2 == 1), *ends)
    return G.store_nodes(path, nodes.where("ord % 2 = 0"), "term"), G.store_edges(path, pairs, *ends)


@query("store_nodes", f"SELECT * FROM {NODES_SQL} n")
def q_store_nodes(spark, sf):
    return _stored_graph(spark, sf)[0]


@query("store_edges", f"SELECT * FROM {EDGES_SQL} e")
def q_store_edges(spark, sf):
    return _stored_graph(spark, sf)[1]


@query("node_table", f"""
SELECT term, icd10, icd9, ord, CAST(CAST(embedding_text AS FLOAT[])[1] AS DOUBLE) AS emb0,
       CAST(CAST(embedding_text AS FLOAT[])[2] AS DOUBLE) AS emb1 FROM {NODES_SQL} n""")
def q_node_table(spark, sf):
    t = G.node_table(_nodes(spark, sf))
    return t.select("term", "icd10", "icd9", "ord", F.col("embedding")[0].cast("double").alias("emb0"),
                    F.col("embedding")[1].cast("double").alias("emb1"))


@query("edge_table", f"SELECT * FROM {EDGES_SQL} e")
def q_edge_table(spark, sf):
    path = scratch_path(spark, "edges")
    _edges(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@query("node_count", f"SELECT count(*) AS n FROM {NODES_SQL} n")
def q_node_count(spark, sf):
    return G.node_count(_nodes(spark, sf))


@query("find_node", f"SELECT * FROM {NODES_SQL} n WHERE term = 'D13'")
def q_find_node(spark, sf):
    return G.find_node(_nodes(spark, sf), "term", "D13")


@query("node_degree", f"""
SELECT n.term, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM {NODES_SQL} n
LEFT JOIN (SELECT source, count(*) AS degree FROM {EDGES_SQL} e GROUP BY source) d ON n.term = d.source""")
def q_node_degree(spark, sf):
    return G.node_degree(_nodes(spark, sf), "term", _edges(spark, sf))


@query("node_neighbours", f"""
SELECT a.term, e.target AS neighbour FROM {NODES_SQL} a JOIN {EDGES_SQL} e ON a.term = e.source
JOIN {NODES_SQL} b ON e.target = b.term""")
def q_node_neighbours(spark, sf):
    return G.node_neighbours(_nodes(spark, sf), "term", _edges(spark, sf))


@query("delete_nodes_detach", f"""
SELECT e.* FROM {EDGES_SQL} e
WHERE e.source NOT IN (SELECT term FROM {NODES_SQL} n WHERE icd9 = 'NN')
  AND e.target NOT IN (SELECT term FROM {NODES_SQL} n WHERE icd9 = 'NN')""")
def q_delete_nodes_detach(spark, sf):
    _, edges = G.delete_nodes_detach(_nodes(spark, sf), "term", _edges(spark, sf), F.col("icd9") == "NN")
    return edges


@query("delete_nodes_detach_nodes", f"SELECT * FROM {NODES_SQL} n WHERE icd9 <> 'NN' OR icd9 IS NULL")
def q_delete_nodes_detach_nodes(spark, sf):
    nodes, _ = G.delete_nodes_detach(_nodes(spark, sf), "term", _edges(spark, sf), F.col("icd9") == "NN")
    return nodes


# ------------------------------------------------------------------ geography

PAD = "CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END"


@query("area_density", f"""
SELECT a.ord, a.cod_postal, a.name, c.frecuencia, {bin_frequency_sql('c.frecuencia', NATIONAL_SCALE)} AS clase
FROM fx_areas a LEFT JOIN (SELECT {PAD} AS cp, count(*) AS frecuencia FROM fx_visits GROUP BY 1) c
ON a.cod_postal = c.cp""")
def q_area_density(spark, sf):
    counts = fx(spark, sf, "fx_visits").groupBy(pad_postal("cod_postal").alias("cp")) \
        .agg(F.count(F.lit(1)).alias("frecuencia"))
    return G.area_density(fx(spark, sf, "fx_areas"), "cod_postal", counts, "cp", "frecuencia")


@query("area_density_by_code", f"""
WITH r AS (SELECT visit_id, unnest({Q.split_comma('psq')}) AS code, {PAD} AS cp FROM fx_visits),
c AS (SELECT code, cp, count(*) AS frecuencia FROM r WHERE code IS NOT NULL AND cp IS NOT NULL GROUP BY 1, 2),
f AS (SELECT code, CAST((row_number() OVER (ORDER BY min(visit_id), code) - 1) % 8 AS INTEGER) AS color_index
      FROM r GROUP BY code)
SELECT c.code, c.frecuencia, a.ord, a.cod_postal, a.name, f.color_index,
       {bin_frequency_sql('c.frecuencia', PROVINCE_SCALE)} AS clase
FROM c JOIN fx_areas a ON c.cp = a.cod_postal JOIN f ON c.code = f.code""")
def q_area_density_by_code(spark, sf):
    v = fx(spark, sf, "fx_visits")
    rows = v.select("visit_id", F.explode(split_codes_comma("psq")).alias("code"), pad_postal("cod_postal").alias("cp"))
    return G.area_density_by_code(rows, "code", "cp", "visit_id", fx(spark, sf, "fx_areas"), "cod_postal")
