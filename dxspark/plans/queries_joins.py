"""Registered queries: joins and lookups (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import pad_postal
from dxspark.operators import lookup as L
from dxspark.operators.codes import (NO_ENGLISH_TEXT, description_index, icd9_to_icd10_index,
                                     icd10_to_icd9_index, letter_icd9_codes, with_variant)
from dxspark.operators.reshape import DEFAULT_DESCRIPTION, keep_complete_pairs
from dxspark.plans import sql_snippets as Q
from dxspark.plans.fixtures import fx
from dxspark.plans.registry import query
from dxspark.session import scratch_path
from dxspark.sources.keyed import merge_into

DIAG_CODES = "SELECT code FROM fx_diag_long"


@query("left_join_attach_column", """
SELECT coalesce(c.icd9, 'NN') AS icd9, d.visit_id, d.pos, d.code
FROM fx_diag_long d LEFT JOIN fx_crosswalk c ON d.code IS NOT DISTINCT FROM c.icd10""")
def q_left_join_attach_column(spark, sf):
    return L.left_join_attach_column(fx(spark, sf, "fx_diag_long"), "code", fx(spark, sf, "fx_crosswalk"),
                                     "icd10", "icd9", default="NN")


@query("left_join_composite", """
SELECT l.ord, l.icd9, l.icd10, coalesce(r.description, 'Diagnostico no disponible') AS description
FROM fx_crosswalk l LEFT JOIN fx_crosswalk r ON l.icd9 = r.icd9 AND l.icd10 = r.icd10""")
def q_left_join_composite(spark, sf):
    cw = fx(spark, sf, "fx_crosswalk")
    return L.left_join_composite(cw.select("ord", "icd9", "icd10"), ["icd9", "icd10"], cw, "description",
                                 DEFAULT_DESCRIPTION)


TWICE_SQL = """
SELECT a.description AS nombre_diagnostico, b.description AS nombre_diagnostico_psiquiatrico
FROM fx_pairs p
LEFT JOIN fx_crosswalk a ON p.nombre_diagnostico = a.icd10
LEFT JOIN fx_crosswalk b ON p.nombre_diagnostico_psiquiatrico = b.icd10"""


def _twice(spark, sf):
    named = L.left_join_twice(fx(spark, sf, "fx_pairs"), "nombre_diagnostico", "nombre_diagnostico_psiquiatrico",
                              fx(spark, sf, "fx_crosswalk"), "icd10", "description", "_a", "_b")
    return named.select(F.col("_a").alias("nombre_diagnostico"), F.col("_b").alias("nombre_diagnostico_psiquiatrico"))


query("left_join_twice", TWICE_SQL)(_twice)


@query("keep_complete_pairs", f"""
SELECT * FROM ({TWICE_SQL}) t
WHERE nombre_diagnostico IS NOT NULL AND nombre_diagnostico <> ''
  AND nombre_diagnostico_psiquiatrico IS NOT NULL AND nombre_diagnostico_psiquiatrico <> ''""")
def q_keep_complete_pairs(spark, sf):
    return keep_complete_pairs(_twice(spark, sf), "nombre_diagnostico", "nombre_diagnostico_psiquiatrico")


@query("lookup_first", f"""
SELECT d.visit_id, d.pos, d.code, c.description, c.icd9
FROM fx_diag_long d LEFT JOIN {Q.first_rows('icd10')} c ON d.code = c.icd10""")
def q_lookup_first(spark, sf):
    return L.lookup_first(fx(spark, sf, "fx_diag_long"), "code", fx(spark, sf, "fx_crosswalk"), "icd10",
                          ["description", "icd9"])


def _distinct_codes(spark, sf):
    return fx(spark, sf, "fx_diag_long").select("code").where(F.col("code").isNotNull()).distinct()


@query("lookup_with_variants", f"""
SELECT c.code, h.value AS icd10 FROM (SELECT DISTINCT code FROM fx_diag_long WHERE code IS NOT NULL) c
LEFT JOIN {Q.probe_9_to_10(DIAG_CODES)} h ON c.code = h.code""")
def q_lookup_with_variants(spark, sf):
    return with_variant(_distinct_codes(spark, sf), "code", icd9_to_icd10_index(fx(spark, sf, "fx_crosswalk")), "icd10")


@query("lookup_with_variants_icd10_to_icd9", f"""
SELECT c.code, h.value AS icd9 FROM (SELECT DISTINCT code FROM fx_diag_long WHERE code IS NOT NULL) c
LEFT JOIN {Q.probe_10_to_9(DIAG_CODES)} h ON c.code = h.code""")
def q_lookup_with_variants_10_9(spark, sf):
    return with_variant(_distinct_codes(spark, sf), "code", icd10_to_icd9_index(fx(spark, sf, "fx_crosswalk")), "icd9")


@query("lookup_with_variants_description", f"""
SELECT c.code, h.value AS description FROM (SELECT DISTINCT code FROM fx_diag_long WHERE code IS NOT NULL) c
LEFT JOIN {Q.probe_desc(DIAG_CODES)} h ON c.code = h.code""")
def q_lookup_with_variants_desc(spark, sf):
    return with_variant(_distinct_codes(spark, sf), "code", description_index(fx(spark, sf, "fx_crosswalk")),
                        "description")


@query("not_found_codes", """
SELECT DISTINCT code FROM fx_diag_long d
WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_crosswalk c WHERE c.icd10 = d.code)""")
def q_not_found_codes(spark, sf):
    return L.not_found_codes(fx(spark, sf, "fx_diag_long"), "code", fx(spark, sf, "fx_crosswalk"), "icd10")


@query("membership_flag", f"""
SELECT d.visit_id, d.pos, d.code, l.icd9 IS NOT NULL AS is_letter_icd9
FROM fx_diag_long d LEFT JOIN {Q.LETTER_ICD9} l ON d.code = l.icd9""")
def q_membership_flag(spark, sf):
    letters = letter_icd9_codes(fx(spark, sf, "fx_crosswalk"))
    return L.membership_flag(fx(spark, sf, "fx_diag_long"), "code", letters, "icd9", "is_letter_icd9")


@query("zip_join_rows", """
SELECT v.visit_id, v.psq, v.provincia, w.psq AS psq_r, w.diag_01 AS diag_01_r, w.diag_02 AS diag_02_r
FROM fx_visits v JOIN fx_diag_wide w ON v.visit_id = w.visit_id""")
def q_zip_join_rows(spark, sf):
    v = fx(spark, sf, "fx_visits").select("visit_id", "psq", "provincia")
    w = fx(spark, sf, "fx_diag_wide").select("visit_id", "psq", "diag_01", "diag_02")
    return L.zip_join_rows(v, w, "visit_id")


@query("lookup_with_cache_default", f"""
SELECT c.code, e.en AS text FROM (SELECT DISTINCT code FROM fx_diag_long WHERE code IS NOT NULL) c
LEFT JOIN {Q.english(DIAG_CODES)} e ON c.code = e.code""")
def q_lookup_with_cache_default(spark, sf):
    return L.lookup_with_cache_default(_distinct_codes(spark, sf), "code", fx(spark, sf, "fx_cache"), "code", "text",
                                       fx(spark, sf, "fx_crosswalk"), "icd10", "description", NO_ENGLISH_TEXT, "text")


@query("lookup_with_stored_cache", f"""
SELECT c.code, e.en AS text FROM (SELECT DISTINCT code FROM fx_diag_long WHERE code IS NOT NULL) c
LEFT JOIN {Q.english(DIAG_CODES)} e ON c.code = e.code""")
def q_lookup_with_stored_cache(spark, sf):
    """A first run over some codes writes what it found back; a second has those from there."""
    path = scratch_path(spark, "cache")
    merge_into(path, fx(spark, sf, "fx_cache").select("code", "text"), ["code"])
    codes, dictionary = _distinct_codes(spark, sf), fx(spark, sf, "fx_crosswalk")
    args = (path, dictionary, "icd10", "description", NO_ENGLISH_TEXT, "text")
    L.lookup_with_stored_cache(codes.where(F.length("code") % 2 == 0), "code", *args)
    return L.lookup_with_stored_cache(codes, "code", *args)


@query("edge_endpoint_join", """
SELECT p.nombre_diagnostico, p.nombre_diagnostico_psiquiatrico
FROM fx_pairs p JOIN fx_nodes a ON p.nombre_diagnostico = a.term
JOIN fx_nodes b ON p.nombre_diagnostico_psiquiatrico = b.term""")
def q_edge_endpoint_join(spark, sf):
    return L.edge_endpoint_join(fx(spark, sf, "fx_pairs"), "nombre_diagnostico", "nombre_diagnostico_psiquiatrico",
                                fx(spark, sf, "fx_nodes"), "term")


@query("geo_left_join", """
SELECT a.ord, a.cod_postal, a.name, c.frecuencia
FROM fx_areas a LEFT JOIN (
  SELECT CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cp, count(*) AS frecuencia
  FROM fx_visits GROUP BY 1) c ON a.cod_postal = c.cp""")
def q_geo_left_join(spark, sf):
    counts = fx(spark, sf, "fx_visits").groupBy(pad_postal("cod_postal").alias("cp")) \
        .agg(F.count(F.lit(1)).alias("frecuencia"))
    return L.geo_left_join(fx(spark, sf, "fx_areas"), "cod_postal", counts, "cp")


@query("neighbour_join", """
SELECT a.term, p.nombre_diagnostico_psiquiatrico AS neighbour
FROM (SELECT DISTINCT term FROM fx_nodes) a JOIN fx_pairs p ON a.term = p.nombre_diagnostico
JOIN (SELECT DISTINCT term FROM fx_nodes) b ON p.nombre_diagnostico_psiquiatrico = b.term""")
def q_neighbour_join(spark, sf):
    nodes = fx(spark, sf, "fx_nodes").select("term").distinct()
    return L.neighbour_join(nodes, "term", fx(spark, sf, "fx_pairs"), "nombre_diagnostico",
                            "nombre_diagnostico_psiquiatrico")
