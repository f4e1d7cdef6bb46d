"""Registered queries: scalar functions (H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions import scalars as S
from dxspark.operators.lookup import membership_flag
from dxspark.operators.reshape import filter_letter_codes
from dxspark.plans.fixtures import fx
from dxspark.plans.registry import query
from dxspark.plans.sql_snippets import STRIP



def insert_dot_sql(x: str) -> str:
    return (f"CASE WHEN length({x}) > 3 THEN substr({x}, 1, 3) || '.' || substr({x}, 4) "
            f"WHEN length({x}) = 3 THEN {x} || '.' ELSE {x} END")


def strip_dot_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^.+\\.\\s*$') THEN regexp_replace({x}, '[. ]+$', '') ELSE {x} END"


@query("insert_dot", f"""
SELECT ord, replace(icd9, '.', '') AS icd9_raw, {insert_dot_sql("replace(icd9, '.', '')")} AS icd9,
       replace(icd10, '.', '') AS icd10_raw, {insert_dot_sql("replace(icd10, '.', '')")} AS icd10
FROM fx_crosswalk""")
def q_insert_dot(spark, sf):
    cw = fx(spark, sf, "fx_crosswalk").select(
        "ord", F.replace("icd9", F.lit("."), F.lit("")).alias("icd9_raw"),
        F.replace("icd10", F.lit("."), F.lit("")).alias("icd10_raw"))
    return cw.select("ord", "icd9_raw", S.insert_dot("icd9_raw").alias("icd9"),
                     "icd10_raw", S.insert_dot("icd10_raw").alias("icd10"))


@query("strip_trailing_dot", f"""
SELECT ord, {strip_dot_sql(insert_dot_sql("replace(icd9, '.', '')"))} AS icd9,
       {strip_dot_sql(insert_dot_sql("replace(icd10, '.', '')"))} AS icd10,
       {strip_dot_sql("icd10 || ' . '")} AS icd10_padded
FROM fx_crosswalk""")
def q_strip_trailing_dot(spark, sf):
    cw = fx(spark, sf, "fx_crosswalk")
    d9 = S.insert_dot(F.replace("icd9", F.lit("."), F.lit("")))
    d10 = S.insert_dot(F.replace("icd10", F.lit("."), F.lit("")))
    return cw.select("ord", S.strip_trailing_dot(d9).alias("icd9"), S.strip_trailing_dot(d10).alias("icd10"),
                     S.strip_trailing_dot(F.concat("icd10", F.lit(" . "))).alias("icd10_padded"))


@query("split_codes_comma", f"""
SELECT visit_id, CAST(len(l) AS INTEGER) AS n_codes, array_to_string(l, '|') AS codes
FROM (SELECT visit_id, list_transform(string_split(psq, ','), lambda x: {STRIP.format('x')}) AS l FROM fx_visits) t""")
def q_split_codes_comma(spark, sf):
    v = fx(spark, sf, "fx_visits").select("visit_id", S.split_codes_comma("psq").alias("l"))
    return v.select("visit_id", F.size("l").alias("n_codes"), F.array_join("l", "|").alias("codes"))


@query("extract_bracket_codes", f"""
SELECT visit_id, CAST(len(l) AS INTEGER) AS n_codes, array_to_string(l, '|') AS codes
FROM (SELECT visit_id, list_transform(regexp_extract_all(conjunto, '\\[([^\\[\\]]+)\\]', 1),
                                      lambda x: {STRIP.format('x')}) AS l FROM fx_visits) t""")
def q_extract_bracket_codes(spark, sf):
    v = fx(spark, sf, "fx_visits").select("visit_id", S.extract_bracket_codes("conjunto").alias("l"))
    return v.select("visit_id", F.size("l").alias("n_codes"), F.array_join("l", "|").alias("codes"))


LETTER_ICD9_SQL = f"""(SELECT DISTINCT icd9 FROM fx_crosswalk
     WHERE regexp_matches({STRIP.format('icd9')}, '^\\p{{L}}') AND substr({STRIP.format('icd9')}, 1, 1) <> 'N')"""


@query("is_icd10", f"""
SELECT v.visit_id, v.psq,
       coalesce(regexp_matches(v.psq, '^\\p{{Lu}}') AND l.icd9 IS NULL, false) AS is_icd10
FROM fx_visits v LEFT JOIN {LETTER_ICD9_SQL} l ON v.psq = l.icd9""")
def q_is_icd10(spark, sf):
    letters = filter_letter_codes(fx(spark, sf, "fx_crosswalk"), "icd9")
    v = membership_flag(fx(spark, sf, "fx_visits").select("visit_id", "psq"), "psq", letters, "icd9", "_in")
    return v.select("visit_id", "psq", S.is_icd10("psq", F.col("_in")).alias("is_icd10"))


@query("is_icd9_by_letter", """
SELECT visit_id, psq, CASE WHEN psq IS NULL OR psq = '' THEN true ELSE NOT regexp_matches(psq, '^\\p{L}') END AS is_icd9
FROM fx_visits""")
def q_is_icd9_by_letter(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return v.select("visit_id", "psq", S.is_icd9_by_letter("psq").alias("is_icd9"))


@query("pad_postal", """
SELECT visit_id, CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal,
       CASE WHEN length(cod_postal || '12') < 5 THEN lpad(cod_postal || '12', 5, '0') ELSE cod_postal || '12' END AS long_code
FROM fx_visits""")
def q_pad_postal(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return v.select("visit_id", S.pad_postal("cod_postal").alias("cod_postal"),
                    S.pad_postal(F.concat("cod_postal", F.lit("12"))).alias("long_code"))


@query("upper_lower_text", """
SELECT visit_id, upper(provincia) AS upper_text, lower(provincia) AS lower_text FROM fx_visits""")
def q_upper_lower_text(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return v.select("visit_id", S.upper_text("provincia").alias("upper_text"),
                    S.lower_text("provincia").alias("lower_text"))


@query("trim_text", f"SELECT visit_id, pos, {STRIP.format('code')} AS code FROM fx_diag_long")
def q_trim_text(spark, sf):
    d = fx(spark, sf, "fx_diag_long")
    return d.select("visit_id", "pos", S.strip_text("code").alias("code"))


@query("is_blankish", """
SELECT visit_id, pos, code IS NULL OR code IN ('', 'null') AS blankish,
       trim(code) IS NULL OR trim(code) IN ('', 'null') AS blankish_trimmed FROM fx_diag_long""")
def q_is_blankish(spark, sf):
    d = fx(spark, sf, "fx_diag_long")
    return d.select("visit_id", "pos", S.is_blankish("code").alias("blankish"),
                    S.is_blankish(F.trim("code")).alias("blankish_trimmed"))


@query("round_metrics", "SELECT run_id, round_even(f1 / 3, 4) AS f1_r, round_even(recall / 7, 4) AS recall_r FROM fx_grid")
def q_round_metrics(spark, sf):
    g = fx(spark, sf, "fx_grid")
    return g.select("run_id", S.round_metric(F.col("f1") / 3).alias("f1_r"),
                    S.round_metric(F.col("recall") / 7).alias("recall_r"))


@query("bin_frequency", f"""
SELECT provincia, cod_postal, frecuencia,
       {S.bin_frequency_sql('frecuencia', S.NATIONAL_SCALE)} AS bin_national,
       {S.bin_frequency_sql('frecuencia', S.PROVINCE_SCALE)} AS bin_province
FROM (SELECT upper(provincia) AS provincia, cod_postal, count(*) AS frecuencia FROM fx_visits GROUP BY 1, 2) t""")
def q_bin_frequency(spark, sf):
    v = fx(spark, sf, "fx_visits")
    c = v.groupBy(S.upper_text("provincia").alias("provincia"), "cod_postal").agg(F.count(F.lit(1)).alias("frecuencia"))
    return c.select("provincia", "cod_postal", "frecuencia",
                    S.bin_frequency("frecuencia", S.NATIONAL_SCALE).alias("bin_national"),
                    S.bin_frequency("frecuencia", S.PROVINCE_SCALE).alias("bin_province"))


@query("parse_vector_literal", """
SELECT term, ord, CAST(len(v) AS INTEGER) AS n, CAST(v[1] AS DOUBLE) AS v0, CAST(v[2] AS DOUBLE) AS v1
FROM (SELECT term, ord, CAST(embedding_text AS FLOAT[]) AS v FROM fx_nodes) t""")
def q_parse_vector_literal(spark, sf):
    n = fx(spark, sf, "fx_nodes").select("term", "ord", S.parse_vector_literal("embedding_text").alias("v"))
    return n.select("term", "ord", F.size("v").alias("n"), F.col("v")[0].cast("double").alias("v0"),
                    F.col("v")[1].cast("double").alias("v1"))


@query("vector_to_literal", """
SELECT term, ord, CAST(to_json(CAST(embedding_text AS FLOAT[])) AS VARCHAR) AS literal FROM fx_nodes""")
def q_vector_to_literal(spark, sf):
    n = fx(spark, sf, "fx_nodes")
    return n.select("term", "ord", S.vector_to_literal(S.parse_vector_literal("embedding_text")).alias("literal"))


@query("upper_text", "SELECT visit_id, upper(provincia) AS provincia FROM fx_visits")
def q_upper_text(spark, sf):
    return fx(spark, sf, "fx_visits").select("visit_id", S.upper_text("provincia").alias("provincia"))


@query("lower_text", "SELECT visit_id, lower(provincia) AS provincia FROM fx_visits")
def q_lower_text(spark, sf):
    return fx(spark, sf, "fx_visits").select("visit_id", S.lower_text("provincia").alias("provincia"))
