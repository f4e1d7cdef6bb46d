"""Registered queries: aggregation, order and sets (E*, F*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import pad_postal, upper_text
from dxspark.operators import agg
from dxspark.plans.fixtures import fx
from dxspark.plans.registry import query

DIAG_COLS = [f"diag_{i:02d}" for i in range(1, 21)]
DIAG_COLS_SQL = ", ".join(DIAG_COLS)
# first dictionary row per icd10 (DuckDB's arg_min skips null values, so rank instead)
FIRST_BY_ICD10 = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icd10 ORDER BY ord) AS rn_
                    FROM fx_crosswalk) WHERE rn_ = 1)"""


@query("count_by_keys", """
SELECT upper(provincia) AS provincia,
       CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal,
       count(*) AS frecuencia
FROM fx_visits GROUP BY 1, 2""")
def q_count_by_keys(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return agg.count_by_keys(v.select(upper_text("provincia").alias("provincia"),
                                      pad_postal("cod_postal").alias("cod_postal")),
                             ["provincia", "cod_postal"])


COUNT_EXPLODED_SQL = r"""
SELECT provincia, code, count(*) AS frecuencia
FROM (SELECT upper(provincia) AS provincia,
             unnest(CASE WHEN psq IS NULL THEN [NULL::VARCHAR]
                         ELSE list_transform(string_split(psq, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) END) AS code
      FROM fx_visits) t
GROUP BY 1, 2"""


def count_exploded_query(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return agg.count_exploded(v, [upper_text("provincia").alias("provincia")], "psq", out="code")


query("count_exploded", COUNT_EXPLODED_SQL)(count_exploded_query)


@query("count_per_value_by_area", r"""
SELECT code, cod_postal, count(*) AS frecuencia
FROM (SELECT regexp_replace(code, '^\s+|\s+$', '', 'g') AS code, cod_postal
      FROM (SELECT unnest(list_transform(string_split(psq, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS code,
                   CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal
            FROM fx_visits) s) t
WHERE code IS NOT NULL AND cod_postal IS NOT NULL
GROUP BY 1, 2""")
def q_count_per_value_by_area(spark, sf):
    from dxspark.functions.scalars import split_codes_comma
    v = fx(spark, sf, "fx_visits")
    rows = v.select(F.explode(split_codes_comma("psq")).alias("code"),
                    pad_postal("cod_postal").alias("cod_postal"))
    return agg.count_per_value_by_area(rows, "code", "cod_postal")


@query("distinct_values", "SELECT DISTINCT provincia FROM fx_visits")
def q_distinct_values(spark, sf):
    return agg.distinct_values(fx(spark, sf, "fx_visits"), "provincia")


DISTINCT_CODES_SQL = rf"""
SELECT DISTINCT code AS diagnostico
FROM (SELECT regexp_replace(unnest(string_split(cell, ',')), '^\s+|\s+$', '', 'g') AS code
      FROM (SELECT unnest([{DIAG_COLS_SQL}, psq]) AS cell FROM fx_diag_wide) c
      WHERE cell IS NOT NULL) t
WHERE code <> ''"""


@query("distinct_codes_sorted", DISTINCT_CODES_SQL)
def q_distinct_codes_sorted(spark, sf):
    return agg.distinct_codes_sorted(fx(spark, sf, "fx_diag_wide"), DIAG_COLS + ["psq"])


@query("union_distinct_codes", DISTINCT_CODES_SQL)
def q_union_distinct_codes(spark, sf):
    return agg.distinct_codes(fx(spark, sf, "fx_diag_wide"), DIAG_COLS + ["psq"])


@query("drop_duplicate_rows", "SELECT DISTINCT * FROM fx_pairs")
def q_drop_duplicate_rows(spark, sf):
    return agg.drop_duplicate_rows(fx(spark, sf, "fx_pairs"))


@query("count_all", "SELECT count(*) AS n FROM fx_visits")
def q_count_all(spark, sf):
    return agg.count_all(fx(spark, sf, "fx_visits"))


@query("class_distribution", """
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM fx_text GROUP BY label""")
def q_class_distribution(spark, sf):
    return agg.class_distribution(fx(spark, sf, "fx_text"), "label")


@query("mean_abs_by_feature", """
SELECT feature, round(avg(abs(value)), 6) AS importance FROM fx_attr GROUP BY feature""")
def q_mean_abs_by_feature(spark, sf):
    out = agg.mean_abs_by_feature(fx(spark, sf, "fx_attr"), "feature", "value")
    return out.withColumn("importance", F.round("importance", 6))


@query("node_out_degree", """
SELECT n.term, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree
FROM (SELECT DISTINCT term FROM fx_nodes) n
LEFT JOIN (SELECT nombre_diagnostico AS s, count(*) AS degree FROM fx_pairs GROUP BY 1) d ON n.term = d.s""")
def q_node_out_degree(spark, sf):
    return agg.node_out_degree(fx(spark, sf, "fx_nodes"), "term", fx(spark, sf, "fx_pairs"), "nombre_diagnostico")


@query("collapse_codes_to_list", f"""
SELECT d.visit_id, string_agg(c.description, ', ' ORDER BY d.pos) AS descriptions
FROM fx_diag_long d
JOIN {FIRST_BY_ICD10} c ON d.code = c.icd10
WHERE c.description IS NOT NULL AND c.description <> ''
GROUP BY d.visit_id""")
def q_collapse_codes_to_list(spark, sf):
    from dxspark.operators.lookup import lookup_first
    d = fx(spark, sf, "fx_diag_long")
    described = lookup_first(d, "code", fx(spark, sf, "fx_crosswalk"), "icd10", ["description"])
    return agg.collapse_to_list(described, ["visit_id"], "pos", "description", "descriptions")


@query("collapse_distinct_descriptions", f"""
SELECT f.visit_id, string_agg(coalesce(c.description, 'Descripcion no disponible'), ', ' ORDER BY f.pos) AS descriptions
FROM (SELECT visit_id, code, min(pos) AS pos FROM fx_diag_long WHERE code IS NOT NULL AND trim(code) <> '' GROUP BY 1, 2) f
LEFT JOIN {FIRST_BY_ICD10} c ON f.code = c.icd10
GROUP BY f.visit_id""")
def q_collapse_distinct_descriptions(spark, sf):
    from dxspark.operators.lookup import lookup_first
    d = fx(spark, sf, "fx_diag_long").where(F.col("code").isNotNull() & (F.trim("code") != ""))
    firsts = agg.first_occurrences(d, ["visit_id"], "pos", "code")
    described = lookup_first(firsts, "code", fx(spark, sf, "fx_crosswalk"), "icd10", ["description"]) \
        .withColumn("description", F.coalesce("description", F.lit("Descripcion no disponible")))
    return agg.collapse_to_list(described, ["visit_id"], "pos", "description", "descriptions")


# ------------------------------------------------------------------ order

@query("first_row_per_key", f"SELECT icd10, icd9, description, ord FROM {FIRST_BY_ICD10}")
def q_first_row_per_key(spark, sf):
    from dxspark.operators.lookup import first_row_per_key
    return first_row_per_key(fx(spark, sf, "fx_crosswalk"), "icd10", ["icd9", "description"])


@query("second_half", DISTINCT_CODES_SQL.replace(
    "SELECT DISTINCT code AS diagnostico", "SELECT diagnostico, pos FROM (SELECT diagnostico, row_number() OVER (ORDER BY diagnostico) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT code AS diagnostico", 1)
    + ") u) v WHERE pos > n // 2")
def q_second_half(spark, sf):
    codes = agg.distinct_codes(fx(spark, sf, "fx_diag_wide"), DIAG_COLS + ["psq"])
    return agg.second_half(codes, ["diagnostico"]).select("diagnostico", "pos")


@query("head_n", "SELECT * FROM fx_visits ORDER BY visit_id LIMIT 100")
def q_head_n(spark, sf):
    return agg.head_n(fx(spark, sf, "fx_visits"), ["visit_id"], 100)


@query("sort_desc", "SELECT * FROM fx_grid ORDER BY f1 DESC, run_id")
def q_sort_desc(spark, sf):
    return agg.sort_desc(fx(spark, sf, "fx_grid"), "f1", ["run_id"])


@query("top_k", "SELECT * FROM fx_grid ORDER BY f1 DESC, run_id LIMIT 10")
def q_top_k(spark, sf):
    return agg.top_k(fx(spark, sf, "fx_grid"), [F.col("f1").desc(), "run_id"], 10)


@query("composite_score_rank", """
SELECT run_id, model, f1, recall, round(0.6 * f1 + 0.4 * recall, 6) AS score
FROM fx_grid ORDER BY 0.6 * f1 + 0.4 * recall DESC, run_id LIMIT 10""")
def q_composite_score_rank(spark, sf):
    g = fx(spark, sf, "fx_grid").withColumn("_s", agg.composite_score("f1", "recall"))
    return agg.top_k(g, [F.col("_s").desc(), "run_id"], 10) \
        .withColumn("score", F.round("_s", 6)).drop("_s")


@query("top_abs_per_row", """
SELECT row_id, feature, value,
       CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature, value) AS INTEGER) AS rank
FROM fx_attr""")
def q_top_abs_per_row(spark, sf):
    return agg.top_abs_per_row(fx(spark, sf, "fx_attr"), "row_id", "feature", "value")


@query("sample_n", """
SELECT * FROM fx_visits ORDER BY md5('42|' || CAST(visit_id AS VARCHAR)), visit_id LIMIT 50""")
def q_sample_n(spark, sf):
    return agg.sample_n(fx(spark, sf, "fx_visits"), "visit_id", 50, seed=42)


@query("union_all", """
SELECT icd9, icd10, NULL::VARCHAR AS term FROM fx_crosswalk
UNION ALL SELECT NULL::VARCHAR AS icd9, icd10, term FROM fx_nodes""")
def q_union_all(spark, sf):
    a = fx(spark, sf, "fx_crosswalk").select("icd9", "icd10")
    b = fx(spark, sf, "fx_nodes").select("icd10", "term")
    return agg.union_all(a, b)
