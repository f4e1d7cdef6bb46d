"""Registered queries: projection, reshaping, filters (B*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import code_length, code_letter, is_icd9_by_letter, pad_postal, upper_text
from dxspark.operators import reshape as R
from dxspark.operators.lookup import lookup_first
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_agg import DIAG_COLS, DIAG_COLS_SQL, FIRST_BY_ICD10
from dxspark.plans.registry import query
from dxspark.plans.sql_snippets import STRIP

LANGS = ["de", "en", "es", "fr"]


@query("select_by_prefix", f"SELECT visit_id, {DIAG_COLS_SQL} FROM fx_diag_wide")
def q_select_by_prefix(spark, sf):
    return R.select_by_prefix(fx(spark, sf, "fx_diag_wide"), "diag", keep=["visit_id"])


@query("rename_reorder", """
SELECT icd9 AS "ICD9", ord, icd10 AS "ICD10", description AS "Description" FROM fx_crosswalk""")
def q_rename_reorder(spark, sf):
    cw = fx(spark, sf, "fx_crosswalk").toDF(" ord", "icd9 ", "icd10", "description")  # ragged header names
    return R.rename_reorder(cw, {"icd9": "ICD9", "icd10": "ICD10", "description": "Description"}, first="ICD9")


@query("hconcat_columns", f"SELECT {DIAG_COLS_SQL}, psq FROM fx_diag_wide")
def q_hconcat_columns(spark, sf):
    return R.hconcat_columns(fx(spark, sf, "fx_diag_wide"), DIAG_COLS, ["psq"])


UNPIVOT_SQL = "\nUNION ALL ".join(
    f"SELECT visit_id, psq, {i} AS pos, {c} AS code FROM fx_diag_wide "
    f"WHERE {c} IS NOT NULL AND {STRIP.format(c)} <> ''" for i, c in enumerate(DIAG_COLS, 1))


@query("unpivot_codes", UNPIVOT_SQL)
def q_unpivot_codes(spark, sf):
    return R.unpivot_codes(fx(spark, sf, "fx_diag_wide"), ["visit_id", "psq"], DIAG_COLS)


@query("pivot_metrics", """
SELECT metric, """ + ", ".join(f"max(CASE WHEN grp = '{g}' THEN value END) AS {g}" for g in LANGS) + """
FROM (SELECT grp, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fx_scored GROUP BY grp
      UNION ALL SELECT grp, 'mean_score', round(avg(score), 6) FROM fx_scored GROUP BY grp
      UNION ALL SELECT grp, 'positives', CAST(sum(y) AS DOUBLE) FROM fx_scored GROUP BY grp) t
GROUP BY metric""")
def q_pivot_metrics(spark, sf):
    s = fx(spark, sf, "fx_scored")
    per = s.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"),
                               F.round(F.avg("score"), 6).alias("mean_score"),
                               F.sum("y").cast("double").alias("positives"))
    long = per.unpivot(["grp"], ["n", "mean_score", "positives"], "metric", "value")
    return R.pivot_metrics(long, "metric", "grp", "value", values=LANGS)


@query("combine_code_desc", f"""
SELECT d.visit_id, d.pos,
       CASE WHEN coalesce({STRIP.format('d.code')}, '') <> '' AND coalesce({STRIP.format('c.description')}, '') <> ''
                 THEN {STRIP.format('d.code')} || ': ' || {STRIP.format('c.description')}
            WHEN coalesce({STRIP.format('d.code')}, '') <> '' THEN {STRIP.format('d.code')}
            WHEN coalesce({STRIP.format('c.description')}, '') <> '' THEN {STRIP.format('c.description')}
            ELSE '' END AS combined
FROM fx_diag_long d LEFT JOIN {FIRST_BY_ICD10} c ON d.code = c.icd10""")
def q_combine_code_desc(spark, sf):
    d = lookup_first(fx(spark, sf, "fx_diag_long"), "code", fx(spark, sf, "fx_crosswalk"), "icd10", ["description"])
    return d.select("visit_id", "pos", R.combine_code_desc("code", "description").alias("combined"))


@query("row_text_keep_gaps", "SELECT visit_id, concat_ws(' ', "
       + ", ".join(f"coalesce({c}, '')" for c in DIAG_COLS) + ") AS text FROM fx_diag_wide")
def q_row_text_keep_gaps(spark, sf):
    w = fx(spark, sf, "fx_diag_wide")
    return w.select("visit_id", R.row_text_keep_gaps(DIAG_COLS).alias("text"))


@query("row_text_all_but_target", "SELECT psq, concat_ws(' ', CAST(visit_id AS VARCHAR), "
       + ", ".join(f"coalesce({c}, '')" for c in DIAG_COLS) + ") AS text FROM fx_diag_wide")
def q_row_text_all_but_target(spark, sf):
    w = fx(spark, sf, "fx_diag_wide")
    return w.select("psq", R.row_text_all_but_target(w, "psq").alias("text"))


@query("row_text_skip_empty", "SELECT visit_id, concat_ws(' ', "
       + ", ".join(f"CASE WHEN {c} <> '' THEN {c} END" for c in DIAG_COLS) + ") AS text FROM fx_diag_wide")
def q_row_text_skip_empty(spark, sf):
    w = fx(spark, sf, "fx_diag_wide")
    return w.select("visit_id", R.row_text_skip_empty(DIAG_COLS).alias("text"))


@query("fill_defaults", """
SELECT ord, icd9, icd10, coalesce(description, 'Diagnostico no disponible') AS description FROM fx_crosswalk""")
def q_fill_defaults(spark, sf):
    return R.fill_defaults(fx(spark, sf, "fx_crosswalk"), {"description": R.DEFAULT_DESCRIPTION})


@query("mask_leaking_codes", "SELECT visit_id, psq, " + ", ".join(
    f"CASE WHEN regexp_matches({c}, 'F20.89') THEN NULL WHEN regexp_matches({c}, 'F20.0') THEN NULL ELSE {c} END AS {c}"
    for c in DIAG_COLS) + " FROM fx_diag_wide")
def q_mask_leaking_codes(spark, sf):
    return R.mask_leaking_codes(fx(spark, sf, "fx_diag_wide"), "psq", ["F20.89", "F20.0"])


@query("overwrite_columns", """
SELECT visit_id, psq, conjunto, upper(provincia) AS provincia,
       CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal,
       CASE WHEN psq IS NULL OR psq = '' THEN true ELSE NOT regexp_matches(psq, '^\\p{L}') END AS is_icd9
FROM fx_visits""")
def q_overwrite_columns(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return R.overwrite_columns(v, {"provincia": upper_text("provincia"), "cod_postal": pad_postal("cod_postal")},
                               {"is_icd9": is_icd9_by_letter("psq")})


@query("derive_label", """
SELECT visit_id, CAST(psq = 'F20' AS INTEGER) AS y_equal,
       CAST(regexp_matches(psq, 'F20.89') AS INTEGER) AS y_regex,
       CAST(contains(psq, 'F20') AND NOT contains(psq, 'F20.89') AS INTEGER) AS y_literal,
       CAST(substr(upper(coalesce(psq, '')), 1, 1) IN ('F') AS INTEGER) AS y_letter
FROM fx_visits""")
def q_derive_label(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return v.select("visit_id", R.label_equals("psq", "F20").alias("y_equal"),
                    R.label_regex("psq", "F20.89").alias("y_regex"),
                    R.label_contains_not("psq", "F20", "F20.89").alias("y_literal"),
                    R.label_first_letter("psq", ["F"]).alias("y_letter"))


@query("derive_label_map", """
SELECT v.visit_id, v.psq, m.label FROM fx_visits v
JOIN (VALUES ('F20', 0), ('F20.89', 1)) m(key, label) ON v.psq = m.key""")
def q_derive_label_map(spark, sf):
    v = fx(spark, sf, "fx_visits").select("visit_id", "psq")
    mapping = spark.createDataFrame([("F20", 0), ("F20.89", 1)], "key string, label int")
    return R.label_by_map(v, "psq", mapping)


@query("code_features", """
SELECT visit_id, pos, CAST(length(coalesce(code, '')) AS INTEGER) AS code_len, substr(coalesce(code, ''), 1, 1) AS code_letter
FROM fx_diag_long""")
def q_code_features(spark, sf):
    d = fx(spark, sf, "fx_diag_long")
    return d.select("visit_id", "pos", code_length("code").alias("code_len"), code_letter("code").alias("code_letter"))


# ------------------------------------------------------------------ filters

@query("drop_self_pairs", """
SELECT * FROM fx_pairs WHERE nombre_diagnostico IS NULL OR nombre_diagnostico_psiquiatrico IS NULL
   OR nombre_diagnostico <> nombre_diagnostico_psiquiatrico""")
def q_drop_self_pairs(spark, sf):
    return R.drop_self_pairs(fx(spark, sf, "fx_pairs"), "nombre_diagnostico", "nombre_diagnostico_psiquiatrico")


ANY_VALUE_SQL = " OR ".join(
    f"coalesce({c} IS NOT NULL AND {c} <> '' AND {STRIP.format(c)} <> '', false)" for c in DIAG_COLS)


@query("keep_rows_with_any_value", f"SELECT * FROM fx_diag_wide WHERE {ANY_VALUE_SQL}")
def q_keep_rows_with_any_value(spark, sf):
    return R.keep_rows_with_any_value(fx(spark, sf, "fx_diag_wide"), DIAG_COLS)


@query("keep_rows_report", f"""
SELECT CAST(sum(CASE WHEN {ANY_VALUE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN {ANY_VALUE_SQL} THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM fx_diag_wide""")
def q_keep_rows_report(spark, sf):
    return R.keep_rows_report(fx(spark, sf, "fx_diag_wide"), DIAG_COLS)


@query("filter_contains_any", "SELECT * FROM fx_visits WHERE regexp_matches(psq, 'F20|F20.89')")
def q_filter_contains_any(spark, sf):
    return R.filter_contains_any(fx(spark, sf, "fx_visits"), "psq", ["F20", "F20.89"])


@query("filter_letter_codes", f"""
SELECT * FROM fx_crosswalk
WHERE regexp_matches({STRIP.format('icd9')}, '^\\p{{L}}') AND substr({STRIP.format('icd9')}, 1, 1) <> 'N'""")
def q_filter_letter_codes(spark, sf):
    return R.filter_letter_codes(fx(spark, sf, "fx_crosswalk"), "icd9")


@query("filter_region", "SELECT * FROM fx_visits WHERE upper(provincia) = 'NATION_7'")
def q_filter_region(spark, sf):
    return R.filter_region(fx(spark, sf, "fx_visits"), "provincia", "nation_7")


@query("exclude_placeholders", """
SELECT DISTINCT upper(provincia) AS provincia FROM fx_visits
WHERE upper(provincia) IS NOT NULL AND upper(provincia) NOT IN ('DESCONOCIDO', 'EXTRANJERO', '', 'NAN', 'NULL')""")
def q_exclude_placeholders(spark, sf):
    v = fx(spark, sf, "fx_visits").select(upper_text("provincia").alias("provincia"))
    return R.exclude_placeholders(v, "provincia").distinct()


IN_LIST = ["B11.1", "C12.2", "D13", "E40", "F20.89"]


@query("filter_in_list", "SELECT * FROM fx_nodes WHERE icd10 IN ("
       + ", ".join(f"'{c}'" for c in IN_LIST) + ")")
def q_filter_in_list(spark, sf):
    return R.filter_in_list(fx(spark, sf, "fx_nodes"), "icd10", IN_LIST)


@query("drop_unmapped_rows", "SELECT * FROM fx_crosswalk WHERE description IS NOT NULL")
def q_drop_unmapped_rows(spark, sf):
    return R.drop_unmapped_rows(fx(spark, sf, "fx_crosswalk"), ["description"])


@query("find_by_key", "SELECT * FROM fx_nodes WHERE term = 'D13'")
def q_find_by_key(spark, sf):
    return R.find_by_key(fx(spark, sf, "fx_nodes"), "term", "D13")
