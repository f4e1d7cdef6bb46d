"""Registered queries: composite code-standardisation jobs (I*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import pad_postal, upper_text
from dxspark.operators import agg
from dxspark.operators import codes as C
from dxspark.operators.lookup import lookup_with_cache_default
from dxspark.operators.reshape import exclude_placeholders
from dxspark.plans import sql_snippets as Q
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_agg import DIAG_COLS, DISTINCT_CODES_SQL
from dxspark.plans.queries_reshape import ANY_VALUE_SQL
from dxspark.plans.queries_scalars import insert_dot_sql, strip_dot_sql
from dxspark.plans.registry import query

IS_ICD9_SQL = "CASE WHEN {0} IS NULL OR {0} = '' THEN true ELSE NOT regexp_matches({0}, '^\\p{{L}}') END"


def _cw(spark, sf):
    return fx(spark, sf, "fx_crosswalk")


@query("clean_crosswalk", f"""
WITH c AS (SELECT {strip_dot_sql(insert_dot_sql("replace(icd9, '.', '')"))} AS icd9,
                  {strip_dot_sql(insert_dot_sql("replace(icd10, '.', '')"))} AS icd10 FROM fx_crosswalk)
SELECT c.icd9 AS "ICD9", c.icd10 AS "ICD10", coalesce(x.description, 'Diagnostico no disponible') AS "Description"
FROM c LEFT JOIN fx_crosswalk x ON c.icd9 = x.icd9 AND c.icd10 = x.icd10""")
def q_clean_crosswalk(spark, sf):
    cw = _cw(spark, sf)
    undotted = cw.select(F.replace("icd9", F.lit("."), F.lit("")).alias("icd9"),
                         F.replace("icd10", F.lit("."), F.lit("")).alias("icd10"))
    return C.clean_crosswalk(undotted, cw)


def _standardise_sql() -> str:
    is9 = IS_ICD9_SQL.format("w.psq")
    codes = (f"SELECT unnest([{', '.join(DIAG_COLS)}]) AS code FROM fx_diag_wide w WHERE {is9}")
    conv = f"""(SELECT c.code, CASE WHEN c.code IN ('', 'null') THEN ''
                   WHEN regexp_matches(c.code, '^\\p{{Lu}}') AND l.icd9 IS NULL THEN c.code
                   ELSE coalesce(h.value, '') END AS new
            FROM (SELECT DISTINCT code FROM ({codes}) q WHERE code IS NOT NULL) c
            LEFT JOIN {Q.LETTER_ICD9} l ON c.code = l.icd9
            LEFT JOIN {Q.probe_9_to_10(codes)} h ON c.code = h.code)"""
    cols = ", ".join(f"CASE WHEN {is9} THEN (CASE WHEN w.{c} IS NULL THEN NULL ELSE c{i}.new END) ELSE w.{c} END AS {c}"
                     for i, c in enumerate(DIAG_COLS, 1))
    joins = " ".join(f"LEFT JOIN conv c{i} ON w.{c} = c{i}.code" for i, c in enumerate(DIAG_COLS, 1))
    return f"WITH conv AS MATERIALIZED {conv}\nSELECT w.visit_id, w.psq, {cols} FROM fx_diag_wide w {joins}"


@query("standardise_row_codes", _standardise_sql())
def q_standardise_row_codes(spark, sf):
    return C.standardise_row_codes(fx(spark, sf, "fx_diag_wide"), "visit_id", DIAG_COLS, "psq", _cw(spark, sf))


def _expand_sql(source: str, splitter, brackets: bool) -> str:
    kind = f"""v AS (SELECT x.visit_id, x.{source} AS src,
                coalesce(regexp_matches(x.psq, '^\\p{{Lu}}') AND l.icd9 IS NULL, false) AS is10
         FROM fx_visits x LEFT JOIN {Q.LETTER_ICD9} l ON x.psq = l.icd9 WHERE x.psq IS NOT NULL)"""
    long = f"""long AS (SELECT visit_id, is10, src, unnest(sp) AS code, generate_subscripts(sp, 1) AS pos
         FROM (SELECT *, {splitter('src')} AS sp FROM v) s)"""
    if brackets:
        dcode = "CASE WHEN is10 THEN long.code WHEN t10.value IS NOT NULL AND t10.value <> '' THEN t10.value END"
        to10 = "string_agg('[' || to10 || ']', ', ' ORDER BY pos) FILTER (WHERE to10 IS NOT NULL AND to10 <> '')"
        to9 = "string_agg(CASE WHEN to9 IS NOT NULL AND to9 <> '' THEN '[' || to9 || ']' ELSE '[NN]' END, ', ' ORDER BY pos)"
        es = "string_agg(es, ', ' ORDER BY pos) FILTER (WHERE dcode IS NOT NULL)"
    else:
        dcode = "CASE WHEN is10 THEN long.code ELSE coalesce(t10.value, '') END"
        to10 = "string_agg(to10, ', ' ORDER BY pos) FILTER (WHERE to10 IS NOT NULL AND to10 <> '')"
        to9 = "string_agg(to9, ', ' ORDER BY pos) FILTER (WHERE to9 IS NOT NULL AND to9 <> '')"
        es = "string_agg(es, ', ' ORDER BY pos)"
    return f"""WITH {kind}, {long},
l2 AS (SELECT long.*, t10.value AS to10, t9.value AS to9, {dcode} AS dcode FROM long
       LEFT JOIN {Q.probe_9_to_10('SELECT code FROM long')} t10 ON long.code = t10.code
       LEFT JOIN {Q.probe_10_to_9('SELECT code FROM long')} t9 ON long.code = t9.code),
l3 AS (SELECT l2.*, coalesce(d.value, 'Descripcion no encontrada #') AS es, e.en FROM l2
       LEFT JOIN {Q.probe_desc('SELECT dcode AS code FROM l2')} d ON l2.dcode = d.code
       LEFT JOIN {Q.english('SELECT dcode AS code FROM l2')} e ON l2.dcode = e.code),
a AS (SELECT visit_id, {to10} AS to10_list, {to9} AS to9_list, {es} AS es_list FROM l3 GROUP BY visit_id),
f AS (SELECT visit_id, dcode, min(pos) AS pos, min(en) AS en FROM l3 WHERE dcode IS NOT NULL GROUP BY 1, 2),
en AS (SELECT visit_id, string_agg(en, ', ' ORDER BY pos) AS en_list FROM f GROUP BY visit_id)
SELECT v.visit_id,
       CASE WHEN v.is10 THEN v.src ELSE coalesce(a.to10_list, '') END AS icd10_list,
       CASE WHEN v.is10 THEN coalesce(a.to9_list, '') ELSE v.src END AS icd9_list,
       regexp_replace(coalesce(a.es_list, ''), '[, ]+$', '') AS descripcion_es,
       coalesce(en.en_list, '') AS descripcion_en
FROM v LEFT JOIN a ON v.visit_id = a.visit_id LEFT JOIN en ON v.visit_id = en.visit_id"""


@query("expand_target_codes", _expand_sql("psq", Q.split_comma, brackets=False))
def q_expand_target_codes(spark, sf):
    return C.expand_target_codes(fx(spark, sf, "fx_visits"), "visit_id", "psq", _cw(spark, sf),
                                 fx(spark, sf, "fx_cache"))


@query("expand_bracket_codes", _expand_sql("conjunto", Q.brackets, brackets=True))
def q_expand_bracket_codes(spark, sf):
    return C.expand_bracket_codes(fx(spark, sf, "fx_visits"), "visit_id", "psq", "conjunto", _cw(spark, sf),
                                  fx(spark, sf, "fx_cache"))


def _describe_sql(table: str = "fx_diag_wide w") -> str:
    first = Q.first_rows("icd10")
    cols = ", ".join(f"CASE WHEN w.{c} IS NULL OR w.{c} IN ('', 'null') THEN NULL ELSE c{i}.description END AS {c}"
                     for i, c in enumerate(DIAG_COLS, 1))
    joins = " ".join(f"LEFT JOIN {first} c{i} ON w.{c} = c{i}.icd10" for i, c in enumerate(DIAG_COLS, 1))
    return (f"SELECT w.visit_id, CASE WHEN t.icd10 IS NOT NULL THEN t.description ELSE 'No encontrado' END AS psq, "
            f"{cols} FROM {table} LEFT JOIN {first} t ON w.psq = t.icd10 {joins}")


@query("describe_codes", _describe_sql())
def q_describe_codes(spark, sf):
    return C.describe_codes(fx(spark, sf, "fx_diag_wide"), "visit_id", DIAG_COLS, "psq", _cw(spark, sf))


_DESCRIBE_LIST_SQL = f"""
WITH long AS (SELECT visit_id, unnest(sp) AS code, generate_subscripts(sp, 1) AS pos
              FROM (SELECT visit_id, {Q.split_comma('psq')} AS sp FROM fx_visits WHERE psq IS NOT NULL) s)
SELECT long.visit_id,
       regexp_replace(string_agg(coalesce(d.value, 'Descripcion no encontrada #'), ', ' ORDER BY pos), '[, ]+$', '') AS descriptions
FROM long LEFT JOIN {Q.probe_desc('SELECT code FROM long')} d ON long.code = d.code
GROUP BY long.visit_id"""


@query("describe_code_list", _DESCRIBE_LIST_SQL)
def q_describe_code_list(spark, sf):
    return C.describe_code_list(fx(spark, sf, "fx_visits"), "visit_id", "psq", _cw(spark, sf))


# fx_visits_mixed is fx_visits with repeated and null keys: the lists of a visit stay its own
MIXED_KEY = "CASE WHEN visit_id % 11 = 0 THEN NULL WHEN visit_id % 3 = 0 THEN visit_id - visit_id % 24 ELSE visit_id END"


def _mixed(sql: str) -> str:
    return f"SELECT * REPLACE ({MIXED_KEY} AS visit_id) FROM ({sql}) e"


@query("expand_target_codes_mixed", _mixed(_expand_sql("psq", Q.split_comma, brackets=False)))
def q_expand_target_codes_mixed(spark, sf):
    return C.expand_target_codes(fx(spark, sf, "fx_visits_mixed"), "visit_id", "psq", _cw(spark, sf), fx(spark, sf, "fx_cache"))


@query("expand_bracket_codes_mixed", _mixed(_expand_sql("conjunto", Q.brackets, brackets=True)))
def q_expand_bracket_codes_mixed(spark, sf):
    return C.expand_bracket_codes(fx(spark, sf, "fx_visits_mixed"), "visit_id", "psq", "conjunto", _cw(spark, sf),
                                  fx(spark, sf, "fx_cache"))


@query("describe_code_list_mixed", _mixed(_DESCRIBE_LIST_SQL))
def q_describe_code_list_mixed(spark, sf):
    return C.describe_code_list(fx(spark, sf, "fx_visits_mixed"), "visit_id", "psq", _cw(spark, sf))


@query("build_code_master", f"""
WITH codes AS ({DISTINCT_CODES_SQL.replace('AS diagnostico', 'AS code')})
SELECT coalesce(f.description, '') AS termino_es, c.code AS icd10, coalesce(f.icd9, '') AS icd9,
       CASE WHEN f.icd10 IS NOT NULL THEN e.en ELSE '' END AS termino_in
FROM codes c LEFT JOIN {Q.first_rows('icd10')} f ON c.code = f.icd10
LEFT JOIN {Q.english('SELECT code FROM codes')} e ON c.code = e.code""")
def q_build_code_master(spark, sf):
    codes = agg.distinct_codes(fx(spark, sf, "fx_diag_wide"), DIAG_COLS + ["psq"])
    return C.build_code_master(codes, "diagnostico", _cw(spark, sf), fx(spark, sf, "fx_cache"))


@query("build_code_master_vectors", f"""
SELECT c.code AS icd10, coalesce(f.description, '') AS termino_es, true AS length_is_one_or_no_term
FROM ({DISTINCT_CODES_SQL.replace('AS diagnostico', 'AS code')}) c LEFT JOIN {Q.first_rows('icd10')} f ON c.code = f.icd10""")
def q_build_code_master_vectors(spark, sf):
    """I7 with term vectors: every code has one, of length 1 where it has a term."""
    codes = agg.distinct_codes(fx(spark, sf, "fx_diag_wide"), DIAG_COLS + ["psq"])
    m = C.code_master_with_vectors(codes, "diagnostico", _cw(spark, sf), fx(spark, sf, "fx_cache"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return m.select("icd10", "termino_es", F.when(F.col("termino_es") == "", length == 0).otherwise(F.abs(length - 1) < 1e-9).alias("length_is_one_or_no_term"))


def _names(spark, sf):
    w = fx(spark, sf, "fx_diag_wide")
    cells = F.array(*[F.col(c) for c in DIAG_COLS + ["psq"]])
    codes = w.select(F.explode(cells).alias("code")).where(F.col("code").isNotNull()).distinct()
    return lookup_with_cache_default(codes, "code", fx(spark, sf, "fx_cache"), "code", "text", _cw(spark, sf),
                                     "icd10", "description", C.NO_ENGLISH_TEXT, "name")


@query("build_pairs", f"""
WITH p AS (SELECT unnest([{', '.join(DIAG_COLS)}]) AS d, psq AS p FROM fx_diag_wide WHERE psq IS NOT NULL AND psq <> ''),
allc AS (SELECT unnest([{', '.join(DIAG_COLS)}, psq]) AS code FROM fx_diag_wide),
nm AS {Q.english('SELECT code FROM allc')},
n AS (SELECT a.en AS a, b.en AS b FROM p LEFT JOIN nm a ON p.d = a.code LEFT JOIN nm b ON p.p = b.code
      WHERE p.d IS NOT NULL AND p.d <> '')
SELECT DISTINCT a AS nombre_diagnostico, b AS nombre_diagnostico_psiquiatrico FROM n
WHERE a IS NOT NULL AND a <> '' AND b IS NOT NULL AND b <> '' AND a <> b""")
def q_build_pairs(spark, sf):
    return C.build_pairs(fx(spark, sf, "fx_diag_wide"), DIAG_COLS, "psq", _names(spark, sf), "code", "name")


MASKED = ", ".join(
    f"CASE WHEN regexp_matches({c}, 'F20.89') THEN NULL WHEN regexp_matches({c}, 'F20.0') THEN NULL ELSE {c} END AS {c}"
    for c in DIAG_COLS)
BINARY_BASE = f"""(SELECT * FROM (SELECT visit_id, psq, {MASKED} FROM fx_diag_wide
                   WHERE regexp_matches(psq, 'F20|F20.89')) b WHERE {ANY_VALUE_SQL})"""


def _combine_sql(code: str, desc: str) -> str:
    c = f"coalesce({Q.STRIP.format(code)}, '')"
    d = f"coalesce({Q.STRIP.format(desc)}, '')"
    return f"CASE WHEN {c} <> '' AND {d} <> '' THEN {c} || ': ' || {d} WHEN {c} <> '' THEN {c} WHEN {d} <> '' THEN {d} ELSE '' END"


@query("build_binary_dataset", f"""
WITH k AS {BINARY_BASE}, d AS ({_describe_sql('k w')})
SELECT k.visit_id, k.psq, {', '.join(f"{_combine_sql('k.' + c, 'd.' + c)} AS {c}" for c in DIAG_COLS)}
FROM k JOIN d ON k.visit_id = d.visit_id""")
def q_build_binary_dataset(spark, sf):
    return C.build_binary_dataset(fx(spark, sf, "fx_diag_wide"), "visit_id", DIAG_COLS, "psq", _cw(spark, sf))


@query("build_binary_dataset_descriptions", f"WITH k AS {BINARY_BASE} {_describe_sql('k w')}")
def q_build_binary_dataset_desc(spark, sf):
    return C.build_binary_dataset(fx(spark, sf, "fx_diag_wide"), "visit_id", DIAG_COLS, "psq", _cw(spark, sf),
                                  variant="descriptions")


@query("count_area_report", """
SELECT provincia, cod_postal, count(*) AS frecuencia
FROM (SELECT upper(provincia) AS provincia,
             CASE WHEN length(cod_postal) < 5 THEN lpad(cod_postal, 5, '0') ELSE cod_postal END AS cod_postal
      FROM fx_visits) t
WHERE provincia IS NOT NULL AND provincia NOT IN ('DESCONOCIDO', 'EXTRANJERO', '', 'NAN', 'NULL')
GROUP BY 1, 2""")
def q_count_area_report(spark, sf):
    v = fx(spark, sf, "fx_visits").select(upper_text("provincia").alias("provincia"),
                                          pad_postal("cod_postal").alias("cod_postal"))
    return agg.count_by_keys(exclude_placeholders(v, "provincia"), ["provincia", "cod_postal"])
