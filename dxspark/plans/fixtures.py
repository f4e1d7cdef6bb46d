"""The `fx_*` views: the driver's parquet tables reshaped into the data model
of coded clinical records (FIXTURES.md part B).

Each view is one SELECT that runs unchanged in Spark SQL and DuckDB. In Spark
they are registered as temporary views over `<sf_dir>/<table>.parquet`; for the
DuckDB oracle, `with_fixtures(sql)` inlines the views a query uses as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# The view definitions of FIXTURES.md part B, in registration order.
FX_SQL: dict[str, str] = {
    "fx_crosswalk": """
SELECT p_partkey AS ord,
       CASE WHEN p_partkey % 11 = 0 THEN 'NN'
            WHEN p_partkey % 13 = 0 THEN 'V' || CAST(10 + p_partkey % 90 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING)
            ELSE CAST(100 + p_partkey % 900 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || CAST(p_partkey % 10 AS STRING) END AS icd9,
       chr(CAST(65 + p_partkey % 26 AS INT)) || CAST(10 + p_partkey % 90 AS STRING)
         || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || CAST(p_partkey % 10 AS STRING) END AS icd10,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name || ' ' || lower(p_type) END AS description
FROM part""",
    "fx_visits": """
SELECT o_orderkey AS visit_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'F20' WHEN '2-HIGH' THEN 'F20.89'
            WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'F20.89, F25' ELSE 'F20 ,F22' END
            WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN '295.3' ELSE 'V23.' || CAST(o_orderkey % 10 AS STRING) END
            ELSE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'F22' END END AS psq,
       '[' || CAST(100 + o_orderkey % 900 AS STRING) || '] x [' || chr(CAST(65 + o_orderkey % 26 AS INT)) || CAST(10 + o_orderkey % 90 AS STRING) || ']' AS conjunto,
       CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 'Desconocido'
            WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS provincia,
       CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE CAST(1000 + c_custkey % 97 AS STRING) END AS cod_postal
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_visits_mixed": """
SELECT CASE WHEN visit_id % 11 = 0 THEN NULL WHEN visit_id % 3 = 0 THEN visit_id - visit_id % 24 ELSE visit_id END AS visit_id,
       psq, conjunto, provincia, cod_postal
FROM fx_visits""",
    "fx_diag_long": """
SELECT l_orderkey AS visit_id, CAST(rn AS INT) AS pos,
       CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN '  '
            WHEN l_partkey % 4 = 0 AND icd9 <> 'NN' THEN substr(icd9, 1, length(icd9) - 1)
            WHEN l_partkey % 4 = 1 AND icd9 <> 'NN' THEN icd9
            WHEN l_partkey % 19 = 0 THEN 'X' || CAST(l_partkey AS STRING)
            ELSE icd10 END AS code
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) t
JOIN fx_crosswalk ON l_partkey = ord""",
    "fx_diag_wide": """
SELECT v.visit_id, v.psq,
       """ + ",\n       ".join(f"max(CASE WHEN pos = {i} THEN code END) AS diag_{i:02d}" for i in range(1, 21)) + """
FROM fx_visits v LEFT JOIN fx_diag_long d ON v.visit_id = d.visit_id
GROUP BY v.visit_id, v.psq""",
    "fx_pairs": """
SELECT d.code AS nombre_diagnostico,
       CASE WHEN v.visit_id % 50 = 0 THEN d.code ELSE v.psq END AS nombre_diagnostico_psiquiatrico
FROM fx_diag_long d JOIN fx_visits v ON d.visit_id = v.visit_id
WHERE d.code IS NOT NULL AND trim(d.code) <> '' AND v.psq IS NOT NULL""",
    "fx_text": """
SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_all_text": """
SELECT doc_id, text FROM documents""",
    "fx_scored": """
SELECT l.doc_id AS row_id, d.lang AS grp, l.quality AS y,
       CAST((d.n_chars * 7 + l.quality * 30) % 101 AS DOUBLE) / 100 AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "fx_attr": """
SELECT l_orderkey AS row_id, p_name AS feature, l_discount - 0.05 AS value
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_nodes": """
SELECT icd10 AS term, icd10, icd9,
       '[' || CAST(ord % 7 AS STRING) || '.5, ' || CAST(ord % 3 AS STRING) || '.25]' AS embedding_text, ord
FROM fx_crosswalk""",
    "fx_grid": """
SELECT p_partkey AS run_id, p_brand AS model,
       CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 AS f1, CAST(p_partkey * 53 % 97 AS DOUBLE) / 100 AS recall
FROM part""",
    "fx_areas": """
SELECT p_partkey AS ord, '0' || CAST(1000 + p_partkey AS STRING) AS cod_postal, 'AREA_' || CAST(p_partkey AS STRING) AS name
FROM part""",
    "fx_cache": """
SELECT icd10 AS code, 'cached ' || min(p_brand) AS text
FROM fx_crosswalk JOIN part ON ord = p_partkey WHERE ord % 5 = 0 GROUP BY icd10""",
}

FX_ORDER = list(FX_SQL)
_FX_RE = re.compile(r"\bfx_[a-z_]+\b")
_bound: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Bind the base tables of `sf_dir` and the fx views as temp views."""
    key = id(spark._jsparkSession)
    if _bound.get(key) == sf_dir and spark.catalog.tableExists("fx_cache"):
        return
    sf_dir = sf_dir.rstrip("/")
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in FX_ORDER:
        spark.sql(FX_SQL[name]).createOrReplaceTempView(name)
    _bound[key] = sf_dir


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view (or base table) of `sf_dir` as a DataFrame."""
    register(spark, sf_dir)
    return spark.table(name)


def _deps(names: set[str]) -> list[str]:
    out: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in out or n not in FX_SQL:
            continue
        out.add(n)
        stack.extend(_FX_RE.findall(FX_SQL[n]))
    return [n for n in FX_ORDER if n in out]


def with_fixtures(sql: str) -> str:
    """Prefix `sql` with the fx views it uses (transitively) as CTEs."""
    used = _deps(set(_FX_RE.findall(sql)))
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX_SQL[n].strip()})" for n in used)
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
