"""SQL text builders shared by the DuckDB oracles.

The oracle for variant lookups is the reference's own procedure written as
SQL: every probe code expands to its 111 candidates in probe order, and the
candidate with the smallest priority that hits the first dictionary row of a
key wins. This is deliberately independent of the Spark stem index.
"""

from __future__ import annotations

from dxspark.functions.scalars import STRIP_CHARS

STRIP = "trim({0}, '" + STRIP_CHARS + "')"


def first_rows(key: str, table: str = "fx_crosswalk") -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS rn_ "
            f"FROM {table}) WHERE rn_ = 1)")


def probe(codes: str, key: str, value: str, guard: str | None = None) -> str:
    """(code, value) of the best hit for each code of `codes` (a query with a
    `code` column); misses absent."""
    dict_sql = f"(SELECT {key} AS k, {value} AS v FROM {first_rows(key)} WHERE {guard or 'true'})"
    c = f"(SELECT DISTINCT code FROM ({codes}) q WHERE code IS NOT NULL)"
    cands = f"""
      SELECT code, code AS cand, 0 AS pri FROM {c} c0
      UNION ALL SELECT code, code || '.', 1 FROM {c} c1 WHERE NOT contains(code, '.')
      UNION ALL SELECT code, code || '.' || CAST(i AS VARCHAR), 2 + i FROM {c} c2, range(10) t(i) WHERE NOT contains(code, '.')
      UNION ALL SELECT code, code || '.' || lpad(CAST(i AS VARCHAR), 2, '0'), 12 + i FROM {c} c3, range(100) t(i) WHERE NOT contains(code, '.')
      UNION ALL SELECT code, code || CAST(i AS VARCHAR), 2 + i FROM {c} c4, range(10) t(i) WHERE contains(code, '.')
      UNION ALL SELECT code, code || lpad(CAST(i AS VARCHAR), 2, '0'), 12 + i FROM {c} c5, range(100) t(i) WHERE contains(code, '.')"""
    return (f"(SELECT cc.code, arg_min(d.v, cc.pri) AS value FROM ({cands}) cc "
            f"JOIN {dict_sql} d ON cc.cand = d.k GROUP BY cc.code)")


def probe_9_to_10(codes: str) -> str:
    return probe(codes, "icd9", "icd10")


def probe_10_to_9(codes: str) -> str:
    return probe(codes, "icd10", "icd9", "icd9 <> 'NN'")


def probe_desc(codes: str) -> str:
    return probe(codes, "icd10", "description", "description IS NOT NULL")


def english(codes: str) -> str:
    """(code, en): cache, first exact row with text, first row (by ord) whose
    key starts with the code, default."""
    c = f"(SELECT DISTINCT code FROM ({codes}) q WHERE code IS NOT NULL)"
    exact = (f"(SELECT * FROM (SELECT icd10, description, row_number() OVER (PARTITION BY icd10 ORDER BY ord) AS rn_ "
             f"FROM fx_crosswalk WHERE description IS NOT NULL) WHERE rn_ = 1)")
    return f"""(SELECT c.code, coalesce(ca.text, ex.description, px.d, 'Descripción no disponible') AS en
  FROM {c} c
  LEFT JOIN fx_cache ca ON c.code = ca.code
  LEFT JOIN {exact} ex ON c.code = ex.icd10
  LEFT JOIN (SELECT c2.code AS k, arg_min(x.description, x.ord) AS d FROM {c} c2
             JOIN fx_crosswalk x ON length(c2.code) > 0 AND starts_with(x.icd10, c2.code)
             WHERE x.description IS NOT NULL GROUP BY c2.code) px ON c.code = px.k)"""


LETTER_ICD9 = (f"(SELECT DISTINCT icd9 FROM fx_crosswalk WHERE regexp_matches({STRIP.format('icd9')}, '^\\p{{L}}') "
               f"AND substr({STRIP.format('icd9')}, 1, 1) <> 'N')")


def split_comma(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda s: {STRIP.format('s')})"


def brackets(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\[([^\\[\\]]+)\\]', 1), lambda s: {STRIP.format('s')})"
