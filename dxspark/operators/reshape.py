"""Projection, reshaping and row filters (inventory B1-B14, C1-C10).

Everything here is row-local (Project / Filter / Generate): no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxspark.functions.scalars import col, strip_text, upper_text

# Placeholder province names dropped before the area maps.
PLACEHOLDER_AREAS = ("DESCONOCIDO", "EXTRANJERO", "", "NAN", "NULL")
DEFAULT_DESCRIPTION = "Diagnostico no disponible"


# ---------------------------------------------------------------- B: reshape

def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Case-sensitive prefix match on column names (Spark name resolution is not)."""
    return [c for c in df.columns if c.startswith(prefix)]


def select_by_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """B1."""
    return df.select(*keep, *[c for c in columns_with_prefix(df, prefix) if c not in keep])


def rename_reorder(df: DataFrame, mapping: Mapping[str, str] | None = None,
                   first: str | None = None, strip_names: bool = True) -> DataFrame:
    """B2: strip header names, rename, optionally move one column first."""
    names = [c.strip() if strip_names else c for c in df.columns]
    names = [(mapping or {}).get(n, n) for n in names]
    out = df.toDF(*names)
    if first:
        out = out.select(first, *[c for c in names if c != first])
    return out


def hconcat_columns(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """Column groups of one table side by side (a single projection)."""
    return df.select(*[c for g in groups for c in g])


def unpivot_codes(df: DataFrame, ids: Sequence[str], code_cols: Sequence[str],
                  pos: str = "pos", value: str = "code", drop_empty: bool = True) -> DataFrame:
    """Wide positional code columns -> (ids..., pos, code); a Generate, no shuffle."""
    cells = F.array(*[F.struct(F.lit(i).alias(pos), col(c).cast("string").alias(value))
                      for i, c in enumerate(code_cols, start=1)])
    out = df.select(*ids, F.inline(cells))
    if drop_empty:
        out = out.where(F.col(value).isNotNull() & (strip_text(value) != ""))
    return out


def pivot_metrics(df: DataFrame, row: str, column: str, value: str,
                  values: Sequence[str] | None = None, fill=None) -> DataFrame:
    """Long (row, column, value) -> one row per `row`, one column per `column`
    value. Pass `values` to skip the extra distinct job."""
    out = df.groupBy(row).pivot(column, list(values) if values is not None else None).agg(F.first(value))
    return out.fillna(fill) if fill is not None else out


def combine_code_desc(code, desc) -> Column:
    """B6: 'code: desc', or whichever exists, else ''."""
    c = F.coalesce(strip_text(code), F.lit(""))
    d = F.coalesce(strip_text(desc), F.lit(""))
    return (F.when((c != "") & (d != ""), F.concat(c, F.lit(": "), d))
            .when(c != "", c).when(d != "", d).otherwise(F.lit("")))


def row_text_keep_gaps(cols: Sequence) -> Column:
    """Values joined by one blank, nulls as '' (runs of blanks remain)."""
    return F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])


def row_text_all_but_target(df: DataFrame, target: str) -> Column:
    """B7 over every column except the target."""
    return row_text_keep_gaps([c for c in df.columns if c != target])


def row_text_skip_empty(cols: Sequence) -> Column:
    """Only non-empty values, joined by one blank."""
    return F.concat_ws(" ", *[F.when(col(c).cast("string") != "", col(c).cast("string")) for c in cols])


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """B10."""
    return df.fillna(dict(defaults))


def mask_leaking_codes(df: DataFrame, target: str, patterns: Sequence[str]) -> DataFrame:
    """Null every string cell (except the target) that contains one of the
    regex `patterns` ('.' is a wildcard, as in the reference)."""
    string_cols = [f.name for f in df.schema.fields
                   if f.name != target and f.dataType.simpleString() == "string"]

    def masked(c: str) -> Column:
        e = None
        for p in patterns:
            e = (F.when(F.col(c).rlike(p), F.lit(None)) if e is None
                 else e.when(F.col(c).rlike(p), F.lit(None)))
        return e.otherwise(F.col(c)).alias(c)

    return df.withColumns({c: masked(c) for c in string_cols})


def overwrite_columns(df: DataFrame, replaced: Mapping[str, Column],
                      appended: Mapping[str, Column] | None = None) -> DataFrame:
    """Replace columns in place (order kept) and append new ones."""
    return df.withColumns(dict(replaced)).withColumns(dict(appended or {}))


def label_equals(c, value: str) -> Column:
    """B13 rule 1: equality."""
    return (col(c) == value).cast("int")


def label_regex(c, pattern: str) -> Column:
    """B13 rule 2: regex contains."""
    return col(c).rlike(pattern).cast("int")


def label_contains_not(c, present: str, absent: str) -> Column:
    """B13 rule 3: literal contains `present` and not `absent`."""
    return (col(c).contains(present) & ~col(c).contains(absent)).cast("int")


def label_first_letter(c, letters: Sequence[str]) -> Column:
    """B13 rule 5: first character in a class (null -> '' first)."""
    return F.substring(F.upper(F.coalesce(col(c), F.lit(""))), 1, 1).isin(*letters).cast("int")


def label_by_map(df: DataFrame, c: str, mapping: DataFrame, key: str = "key",
                 label: str = "label") -> DataFrame:
    """B13 rule 4: map through a (key, label) table, rows without a label dropped.
    The mapping is a handful of class values, so it is broadcast."""
    return df.join(F.broadcast(mapping.select(F.col(key).alias("_k"), label)),
                   F.col(c) == F.col("_k"), "inner").drop("_k")


# ---------------------------------------------------------------- C: filters

def drop_self_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pandas `a != b` keeps rows where either end is null."""
    return df.where(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b)))


def has_value(c) -> Column:
    return F.coalesce(col(c).isNotNull() & (col(c) != "") & (strip_text(c) != ""), F.lit(False))


def keep_rows_with_any_value(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows whose `cols` are all null / empty / blank."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | has_value(c)
    return df.where(cond)


def keep_rows_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C2 counts: one row (kept, dropped) in a single aggregation."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | has_value(c)
    return df.agg(F.sum(cond.cast("long")).alias("kept"), F.sum((~cond).cast("long")).alias("dropped"))


def keep_complete_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both ends neither null nor empty."""
    return df.where(F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != ""))


def filter_contains_any(df: DataFrame, c: str, patterns: Sequence[str]) -> DataFrame:
    """C4: regex contains any pattern; null is dropped."""
    return df.where(F.col(c).rlike("|".join(patterns)))


def filter_letter_codes(df: DataFrame, c: str = "icd9", marker: str = "N") -> DataFrame:
    """Rows whose code starts with a (Unicode) letter other than the marker letter."""
    t = strip_text(c)
    return df.where(t.rlike(r"^\p{L}") & (F.substring(t, 1, 1) != marker))


def filter_region(df: DataFrame, c: str, region: str) -> DataFrame:
    """Case-folded equality (accents kept)."""
    return df.where(upper_text(c) == region.upper())


def exclude_placeholders(df: DataFrame, c: str, placeholders: Sequence[str] = PLACEHOLDER_AREAS) -> DataFrame:
    """After upper-casing, drop placeholder names and null."""
    return df.where(upper_text(c).isNotNull() & ~upper_text(c).isin(*placeholders))


def filter_in_list(df: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    """C8."""
    return df.where(F.col(c).isin(*values))


def drop_unmapped_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C9."""
    return df.dropna(subset=list(cols))


def find_by_key(df: DataFrame, c: str, key: str) -> DataFrame:
    """0..n rows."""
    return df.where(F.col(c) == key)
