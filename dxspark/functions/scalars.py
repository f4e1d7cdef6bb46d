"""Column expressions for codes and text (inventory H1-H14).

All are built-in Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two colour-threshold scales of the area maps.
NATIONAL_SCALE = (0, 2, 5, 10, 25, 50, 75, 100, 150, 200, 250, 300)
PROVINCE_SCALE = (0, 1, 2, 5, 10, 25, 50, 75, 100, 150)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters that Python's str.strip() takes off.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_text(c) -> Column:
    """H9: Python-style strip (all leading/trailing whitespace, not just blanks)."""
    return F.btrim(col(c), F.lit(STRIP_CHARS))


def insert_dot(c) -> Column:
    """H1: '29530' -> '295.30'; exactly three characters -> '295.'; shorter unchanged."""
    c = col(c)
    n = F.length(c)
    return (F.when(n > 3, F.concat(c.substr(F.lit(1), F.lit(3)), F.lit("."), c.substr(F.lit(4), n)))
            .when(n == 3, F.concat(c, F.lit(".")))
            .otherwise(c))


def strip_trailing_dot(c) -> Column:
    """H2: a value ending in a dot (+ blanks) loses its trailing dots and blanks."""
    c = col(c)
    return F.when(c.rlike(r"^.+\.\s*$"), F.regexp_replace(c, r"[. ]+$", "")).otherwise(c)


def split_codes_comma(c) -> Column:
    """H3: comma list -> array of stripped codes (null stays null)."""
    return F.transform(F.split(col(c), ","), lambda x: strip_text(x))


def extract_bracket_codes(c) -> Column:
    """H4: contents of every [...] group, stripped."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[([^\[\]]+)\]"), 1), lambda x: strip_text(x))


def starts_upper_letter(c) -> Column:
    return col(c).rlike(r"^\p{Lu}")


def is_icd10(c, in_letter_icd9_list: Column) -> Column:
    """H5: first character an upper-case letter and the code is not one of the
    letter-leading ICD-9 codes (`in_letter_icd9_list` comes from a semi-join flag, D7)."""
    return F.coalesce(starts_upper_letter(c) & ~in_letter_icd9_list, F.lit(False))


def is_icd9_by_letter(c) -> Column:
    """H6: first character is not a letter; null or empty counts as ICD-9."""
    c = col(c)
    return F.when(c.isNull() | (c == ""), F.lit(True)).otherwise(~c.rlike(r"^\p{L}"))


def pad_postal(c, width: int = 5) -> Column:
    """H7: left-pad with zeros like str.zfill (longer values are not cut)."""
    c = col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def upper_text(c) -> Column:
    """H8."""
    return F.upper(col(c))


def lower_text(c) -> Column:
    """H8."""
    return F.lower(col(c))


def is_blankish(c) -> Column:
    """Null, '' or the text 'null'."""
    c = col(c)
    return c.isNull() | c.isin("", "null")


def round_metric(c, digits: int = 4) -> Column:
    """Half-even rounding, as numpy does."""
    return F.bround(col(c), digits)


def bin_frequency(c, scale: Sequence[float] = NATIONAL_SCALE) -> Column:
    """Class of a count on a threshold scale.

    Class i (0-based) means scale[i] <= v < scale[i+1]; the top edge belongs to
    the last class. Below the scale -> -1, above it -> len(scale) - 1, null -> null.
    """
    c = col(c)
    e = F.when(c.isNull(), F.lit(None).cast("int")).when(c < scale[0], F.lit(-1))
    for i in range(len(scale) - 1, 0, -1):
        if i == len(scale) - 1:
            e = e.when(c > scale[i], F.lit(len(scale) - 1)).when(c == scale[i], F.lit(i - 1))
        else:
            e = e.when(c >= scale[i], F.lit(i))
    return e.otherwise(F.lit(0))


def bin_frequency_sql(expr: str, scale: Sequence[float] = NATIONAL_SCALE) -> str:
    """The same ladder as SQL text (for oracles and SQL users)."""
    parts = [f"WHEN {expr} IS NULL THEN NULL", f"WHEN {expr} < {scale[0]} THEN -1"]
    last = len(scale) - 1
    parts.append(f"WHEN {expr} > {scale[last]} THEN {last}")
    parts.append(f"WHEN {expr} = {scale[last]} THEN {last - 1}")
    for i in range(last - 1, 0, -1):
        parts.append(f"WHEN {expr} >= {scale[i]} THEN {i}")
    return "CASE " + " ".join(parts) + " ELSE 0 END"


def parse_vector_literal(c) -> Column:
    """H13: '[0.5, 1.25]' -> array<float>; malformed -> null."""
    return F.from_json(col(c), "array<float>")


def vector_to_literal(c) -> Column:
    """Array -> JSON text; null -> ''."""
    return F.coalesce(F.to_json(col(c)), F.lit(""))


def code_length(c) -> Column:
    """Length of a code, null counted as ''."""
    return F.length(F.coalesce(col(c), F.lit("")))


def code_letter(c) -> Column:
    """First character of a code, null counted as ''."""
    return F.substring(F.coalesce(col(c), F.lit("")), 1, 1)
