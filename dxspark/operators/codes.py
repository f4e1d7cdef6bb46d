"""Code-standardisation jobs (inventory I1-I10) over a crosswalk dictionary
`(ord, icd9, icd10, description)`; `icd9 = 'NN'` means "no ICD-9".

Shape of every job: explode the codes of a row with their position, reduce
them to the *distinct* codes, resolve those through the variant indexes (D5:
one equi-join on the stem, no per-code probing) into a fact table, join the
facts back once, and re-collect per row (each row holds a bounded list of
codes). The large table is shuffled for the distinct step, the join back and
the regroup; every other shuffle is over dictionary- or distinct-code-sized
tables. Columns that are not codes ride on the first cell of their row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxspark.functions.scalars import (
    extract_bracket_codes, insert_dot, is_blankish, is_icd9_by_letter, split_codes_comma,
    starts_upper_letter, strip_trailing_dot,
)
from dxspark.operators.lookup import (
    first_row_per_key, lookup_with_cache_default, membership_flag, rekeyed,
    resolve_variants, variant_index,
)
from dxspark.operators.reshape import DEFAULT_DESCRIPTION, filter_letter_codes
from dxspark.operators.vectors import term_vectors

# Texts the reference writes for misses.
NOT_FOUND_DESCRIPTION = "Descripcion no encontrada #"
NOT_FOUND_TARGET = "No encontrado"
NO_ENGLISH_TEXT = "Descripción no disponible"
NO_ICD9 = "NN"


# ------------------------------------------------------------ indexes

def icd9_to_icd10_index(crosswalk: DataFrame) -> DataFrame:
    return variant_index(crosswalk, "icd9", "icd10")


def icd10_to_icd9_index(crosswalk: DataFrame) -> DataFrame:
    """Entries whose first row says 'NN' are skipped."""
    return variant_index(crosswalk, "icd10", "icd9", guard=F.col("icd9") != NO_ICD9)


def description_index(crosswalk: DataFrame) -> DataFrame:
    """Entries whose first row has no text are skipped."""
    return variant_index(crosswalk, "icd10", "description", guard=F.col("description").isNotNull())


def letter_icd9_codes(crosswalk: DataFrame) -> DataFrame:
    """ICD-9 codes that start with a letter (so that a leading letter alone does
    not make a code ICD-10)."""
    return filter_letter_codes(crosswalk, "icd9").select("icd9").distinct()


def with_variant(df: DataFrame, code: str, index: DataFrame, out: str) -> DataFrame:
    """Attach the variant-resolved value of `code` (null on a miss)."""
    hits = resolve_variants(df, code, index)
    return df.join(rekeyed(hits, "_code", "_key"), F.col(code) == F.col("_key"), "left").drop("_key", "_pri") \
        .withColumnRenamed("_value", out)


def with_english(df: DataFrame, code: str, crosswalk: DataFrame, cache: DataFrame | None, out: str) -> DataFrame:
    """English text chain (D9): cache, exact, first key with this prefix, default."""
    if cache is None:
        cache = crosswalk.sparkSession.createDataFrame([], "code string, text string")
    return lookup_with_cache_default(df, code, cache, "code", "text", crosswalk, "icd10", "description",
                                     NO_ENGLISH_TEXT, out)


def code_facts(long: DataFrame, code: str, crosswalk: DataFrame) -> DataFrame:
    """(code, to10, to9) for the distinct codes of `long`: both variant lookups
    run on the distinct set, so the long table is joined back only once."""
    d = long.select(F.col(code).alias("code")).where(F.col("code").isNotNull()).distinct()
    # both directions in one join: the two stem indexes are stacked with a tag,
    # and one aggregation keeps the best hit per direction (min_by skips the
    # rows whose ordering is null, i.e. the other direction's)
    idx = icd9_to_icd10_index(crosswalk).withColumn("_dir", F.lit(10)).unionByName(
        icd10_to_icd9_index(crosswalk).withColumn("_dir", F.lit(9)))
    hits = d.join(idx, F.col("code") == F.col("stem")).groupBy("code").agg(
        F.min_by("value", F.when(F.col("_dir") == 10, F.col("pri"))).alias("to10"),
        F.min_by("value", F.when(F.col("_dir") == 9, F.col("pri"))).alias("to9"))
    return d.join(hits, "code", "left")


def description_facts(codes: DataFrame, crosswalk: DataFrame, cache: DataFrame | None) -> DataFrame:
    """(dcode, es, en) for a distinct set of codes (column `dcode`)."""
    es = resolve_variants(codes, "dcode", description_index(crosswalk)).select(
        F.col("_code").alias("dcode"), F.col("_value").alias("_es"))
    out = codes.join(es, "dcode", "left").withColumn("_es", F.coalesce("_es", F.lit(NOT_FOUND_DESCRIPTION)))
    return with_english(out, "dcode", crosswalk, cache, "_en")


def _with_facts(long: DataFrame, crosswalk: DataFrame, cache: DataFrame | None, dcode: Column) -> DataFrame:
    """Attach to10 / to9 / dcode / es / en to the long table with two joins on
    distinct-sized fact tables. The universe of description codes is the codes
    themselves plus their ICD-10 conversions, so it comes from the facts table."""
    # the facts table feeds three branches; their identical shuffle subtrees are
    # planned once and reused (ReusedExchange), so the input is not re-exploded
    facts = code_facts(long, "code", crosswalk)
    universe = facts.select(F.col("code").alias("dcode")).unionByName(
        facts.select(F.coalesce("to10", F.lit("")).alias("dcode"))).distinct()
    dfacts = description_facts(universe, crosswalk, cache)
    found = rekeyed(facts.withColumnsRenamed({"to10": "_to10", "to9": "_to9"}), "code", "_key")
    out = long.join(found, F.col("code") == F.col("_key"), "left").drop("_key").withColumn("_dcode", dcode)
    return out.join(rekeyed(dfacts, "dcode", "_key"), F.col("_dcode") == F.col("_key"), "left").drop("_key")


def _join_list(arr: Column, field: str, sep: str = ", ", keep_empty: bool = False) -> Column:
    xs = F.transform(F.array_sort(arr), lambda x: x[field])
    if not keep_empty:
        xs = F.filter(xs, lambda v: v.isNotNull() & (v != ""))
    return F.array_join(xs, sep)


def _first_by_key(arr: Column, key: str) -> Column:
    """Keep the first element (in position order) of every distinct `key` - the
    order a Python dict gives. Lists are per row and short."""
    s = F.array_sort(arr)
    return F.filter(s, lambda x, i: ~F.exists(F.slice(s, 1, i), lambda y: y[key] == x[key]))


def _strip_trailing_sep(c: Column) -> Column:
    """The reference trims the joined text with rstrip(', ')."""
    return F.regexp_replace(c, r"[, ]+$", "")


# ------------------------------------------------------------ I1

def clean_crosswalk(undotted: DataFrame, described: DataFrame) -> DataFrame:
    """Undotted (icd9, icd10) -> dotted -> trailing dots removed -> described
    on both keys (default text), columns ICD9, ICD10, Description."""
    cleaned = undotted.select(strip_trailing_dot(insert_dot("icd9")).alias("icd9"),
                              strip_trailing_dot(insert_dot("icd10")).alias("icd10"))
    desc = described.select("icd9", "icd10", "description")
    return (cleaned.join(desc, ["icd9", "icd10"], "left")
            .select(F.col("icd9").alias("ICD9"), F.col("icd10").alias("ICD10"),
                    F.coalesce("description", F.lit(DEFAULT_DESCRIPTION)).alias("Description")))


# ------------------------------------------------------------ I2

def _cells(wide: DataFrame, row_key: str, cols: Sequence[str], others: Sequence[str]) -> DataFrame:
    """(row_key, _h, pos from 0, code, _o): one row per cell of `cols`. `_h` is a
    hash of the whole row, so that rows that share a key are not mixed; the
    columns `others` ride on the first cell only."""
    h = F.xxhash64(*[x for c in wide.columns for x in (F.col(c), F.col(c).isNull())])
    other = F.struct(*[F.col(c) for c in others])
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("code"),
                               (other if i == 0 else F.lit(None)).alias("_o")) for i, c in enumerate(cols)])
    return wide.select(F.col(row_key).alias("_key"), h.alias("_h"), F.inline(cells))


def _rows(cells: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """The rows of `_cells` again, equal ones as often as they were."""
    n = F.count_if(F.col("pos") == 0).alias("_n")
    out = cells.groupBy("_key", "_h").agg(*aggs, F.first("_o", ignorenulls=True).alias("_o"), n)
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("*", "_o.*")


def standardise_row_codes(wide: DataFrame, row_key: str, code_cols: Sequence[str], target: str,
                          crosswalk: DataFrame) -> DataFrame:
    """In rows whose target is ICD-9 (H6), every code cell becomes ICD-10:
    null stays null, '' / 'null' -> '', ICD-10 codes stay, others go through
    the ICD-9 -> ICD-10 variant lookup; a miss becomes ''. Other rows untouched.
    Keys may repeat or be null; equal rows stay as many."""
    flagged = wide.withColumn("_icd9row", is_icd9_by_letter(target))
    keep = flagged.where(~F.col("_icd9row")).drop("_icd9row")
    todo = flagged.where(F.col("_icd9row")).drop("_icd9row")
    others = [c for c in wide.columns if c not in code_cols]
    long = _cells(todo, row_key, code_cols, others)
    long = membership_flag(long, "code", letter_icd9_codes(crosswalk), "icd9", "_letter9")
    needs = long.where(F.col("code").isNotNull() & ~is_blankish("code")
                       & ~(starts_upper_letter("code") & ~F.col("_letter9")))
    hits = rekeyed(resolve_variants(needs, "code", icd9_to_icd10_index(crosswalk)), "_code", "_code")
    conv = long.join(hits, F.col("code") == F.col("_code"), "left").select(
        "_key", "_h", "_o", "pos",
        F.when(F.col("code").isNull(), F.lit(None))
         .when(is_blankish("code"), F.lit(""))
         .when(starts_upper_letter("code") & ~F.col("_letter9"), F.col("code"))
         .otherwise(F.coalesce("_value", F.lit(""))).alias("code"))
    converted = _rows(conv, [F.max(F.when(F.col("pos") == i, F.col("code"))).alias(c) for i, c in enumerate(code_cols)])
    return converted.select(*wide.columns).unionByName(keep)


# ------------------------------------------------------------ I3 / I4 / I6

def _row_kind(visits: DataFrame, target: str, crosswalk: DataFrame) -> DataFrame:
    """H5 on the whole target text: ICD-10 row iff it starts with an upper-case
    letter and is not a letter-leading ICD-9 code."""
    v = membership_flag(visits, target, letter_icd9_codes(crosswalk), "icd9", "_letter9")
    return v.withColumn("_is10", F.coalesce(starts_upper_letter(target) & ~F.col("_letter9"), F.lit(False))) \
        .drop("_letter9")


def expand_target_codes(visits: DataFrame, row_key: str, target: str, crosswalk: DataFrame,
                        cache: DataFrame | None = None) -> DataFrame:
    """From a comma list of target codes, the ICD-10 list, the ICD-9 list and
    the Spanish / English description lists, converting in the direction given
    by the row's version. The source-version list is kept as written. Lists are
    made once for each different text, so keys may repeat or be null; a row a row."""
    v = _row_kind(visits.where(F.col(target).isNotNull()), target, crosswalk)
    texts = v.select(F.col(target).alias("_list"), "_is10").distinct()
    long = texts.select("_list", "_is10", F.posexplode(split_codes_comma("_list")).alias("pos", "code"))
    long = _with_facts(long, crosswalk, cache,
                       F.when(F.col("_is10"), F.col("code")).otherwise(F.coalesce("_to10", F.lit(""))))
    item = F.struct("pos", F.coalesce("_to10", F.lit("")).alias("to10"), F.coalesce("_to9", F.lit("")).alias("to9"),
                    F.col("_es").alias("es"), F.col("_dcode").alias("dcode"), F.col("_en").alias("en"))
    per = rekeyed(long.groupBy("_list").agg(F.collect_list(item).alias("_l")), "_list", "_list")
    out = v.select(row_key, target, "_is10").join(per, F.col(target) == F.col("_list"), "left")
    return out.select(
        row_key,
        F.when(F.col("_is10"), F.col(target)).otherwise(_join_list(F.col("_l"), "to10")).alias("icd10_list"),
        F.when(F.col("_is10"), _join_list(F.col("_l"), "to9")).otherwise(F.col(target)).alias("icd9_list"),
        _strip_trailing_sep(_join_list(F.col("_l"), "es", keep_empty=True)).alias("descripcion_es"),
        F.array_join(F.transform(_first_by_key(F.col("_l"), "dcode"), lambda x: x["en"]), ", ").alias("descripcion_en"))


def expand_bracket_codes(visits: DataFrame, row_key: str, target: str, codes_col: str,
                         crosswalk: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """I4: the same for '[code] x [code]' groups. ICD-9 rows keep only the codes
    that convert (as '[X]'); ICD-10 rows write '[NN]' for codes without ICD-9.
    Keys may repeat or be null."""
    v = _row_kind(visits.where(F.col(target).isNotNull()), target, crosswalk)
    texts = v.select(F.col(codes_col).alias("_list"), F.col("_is10").alias("_kind")).where("_list IS NOT NULL").distinct()
    long = texts.select("_list", "_kind", F.col("_kind").alias("_is10"), F.posexplode(extract_bracket_codes("_list")).alias("pos", "code"))
    # ICD-9 rows describe only converted codes; ICD-10 rows every code.
    long = _with_facts(long, crosswalk, cache,
                       F.when(F.col("_is10"), F.col("code"))
                        .when(F.col("_to10").isNotNull() & (F.col("_to10") != ""), F.col("_to10")))
    bracket10 = F.when(F.col("_to10").isNotNull() & (F.col("_to10") != ""), F.concat(F.lit("["), "_to10", F.lit("]")))
    bracket9 = F.when(F.col("_to9").isNotNull() & (F.col("_to9") != ""), F.concat(F.lit("["), "_to9", F.lit("]"))) \
        .otherwise(F.lit(f"[{NO_ICD9}]"))
    item = F.struct("pos", bracket10.alias("to10"), bracket9.alias("to9"),
                    F.when(F.col("_dcode").isNotNull(), F.col("_es")).alias("es"),
                    F.col("_dcode").alias("dcode"), F.when(F.col("_dcode").isNotNull(), F.col("_en")).alias("en"))
    per = rekeyed(long.groupBy("_list", "_kind").agg(F.collect_list(item).alias("_l")), "_list", "_list")
    out = v.select(row_key, codes_col, "_is10").join(per, (F.col(codes_col) == F.col("_list")) & (F.col("_is10") == F.col("_kind")), "left")
    described = F.filter(F.array_sort(F.col("_l")), lambda x: x["dcode"].isNotNull())
    return out.select(
        row_key,
        F.when(F.col("_is10"), F.col(codes_col)).otherwise(_join_list(F.col("_l"), "to10")).alias("icd10_list"),
        F.when(F.col("_is10"), _join_list(F.col("_l"), "to9")).otherwise(F.col(codes_col)).alias("icd9_list"),
        _strip_trailing_sep(F.array_join(F.transform(described, lambda x: x["es"]), ", ")).alias("descripcion_es"),
        F.array_join(F.transform(_first_by_key(described, "dcode"), lambda x: x["en"]), ", ").alias("descripcion_en"))


def describe_code_list(visits: DataFrame, row_key: str, target: str, crosswalk: DataFrame) -> DataFrame:
    """Comma list -> descriptions (variant lookup) joined by ', ';
    a miss becomes 'Descripcion no encontrada #'. Keys may repeat or be null."""
    rows = visits.where(F.col(target).isNotNull()).select(row_key, target)
    texts = rows.select(F.col(target).alias("_list")).distinct()
    long = texts.select("_list", F.posexplode(split_codes_comma("_list")).alias("pos", "code"))
    long = with_variant(long, "code", description_index(crosswalk), "_es") \
        .withColumn("_es", F.coalesce("_es", F.lit(NOT_FOUND_DESCRIPTION)))
    per = long.groupBy("_list").agg(F.collect_list(F.struct("pos", F.col("_es").alias("es"))).alias("_l"))
    per = per.select("_list", _strip_trailing_sep(_join_list(F.col("_l"), "es", keep_empty=True)).alias("descriptions"))
    return rows.join(rekeyed(per, "_list", "_list"), F.col(target) == F.col("_list")).select(row_key, "descriptions")


# ------------------------------------------------------------ I5

def describe_codes(wide: DataFrame, row_key: str, code_cols: Sequence[str], target: str,
                   crosswalk: DataFrame, keep_codes: bool = False) -> DataFrame:
    """Every code cell -> its first exact description (null for null, '',
    'null' and misses); the target -> its description or 'No encontrado'.
    The target is position 0 of the same long table, so all cells are
    described by one join and re-collected by one aggregation; keys may repeat
    or be null, and equal rows stay as many. `keep_codes` also returns the raw
    cell codes as `_c_<column>` (for combining without a join)."""
    first = first_row_per_key(crosswalk, "icd10", ["description"]).select(
        F.col("icd10").alias("_k"), F.col("description").alias("_d"), F.lit(True).alias("_hit"))
    others = [c for c in wide.columns if c not in code_cols and c != target]
    long = _cells(wide, row_key, [target, *code_cols], others)
    described = long.join(rekeyed(first, "_k", "_k"), F.col("code") == F.col("_k"), "left")
    cell = F.when(~is_blankish("code"), F.col("_d"))
    tgt = F.when(F.col("_hit"), F.col("_d")).otherwise(F.lit(NOT_FOUND_TARGET))
    out = _rows(described, [
        F.max(F.when(F.col("pos") == 0, F.struct(tgt.alias("v")))).alias("_t"),
        *[F.max(F.when(F.col("pos") == i, cell)).alias(c) for i, c in enumerate(code_cols, 1)],
        *([F.max(F.when(F.col("pos") == i, F.col("code"))).alias(f"_c_{c}") for i, c in enumerate(code_cols, 1)]
          if keep_codes else [])])
    out = out.withColumn(target, F.col("_t.v"))
    return out.select(*wide.columns, *([f"_c_{c}" for c in code_cols] if keep_codes else []))


def describe_rejects(wide: DataFrame, code_cols: Sequence[str], crosswalk: DataFrame,
                     out: str = "codigo_perdido") -> DataFrame:
    """I5 / A10 rejects: distinct non-blank cell codes without an exact entry."""
    cells = F.array(*[F.col(c) for c in code_cols])
    codes = wide.select(F.explode(cells).alias(out)).where(~is_blankish(out))
    keys = crosswalk.select(F.col("icd10").alias("_k")).where(F.col("_k").isNotNull())
    return codes.join(keys, F.col(out) == F.col("_k"), "left_anti").distinct()


# ------------------------------------------------------------ I7 / I8

def build_code_master(codes: DataFrame, code: str, crosswalk: DataFrame,
                      cache: DataFrame | None = None) -> DataFrame:
    """Per distinct code its Spanish term, ICD-9 and English term from the
    first dictionary row; misses (and nulls) become ''."""
    first = first_row_per_key(crosswalk, "icd10", ["description", "icd9"]).select(
        F.col("icd10").alias("_k"), "description", "icd9", F.lit(True).alias("_hit"))
    d = codes.select(F.col(code).alias("icd10")).distinct().join(first, F.col("icd10") == F.col("_k"), "left")
    d = with_english(d, "icd10", crosswalk, cache, "_en")
    return d.select(F.coalesce("description", F.lit("")).alias("termino_es"), "icd10",
                    F.coalesce("icd9", F.lit("")).alias("icd9"),
                    F.when(F.col("_hit"), F.col("_en")).otherwise(F.lit("")).alias("termino_in"))


def code_master_with_vectors(codes: DataFrame, code: str, crosswalk: DataFrame, cache: DataFrame | None = None,
                             k: int = 64) -> DataFrame:
    """I7 with its vector column: `vector` of the Spanish term, of unit length;
    zeros for codes without a term."""
    master = build_code_master(codes, code, crosswalk, cache).checkpoint()
    vectors = rekeyed(term_vectors(master, "termino_es", k), "termino_es", "_term")
    return master.join(vectors, F.col("termino_es") == F.col("_term"), "left").drop("_term")


def build_pairs(wide: DataFrame, code_cols: Sequence[str], target: str, names: DataFrame,
                key: str, name: str) -> DataFrame:
    """I8: (diagnosis name, psychiatric diagnosis name) pairs: complete,
    distinct, self pairs removed."""
    cells = F.array(*[F.col(c) for c in code_cols])
    # the result is a set, so code pairs are made distinct (map-side) before naming
    pairs = wide.where(F.col(target).isNotNull() & (F.col(target) != "")) \
        .select(F.explode(cells).alias("d"), F.col(target).alias("p")) \
        .where(F.col("d").isNotNull() & (F.col("d") != "")).distinct()
    na = names.select(F.col(key).alias("_ka"), F.col(name).alias("nombre_diagnostico"))
    nb = names.select(F.col(key).alias("_kb"), F.col(name).alias("nombre_diagnostico_psiquiatrico"))
    named = pairs.join(na, F.col("d") == F.col("_ka"), "left").join(nb, F.col("p") == F.col("_kb"), "left")
    a, b = "nombre_diagnostico", "nombre_diagnostico_psiquiatrico"
    out = named.select(a, b).where(F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != ""))
    return out.distinct().where(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b)))


# ------------------------------------------------------------ I9

def build_binary_dataset(wide: DataFrame, row_key: str, code_cols: Sequence[str], target: str,
                         crosswalk: DataFrame, targets: Sequence[str] = ("F20", "F20.89"),
                         leak_patterns: Sequence[str] = ("F20.89", "F20.0"),
                         variant: str = "combined") -> DataFrame:
    """Keep target rows, mask leaking codes, drop rows without codes, then
    the codes / descriptions / combined ('code: description') variant."""
    from dxspark.operators.reshape import combine_code_desc, filter_contains_any, has_value
    base = filter_contains_any(wide, target, list(targets))
    # one array column: with a filter over twenty computed columns the optimizer
    # rewrites the condition for every subset of them
    leaks = "|".join(f"(?:{p})" for p in leak_patterns)
    masked = F.transform(F.array(*[F.col(c) for c in code_cols]), lambda x: F.when(~x.rlike(leaks), x))
    base = base.select(row_key, target, masked.alias("_codes")).where(F.exists("_codes", has_value))
    base = base.select(row_key, target, *[F.col("_codes")[i].alias(c) for i, c in enumerate(code_cols)])
    if variant == "codes":
        return base
    if variant == "descriptions":
        return describe_codes(base, row_key, code_cols, target, crosswalk)
    both = describe_codes(base.withColumn("_target", F.col(target)), row_key, code_cols, target, crosswalk,
                          keep_codes=True)
    return both.select(row_key, F.col("_target").alias(target),
                       *[combine_code_desc(f"_c_{c}", c).alias(c) for c in code_cols])
