"""Sources and sinks (inventory A1-A10).

Readers take explicit schemas (a code such as 295.30 must stay text); writers
always write a new path (an in-place overwrite of the input, as the reference
does, is a write-new-then-swap in Spark).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from dxspark.functions.scalars import col, strip_text


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "|",
                   header: bool = False, usecols: Sequence[str] | None = None, null_mark: str = "",
                   multi_line: bool = False) -> DataFrame:
    """A1: CSV scan with a fixed schema; quotes inside quotes are doubled.

    By default an empty field is null. With the `null_mark` that it was written
    with, only that text is null and empty text stays empty. `multi_line` reads
    values with line breaks; a file is then read by one task."""
    df = (spark.read.schema(schema).option("sep", sep).option("header", header).option("escape", '"')
          .option("nullValue", null_mark).option("emptyValue", "").option("multiLine", multi_line)
          .option("mode", "PERMISSIVE").csv(path))
    if not null_mark:  # quoted empty fields too
        df = df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType == StringType() else F.col(f.name)
                         for f in df.schema.fields])
    return df.select(*usecols) if usecols else df


def _java_quote(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def read_ragged(spark: SparkSession, path: str, names: Sequence[str], sep: str = "|",
                mode: str = "truncate", header: bool = False) -> DataFrame:
    """A2: tolerant scan of lines with a varying field count.

    truncate: extra fields are dropped, missing ones are null.
    skip: lines with *more* fields than `names` are dropped; short lines are
    padded with null (pandas `on_bad_lines='skip'`). The split is naive (no
    quoting), like the reference's line audit. `header` drops the first line of
    each file (and blank lines): the lines are read as a CSV of one column, with
    a separator, U+0001, that text does not hold.
    """
    if header:
        lines = (spark.read.schema("value string").option("sep", "\x01").option("quote", "").option("header", True)
                 .option("enforceSchema", True).csv(path))
    else:
        lines = spark.read.text(path)
    fields = F.split(F.col("value"), _java_quote(sep), -1)
    df = lines.select(fields.alias("_f"))
    if mode == "skip":
        df = df.where(F.size("_f") <= len(names))
    elif mode != "truncate":
        raise ValueError(f"unknown mode {mode}")
    return df.select(*[F.nullif(F.try_element_at("_f", F.lit(i + 1)), F.lit("")).alias(n)
                       for i, n in enumerate(names)])


def text_lines(text) -> Column:
    """Lines of a text as `readlines` gives them (one trailing newline ends the
    last line rather than starting an empty one)."""
    t = col(text)
    t = F.when(t.endswith("\n"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.split(t, "\n", -1)


def audit_ragged_lines(df: DataFrame, id_col: str, text: str, sep: str = ",") -> DataFrame:
    """A3: per document, (line number from 1, field count, stripped line) of the
    lines whose field count differs from the first line's. Row-local: the
    lines of one document are generated and filtered in the same task."""
    lines = df.select(id_col, text_lines(text).alias("_l"))
    hdr = F.size(F.split(strip_text(F.col("_l")[0]), _java_quote(sep), -1))
    ex = lines.select(id_col, hdr.alias("_h"), F.posexplode("_l").alias("_i", "_line"))
    stripped = strip_text("_line")
    n = F.size(F.split(stripped, _java_quote(sep), -1))
    return ex.where(n != F.col("_h")).select(
        id_col, (F.col("_i") + 1).alias("line_no"), n.alias("n_fields"), stripped.alias("line"))


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = True, null_mark: str = "") -> str:
    """A4: CSV without index; values written as they are (no blank trimming).
    Null and empty text are both an empty field unless nulls get a mark."""
    (df.write.mode("errorifexists").option("sep", sep).option("header", header).option("quoteAll", True)
     .option("escape", '"').option("nullValue", null_mark).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def write_partitioned_by_value(df: DataFrame, path: str, key: str, sep: str = "|") -> str:
    """A5: one folder per key value in a single pass; null keys are skipped.

    Rows are rebalanced on the key: small keys share a task, and AQE splits a
    key above the advisory size over as many tasks as its bytes ask for."""
    kept = df.where(F.col(key).isNotNull())
    (kept.hint("rebalance", key).write.mode("errorifexists").partitionBy(key)
     .option("sep", sep).option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def read_partitioned(spark: SparkSession, path: str, schema: StructType, sep: str = "|") -> DataFrame:
    """Read back an A5 folder; the key comes from the path (typed by `schema`)."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("escape", '"').csv(path)


def json_map_entries(df: DataFrame, json_col: str, keep: Sequence[str] = (),
                     key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object column -> one (key, value) row per entry; values as text."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    return df.select(*keep, F.explode(m).alias(key, value))


def read_json_map(spark: SparkSession, path: str, key: str = "code", value: str = "text") -> DataFrame:
    """A6 file form: a JSON object file code -> text as a lookup table; a missing
    path gives an empty table, as in the reference; other errors are raised."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{key} string, {value} string")
    return json_map_entries(raw, "value", key=key, value=value)


PARAM_TYPE = "map<string,map<string,map<string,string>>>"


def param_table(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Nested JSON dataset -> model -> parameter -> value as rows; values stay text."""
    m = F.from_json(F.col(json_col), PARAM_TYPE)
    l1 = df.select(F.explode(m).alias("dataset", "_m"))
    l2 = l1.select("dataset", F.explode("_m").alias("model", "_p"))
    return l2.select("dataset", "model", F.explode("_p").alias("param", "value"))


def read_param_table(spark: SparkSession, path: str) -> DataFrame:
    """A7 file form (one JSON object per line, or one per file with wholetext)."""
    return param_table(spark.read.text(path))


def read_geo_features(spark: SparkSession, path: str, key: str = "COD_POSTAL") -> DataFrame:
    """Features of GeoJSON FeatureCollection files with their key property;
    the geometry is kept as JSON text."""
    fc = spark.read.option("multiLine", True).json(path)
    f = fc.select(F.explode("features").alias("f"))
    return f.select(F.col(f"f.properties.{key}").alias("cod_postal"),
                    F.col("f.properties").alias("properties"),
                    F.to_json(F.col("f.geometry")).alias("geometry"))


def write_text_lines(df: DataFrame, c: Column, path: str) -> str:
    df.select(c.alias("value")).write.mode("errorifexists").text(path)
    return path


def export_metrics(metrics: DataFrame, path: str, dataset: str, metric: str, value: str) -> tuple[str, str]:
    """The metric table as CSV and as nested JSON, one object per dataset:
    {"<dataset>": {"<metric>": value, ...}}. One dataset's metrics are a
    handful of rows, so grouping them per dataset is bounded."""
    csv_path = write_delimited(metrics, path + "/csv", sep=",", header=True)
    nested = metrics.groupBy(dataset).agg(F.map_from_entries(F.collect_list(F.struct(metric, value))).alias("_m"))
    json_path = write_text_lines(nested, F.to_json(F.create_map(F.col(dataset), F.col("_m"))), path + "/json")
    return csv_path, json_path


def export_rejects(rejects: DataFrame, path: str, header: bool = True) -> str:
    """A10: codes without a match, one per line."""
    return write_delimited(rejects, path, sep="|", header=header)
