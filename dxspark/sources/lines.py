"""Line numbers of text files that many tasks read (inventory A2, A3).

A file is read in splits. Each task numbers the lines of its splits; the splits'
line counts, a row a split, say how many lines stand before each. So a line's
number in its file needs no sort and no file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dxspark.functions.scalars import strip_text
from dxspark.sources.io import _java_quote


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of every line of the text files at `path`."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0  # a split's lines follow each other
        for b in batches:
            if not b.num_rows:
                continue
            names, begins = b.column(1), b.column(2).to_numpy()
            code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(begins) != 0) | (np.diff(code) != 0)) + 1
            local = np.empty(b.num_rows, np.int64)
            for a, e in zip(np.r_[0, new], np.r_[new, b.num_rows], strict=True):
                own = (names[int(a)].as_py(), int(begins[a]))
                at = at if own == split else 0
                split = own
                local[a:e] = np.arange(at + 1, at + 1 + e - a)
                at += int(e - a)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], ["line", "file", "begin", "local"])

    counts = lines.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("file", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = lines.mapInArrow(number, "line string, file string, begin bigint, local bigint")
    return numbered.join(ahead, ["file", "begin"]).select("file", (F.col("ahead") + F.col("local")).alias("line_no"), "line")


def audit_ragged_file(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A3, file form: (file, line_no, n_fields, line stripped) of the lines whose
    field count differs from that of their file's first line."""
    stripped = strip_text("line")
    lines = numbered_lines(spark, path).select("file", "line_no", stripped.alias("line"), F.size(F.split(stripped, _java_quote(sep), -1)).alias("n_fields"))
    first = lines.where("line_no = 1").select("file", F.col("n_fields").alias("_h"))  # a row a file
    return lines.join(first, "file").where(F.col("n_fields") != F.col("_h")).select("file", "line_no", "n_fields", "line")


def read_ragged_numbered(spark: SparkSession, path: str, names: Sequence[str], sep: str = "|", mode: str = "truncate") -> DataFrame:
    """A2 with the place of each row: (file, line_no, names...). Modes as in
    `read_ragged`; numbers count every line of the file, also those left out."""
    rows = numbered_lines(spark, path).withColumn("_f", F.split("line", _java_quote(sep), -1))
    if mode == "skip":
        rows = rows.where(F.size("_f") <= len(names))
    elif mode != "truncate":
        raise ValueError(f"unknown mode {mode}")
    return rows.select("file", "line_no", *[F.nullif(F.try_element_at("_f", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])
