"""Mixing sources to target weights: hash keys, ranges, prefix sums, exact cuts.

Every row gets a hash-random key. Within a source the rows are ranged by the
key: the leading bits of the key give its range, ranges are as many as keep one
range of the largest source at about `RANGE_ROWS` rows, rows are sorted inside
their range, and the ranges' word totals are summed up over the source. That
gives each row the exact number of words before it, with no task holding a
source. A source's budget is some whole epochs and a rest; the epochs take every
row, and the rest takes rows in key order up to the cut. Documents are never
cut: the one across the cut goes in if that comes nearer the target.

Targets: sources in code point order, null last, weigh 3, 1, 2, 3, 1, 2, ...
(or given weights) and share `share` times all words; a target stops at `most`
times its source's words, and what is over goes to the others by weight until
none is above. The sources' totals, one row for each source, go through the
driver; more than `MAX_SOURCES` raise an error.

Edge cases: a null text has size 0; a source of no words has target 0; null is
a source of its own; rows of one key are ordered by id, size and checksum, and
equal rows are interchangeable but counted one by one; an empty table gives an
empty result; input columns named as result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dxspark.llm.common import n_words, stored, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
RANGE_ROWS = 1 << 12
MAX_SOURCES = 1_000_000
MADE = {"size", "source_size", "target", "taken", "copies"}


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's words, filled by weight with none above `most` times it."""
    rest, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [k for k, (s, w) in enumerate(zip(sizes, weights, strict=True)) if s > 0 and w > 0]
    while open_:
        weight = sum(weights[k] for k in open_)
        full = {k for k in open_ if rest * weights[k] / weight > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = rest * weights[k] / weight
            break
        for k in full:
            out[k] = most * sizes[k]
        rest -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None,
        share: float = SHARE, most: float = MOST, seed: int = 7, keep_text: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`docs` with size, source_size, target, copies (times the row is taken)
    and taken (words). weights: by source; else 3, 1, 2 in code point order."""
    spark = docs.sparkSession
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in MADE and (keep_text or c != text_col)]
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    sized = stored(docs.select(
        *kept, n_words(text).cast("bigint").alias("size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_s"),  # null is a key of its own
        F.struct(F.xxhash64(F.lit(seed), f"`{id_col}`").alias("key"), F.col(f"`{id_col}`").alias("id"),
                 F.octet_length(text).alias("n"), F.crc32(text).alias("crc")).alias("_order")), "mixing")
    totals = sized.groupBy("_s").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r[0] == "", r[0].encode()))
    given = [WEIGHTS[k % len(WEIGHTS)] if weights is None else float(weights.get(r[0][1:] if r[0] else None, 0)) for k, r in enumerate(totals)]
    goal = targets([r[1] for r in totals], given, share, most)
    plan = [(r[0], r[1], float(t), int(t // r[1]) if r[1] else 0) for r, t in zip(totals, goal, strict=True)]
    sources = spark.createDataFrame(plan, "_s string, source_size bigint, target double, _epochs int")
    bits = (max([r[2] for r in totals], default=0) // range_rows).bit_length()
    place = F.shiftright(F.col("_order.key"), 64 - bits) if bits else F.lit(0).cast("bigint")
    ranged = sized.withColumn("_range", place)
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("_s", "_range").agg(F.sum("size").alias("n"))
              .select("_s", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")).join(sources, "_s"))
    upto = F.sum("size").over(Window.partitionBy("_s", "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.col("_start") + F.col("_upto") - F.col("size")
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    return (ranged.withColumn("_upto", upto).join(starts, ["_s", "_range"])
            .withColumn("copies", F.col("_epochs") + (ahead + F.col("size") / 2 < rest).cast("int"))
            .select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")
