"""Uniform shuffle into shards of exact sizes by a hypergeometric matrix.

Row i of the communication matrix says how many rows source partition i sends
to each block of each shard. A uniformly random permutation of all rows has
these counts distributed as multivariate hypergeometric draws without
replacement from the blocks' exact capacities. The matrix is never built: it is
a binary tree over the partitions whose nodes draw the left half's share, with
a generator seeded by (seed, node), so that each task draws just its own row in
O(blocks * log partitions) and every retry draws the same one.

Each partition permutes its rows locally over the blocks it was dealt; the rows
are exchanged by block; each block permutes again, by random 64-bit keys. A
block has at most `block_rows` rows, so no task holds a shard, and a row's slot
is its block's fixed offset plus its place in the block. Shard sizes differ by
one at most (law `rows`) and slots have no gap.

The two scans must see the same partitions; each task compares its number of
rows with the first count and fails otherwise. A table read from files gives
the same partitions; for anything else pass `stored(df, ...)`.

Edge cases: null texts have size 1 and checksum 0; repeated rows are dealt one
by one; fewer rows than shards leave shards empty; an empty table gives an empty
result; input columns named as result columns are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import table

N_SHARDS = 16
BLOCK_ROWS = 1 << 16
_EXACT = 900_000_000  # numpy's generator draws up to about 1e9 in all


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows out of good + bad are good."""
    if good + bad <= _EXACT:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = _log_choose(good, mode) + _log_choose(bad, draws - mode)
    total = good + bad
    width = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) + 1
    while True:  # ratio of uniforms around the mode; 3 widths of hat suffice for a log-concave law
        u, v = rng.random(), (rng.random() - 0.5) * 6 * width
        x = math.floor(mode + v / max(u, 1e-300) + 0.5)
        if lo <= x <= hi and 2 * math.log(max(u, 1e-300)) <= _log_choose(good, x) + _log_choose(bad, draws - x) - top:
            return x


def deal(rng: np.random.Generator, capacity: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw, one colour after another."""
    if capacity.sum() <= _EXACT:
        return rng.multivariate_hypergeometric(capacity, draws, method="marginals")
    out, rest = np.zeros_like(capacity), int(capacity.sum())
    for k, c in enumerate(capacity):
        rest -= int(c)
        out[k] = hypergeometric(rng, int(c), rest, draws)
        draws -= int(out[k])
    return out


def matrix_row(sizes: np.ndarray, capacity: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix, whose rows sum to `sizes` and
    columns to `capacity`."""
    before = np.r_[0, sizes.cumsum()]
    lo, hi, left = 0, len(sizes), capacity.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = deal(rng, left, int(before[mid] - before[lo]))
        lo, hi, left = (lo, mid, first) if part < mid else (mid, hi, left - first)
    return left


def shard_rows(df: DataFrame, n_shards: int = N_SHARDS, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with `shard` (int) and `slot` (bigint, gapless from 0 in each shard)."""
    made = {"shard", "slot", "_block", "_key"}
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in made])
    n_parts = df.rdd.getNumPartitions()
    counts = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    sizes = np.zeros(max([n_parts, *(r["p"] + 1 for r in counts)]), np.int64)
    for r in counts:
        sizes[r["p"]] = r["count"]
    total = int(sizes.sum())
    of_shard = total // n_shards + (np.arange(n_shards) < total % n_shards)
    n_blocks = np.maximum(1, -(-of_shard // block_rows))
    shard = np.repeat(np.arange(n_shards), n_blocks)
    nth = np.arange(len(shard)) - np.repeat(n_blocks.cumsum() - n_blocks, n_blocks)
    # of a shard's rows, block j gets those from n*j//b to n*(j+1)//b
    begin = of_shard[shard] * nth // n_blocks[shard]
    capacity = of_shard[shard] * (nth + 1) // n_blocks[shard] - begin
    sent = df.sparkSession.sparkContext.broadcast((sizes, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, capacity = sent.value
        part, at, labels, rng = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            if labels is None:
                rng = np.random.default_rng([seed, part])
                labels = np.repeat(np.arange(len(capacity)), matrix_row(sizes, capacity, part, seed)) if part < len(sizes) else np.zeros(0, np.int64)
                rng.shuffle(labels)
            if at + b.num_rows > len(labels):
                break
            own = labels[at:at + b.num_rows]
            key = rng.integers(-1 << 63, (1 << 63) - 1, b.num_rows, np.int64)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(key)], [*b.schema.names, "_block", "_key"])
        if labels is not None and at != len(labels):
            raise RuntimeError(f"partition {part} has other rows than when it was counted; pass a stored table")

    schema = T.StructType([*df.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = df.mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_key")).cast("bigint")
    blocks = df.sparkSession.createDataFrame([(k, int(s), int(o)) for k, (s, o) in enumerate(zip(shard, begin, strict=True))], "_block int, shard int, _begin bigint")
    return (dealt.withColumn("slot", place).join(F.broadcast(blocks), "_block") if len(shard) <= 1 << 20 else dealt.withColumn("slot", place).join(blocks, "_block")) \
        .withColumn("slot", F.col("slot") - 1 + F.col("_begin")).select(*[f"`{c}`" for c in df.columns], "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
