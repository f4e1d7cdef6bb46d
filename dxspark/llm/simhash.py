"""SimHash near-duplicates: positional-byte inverted index, count filter, bit check.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ
in at most `max_bits` = 3 bits differ in at most 3 bytes, so at least
`min_shared` = 5 of their (position, byte) pairs are the same. The inverted
index lists fingerprints under groups of positional bytes; the groups are a
covering design, so that any 5 shared positions contain one of them and no pair
is lost. Within a posting list the shared positional bytes of each pair are
tallied, pairs under the guaranteed minimum dropped, and the rest verified on
their bits. A wider group (3, 4 or 5 bytes) is taken as the number of different
fingerprints grows, which keeps chance meetings in a list rare.

Copies collapse first: one row per different fingerprint is indexed. A posting
list hands on a spanning star of each linked set, not its pairs, so a large
group of near copies costs as many rows as it has members. Lists longer than
`BLOCK` are cut into blocks, and each pair of blocks is a group of its own: no
list is ever held whole by one task, and no partner is left out.

Edge cases: null and empty texts have no shingle and fingerprint zero, linked
like any other. A null doc_id keeps its row; it is not a candidate for the
smallest id. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import connected_components, stored, table

SEED = 42
BLOCK = 4096


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles (repeats count)."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    join, h = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((h(join(w[i:i + size]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", size: int = 3, out: str = "fp") -> DataFrame:
    """`df` with `out` bigint, the SimHash of every row's whole text."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint_of(t.as_py(), size) for t in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def covering(width: int) -> list[tuple[int, ...]]:
    """Groups of `width` positions; any 5 of the 8 positions contain one."""
    left, right = range(4), range(4, 8)
    if width == 3:  # 5 positions leave 3 in one half
        return [*combinations(left, 3), *combinations(right, 3)]
    if width == 4:  # 4+1, or 3+2: three of a half contain one of its two fixed pairs
        fixed = [((0, 1), (2, 3)), ((4, 5), (6, 7))]
        mixed = {a + b for a in fixed[0] for b in combinations(right, 2)} | {a + b for a in combinations(left, 2) for b in fixed[1]}
        return [tuple(left), tuple(right), *sorted(mixed)]
    return list(combinations(range(8), 5))


def index_keys(fp: Column, width: int) -> Column:
    """One bigint key per group of positional bytes."""
    out = []
    for k, group in enumerate(covering(width)):
        key = F.lit(k).cast("bigint")
        for p in group:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
        out.append(key)
    return F.array(*out)


def _linked(fp: np.ndarray, max_bits: int, min_shared: int) -> np.ndarray:
    """Which of the fingerprints link, after the tally of shared bytes."""
    m = len(fp)
    ok = np.zeros((m, m), bool)
    step = max(1, (1 << 21) // max(1, m))
    for at in range(0, m, step):
        x = fp[at:at + step, None] ^ fp[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1, dtype=np.uint8)
        i, j = np.nonzero(shared >= min_shared)
        good = np.bitwise_count(x[i, j]) <= max_bits
        ok[at + i[good], j[good]] = True
    return ok


def _stars(fp: np.ndarray, max_bits: int, min_shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each set of fingerprints linked within this list."""
    if len(fp) == 2:
        x = fp[:1] ^ fp[1:]
        near = (x.view(np.uint8) == 0).sum() >= min_shared and int(np.bitwise_count(x)[0]) <= max_bits
        return (fp[1:], fp[:1]) if near else (fp[:0], fp[:0])
    ok = _linked(fp, max_bits, min_shared)
    root = np.arange(len(fp))
    while True:
        new = np.where(ok, root[None, :], len(fp)).min(1)
        new = np.minimum(new, root)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.arange(len(fp))
    return fp[root != own], fp[root[root != own]]


def near_edges(distinct: DataFrame, max_bits: int = 3, width: int = 3) -> DataFrame:
    """Edges (`a`, `b`) whose components are those of all linked pairs.

    distinct: one bigint column `fp`, without repeats.
    """
    min_shared = 8 - max_bits
    lists = distinct.select("fp", F.explode(index_keys(F.col("fp"), width)).alias("key"))
    long = lists.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (lists.join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(1)) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(rows)]
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                x, y = _stars(np.unique(rows[s:e, 3]).view(np.uint64), max_bits, min_shared)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            rows = np.concatenate([*held, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from flush(rows[:cut])
            held = [rows[cut:]]
        if held and len(held[0]):
            yield from flush(held[0])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint")


def linked_classes(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(`fp`, `root`) of every fingerprint in `distinct` (column `fp`, no repeats)."""
    if max_bits != 3:
        raise ValueError("the covering groups are for 3 bits")
    n = distinct.count()
    width = 3 if n < 1 << 22 else 4 if n < 1 << 31 else 5
    roots = connected_components(near_edges(distinct.select("fp"), max_bits, width))
    return distinct.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3) -> DataFrame:
    """(id_col, `fingerprint` 16 hex digits, `component_id`): one row per row."""
    marks = stored(with_fingerprint(docs.select(id_col, F.col(f"`{text_col}`").cast("string").alias(text_col)), text_col, size).drop(text_col), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct_fp")
    named = linked_classes(distinct, max_bits).join(distinct, "fp")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = stored(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "labels")
    return marks.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each class of `docs`, with all its columns: that of the
    smallest id, null last, then of the smallest text hash; of equal rows one.

    Rows get a number when they are written with their fingerprints; the classes
    and their best row are found on (id, fingerprint, number) alone, and the
    texts are joined once, by that number, of which no two rows have the same.
    """
    fp, row = (next(c for c in (k + "_" * i for i in range(len(docs.columns) + 1)) if c not in docs.columns) for k in ("fp", "_row"))
    marked = stored(with_fingerprint(docs, text_col, size, fp).withColumn(row, F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"), F.col(row).alias("row"))
    best = stored(marked.select(F.col(fp).alias("fp"), order.alias("best")).groupBy("fp").agg(F.min("best").alias("best")), "distinct_fp")
    winners = linked_classes(best, max_bits).join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return marked.join(winners, row, "left_semi").drop(fp, row)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))
