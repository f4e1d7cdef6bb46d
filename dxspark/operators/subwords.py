"""Sub-word tokens (inventory J8): byte pairs merged by the ranks of a vocabulary.

The vocabulary is a rank file of a public tokenizer (a line a token: its bytes in
base64, and its rank), whose path is an argument. A text is split by the
vocabulary's pattern; the bytes of each piece are joined pair by pair, the pair of
lowest rank first, until no pair is in the vocabulary. Every single byte is in it,
so any text has tokens and tokens give the text back.

A text is tokenised in one pass over its table; texts are dealt out first where
fewer tasks read them than can run at once, and nothing else is shuffled. The vocabulary is read by Spark and sent to the tasks after its size is checked,
and a task keeps the tokens of frequent pieces at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.session import to_all_tasks

# Fixed value: the pattern that goes with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tokens of a vocabulary at most; pieces that a task keeps at hand
LARGEST, PIECES = 2_000_000, 1 << 18


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary at `path`; more than LARGEST tokens are an error."""
    lines = spark.read.text(path).where("value <> ''").select(F.split("value", " ").alias("p"))
    rows = lines.select(F.unbase64(F.col("p")[0]).alias("b"), F.col("p")[1].cast("int").alias("rank")).limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"vocabulary: more than {LARGEST} tokens")
    return {bytes(r["b"]): r["rank"] for r in rows}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts, none = [piece[k:k + 1] for k in range(len(piece))], 1 << 60
    rank = ranks.get
    of = [rank(piece[k:k + 2], none) for k in range(len(piece) - 1)]  # rank of each part joined with the next
    while of:
        best = min(of)
        if best == none:
            break
        at = of.index(best)
        pair, places = parts[at] + parts[at + 1], [at]
        if of.count(best) > 1:  # every place of that pair, from the left
            for k in range(at + 2, len(of)):
                if of[k] == best and k > places[-1] + 1 and parts[k] + parts[k + 1] == pair:
                    places.append(k)
        for k in reversed(places):
            parts[k:k + 2] = [pair]
            del of[k]
        for j, k in enumerate(places):
            k -= j
            if k < len(of):
                of[k] = rank(pair + parts[k + 1], none)
            if k:
                of[k - 1] = rank(parts[k - 1] + pair, none)
    return [ranks[p] for p in parts]


class _Pieces(dict):
    """Tokens of the pieces seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= PIECES:
            self.clear()
        own = self[piece] = merged(piece.encode(), self.ranks)
        return own


def sent_ranks(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(spark, path))


def subword_ids(df: DataFrame, id_col: str, text: str, ranks: Broadcast, max_len: int | None = 128, pad: int = -1,
                pattern: str = PATTERN) -> DataFrame:
    """(id_col, n_tokens, n_kept, ids): the tokens of every text, cut to
    `max_len` and padded to it with `pad`; n_tokens counts those of the whole text
    and n_kept those that are kept. `max_len` None keeps all, without padding. A
    null text has no tokens."""
    rows = to_all_tasks(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, pieces = regex.compile(pattern).findall, _Pieces(ranks.value)
        for b in batches:
            sizes, flat, ends = [], [], [0]
            for t in b.column(1):
                found = [pieces[p] for p in find(t.as_py())]
                sizes.append(sum(map(len, found)))
                own = list(chain.from_iterable(found if max_len is None else found[:max_len]))  # a piece has a token at least
                if max_len is not None:
                    own = own[:max_len] + [pad] * (max_len - len(own))
                flat.append(np.array(own, np.int32))
                ends.append(ends[-1] + len(own))
            kept = [n if max_len is None else min(n, max_len) for n in sizes]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(kept, pa.int32()), lists], ["id", "n_tokens", "n_kept", "ids"])

    return rows.mapInArrow(run, f"id {kind}, n_tokens int, n_kept int, ids array<int>").withColumnRenamed("id", id_col)


def subword_text(df: DataFrame, ids: str, ranks: Broadcast, out: str = "text") -> DataFrame:
    """`df` with the text of the tokens in `ids`; padding and numbers that no token
    has are left out, and bytes that are no UTF-8 (of a cut text) replaced."""
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in ranks.value.items()}.get
        for b in batches:
            texts = [b"".join(map(token, v.values.to_pylist(), repeat(b""))).decode("utf-8", "replace") if v.is_valid else None for v in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit("")).schema)
