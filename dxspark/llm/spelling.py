"""Spelling variants by a dictionary of trie-node pairs.

Words that differ by exactly one inserted, deleted or replaced code point are
near. A word is a path in a forward trie (its prefixes) and in a reversed trie
(its suffixes). Cut at a position, it is an integer pair (prefix node, suffix
node); with the code point at a position left out, it is the pair (node before,
node after). Two words of which each skips one position to the same pair differ
by a replacement there; a word whose skip is another word's cut has one code
point more. Both are equi-joins on two integers, and they find every neighbour:
no edit-distance search, no group larger than the alphabet.

A node's number is the 64-bit hash of its path. That numbers both tries without
an exchange, the same in every task and after a lost executor, at a cost linear
in a word's length. Two nodes that got one number could only add a pair, never
lose one, and each pair is confirmed on its code points.

Words are counted in the tasks before they are shuffled, so a frequent word costs
a row a task. The rows of the pair join carry a word's number, not its letters.

Edge cases: a null text has no words and a null id counts as the empty string;
repeated rows count again; a word of any length is taken whole; an empty table
gives an empty result; other columns do not enter. Ties of the most frequent near
word go to the first in code-point order. Forms at least double in count, so a
chain of forms ends and cannot turn back.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
MIN_LENGTH, MIN_COUNT = 5, 3
#: one run in so many loses a code point, by its hash
SLIP = 97
#: different words that a task holds before it hands them on
HELD = 200_000
#: letters of the words that are made into node pairs at once
LETTERS = 1 << 18


def slipped(run: str, start: int) -> str:
    """The run, or the run without one code point where its hash says so.

    start: crc32 of the bytes `<doc_id>:`."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for r, n in Counter(RUN.findall(text.as_py() or "")).items():
                    if len(r) >= min_length:
                        w = slipped(r.lower() if r.isascii() else r.translate(UPPER), start)
                        if len(w) >= min_length:
                            total[w] += n
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()

    rows = docs.select(id_col, F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


def _prefix_nodes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Numbers of all prefixes, that of length 0 first, word after word."""
    n = len(lengths)
    at = np.arange(len(points)) - np.repeat(starts, lengths)  # place in its word
    sums = np.cumsum((points + 1).astype(np.uint64) * power[at], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    out = np.zeros(len(points) + n, np.uint64)
    place = np.arange(len(points)) + np.repeat(np.arange(n), lengths) + 1
    out[place] = sums - np.repeat(before, lengths)
    return out


def node_pairs(words: list[str]) -> tuple[np.ndarray, ...]:
    """(prefix node, suffix node, is a cut, index of the word) of every skipped
    position and every cut of words that are not empty."""
    lengths = np.array([len(w) for w in words])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    power = np.full(lengths.max(), 0x9E3779B97F4A7C15, np.uint64)
    power = np.cumprod(power, dtype=np.uint64)
    n, ends = len(words), starts + lengths
    backwards = np.repeat(ends - 1, lengths) - (np.arange(len(points)) - np.repeat(starts, lengths))
    prefix = _mixed(_prefix_nodes(points, starts, lengths, power))
    suffix = _mixed(_prefix_nodes(points[backwards], starts, lengths, power))  # by length
    own = np.repeat(np.arange(n), lengths + 1)
    first = starts + np.arange(n)  # where a word's nodes begin
    i = np.arange(len(prefix)) - first[own]  # length of the prefix
    cut_suffix = suffix[first[own] + lengths[own] - i]
    skips = np.flatnonzero(i < lengths[own])
    skip_suffix = suffix[first[own[skips]] + lengths[own[skips]] - i[skips] - 1]
    cut = np.r_[np.ones(len(prefix), bool), np.zeros(len(skips), bool)]
    return np.r_[prefix, prefix[skips]], np.r_[cut_suffix, skip_suffix], cut, np.r_[own, own[skips]]


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(p, s, cut, id): the node pairs of `words` (id, word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[str], ids: list[int]) -> pa.RecordBatch:
            p, s, cut, own = node_pairs(held)
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(cut), pa.array(np.array(ids, np.int64)[own])], ["p", "s", "cut", "id"])

        for b in batches:
            held, ids, size = [], [], 0
            for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(w)
                ids.append(k)
                size += len(w)
                if size >= LETTERS:
                    yield made(held, ids)
                    held, ids, size = [], [], 0
            if held:
                yield made(held, ids)

    return words.where("word <> ''").select("id", "word").mapInArrow(run, "p bigint, s bigint, cut boolean, id bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): ids of every ordered pair of near words. words: (id, word), no repeats."""
    pairs = stored(pair_dictionary(words), "node_pairs")
    skip = pairs.where("NOT cut").select("p", "s", F.col("id").alias("a"))
    other = skip.select("p", "s", F.col("a").alias("b"))
    cut = pairs.where("cut").select("p", "s", F.col("id").alias("b"))
    replaced = skip.join(other, ["p", "s"]).where("a < b").select("a", "b")
    longer = skip.join(cut, ["p", "s"]).select("a", "b")
    met = replaced.unionByName(longer).distinct()
    text = words.select(F.col("id").alias("a"), F.col("word").alias("a_word"))
    found = (met.join(text, "a").join(text.select(F.col("a").alias("b"), F.col("a_word").alias("b_word")), "b")
             .where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b"))
    found = stored(found, "near_words")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, root): the end of each chain id -> form; forms: (id, form), form null
    at an end. Each round doubles the steps that a row has gone."""
    at = stored(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    for _ in range(max_rounds):
        step = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(step, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if not at.where("moved").take(1):
            return at.select("id", "root")
        at = at.drop("moved")
    raise RuntimeError(f"chains of forms: not ended after {max_rounds} rounds")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and
    frequent enough; form: the near word of largest count, if that is at least
    `times` the word's own count."""
    counts = word_counts(docs, id_col, text_col, min_length, min_count)
    words = stored(counts.withColumn("id", F.monotonically_increasing_id()), "spelling_words")
    near = near_words(words)
    # the largest count, then the first in code-point order
    ranked = near.join(words.select(F.col("id").alias("b"), "n", "word"), "b")
    top = ranked.groupBy("a").agg(F.count("*").alias("n_near"), F.max("n").alias("top_n"))
    first = (ranked.join(top.select("a", "top_n"), "a").where("n = top_n")
             .groupBy("a").agg(F.min(F.struct("word", "b")).alias("first")))
    named = (words.join(top.withColumnRenamed("a", "id"), "id", "left").join(first.withColumnRenamed("a", "id"), "id", "left")
             .withColumn("is_form", F.col("top_n") >= times * F.col("n")))
    named = stored(named.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("first.b")).alias("form_id"),
                                F.when(F.col("is_form"), F.col("first.word")).alias("form"), F.when(F.col("is_form"), F.col("top_n")).alias("form_n")), "spelling_forms")
    ends = roots(named.select("id", F.col("form_id").alias("form")))
    by_root = named.join(ends, "id").join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return by_root.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
