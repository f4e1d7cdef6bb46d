"""Benchmark decontamination by suffix arrays over the training text.

Every task builds suffix arrays over shards of its own documents (words, about
`SHARD_WORDS` per shard, cut between documents), and finds every suffix of the
benchmark items in them by binary search: the interval of a window gives all
its locations, and each location is extended word by word to the longest
verbatim match. Documents are neither shuffled nor sampled, so the work is one
scan. The benchmark comes in blocks of at most `BLOCK_WORDS` words; a block is
the only thing broadcast. If there is more than one, the marks so far are
written to the shared folder between blocks.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is
`window` consecutive words of an item; an item of fewer words, but not none, is
one window. A document is contaminated if words hit are at least one in twenty.

Edge cases: null and empty texts have no words and are never contaminated; items
without words never occur; repeated rows and items each count by themselves, and
a null item_id is left out of the digest; an item_id repeated is listed once. Extra
columns pass through, but a column with the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import stored, table

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
#: result and inner columns; input columns of these names are replaced
MADE = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "matches", "_hit", "_text"}

_TO = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their suffixes' first `depth` words."""
    n = len(ids)
    rank, k = ids.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        step = np.r_[0, (np.diff(rank[order]) != 0).cumsum()] if n else order
        rank = np.empty(n, np.int64)
        rank[order] = step
        if k >= depth or not n or step[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:max(0, n - k)] = rank[k:] + 1
        rank = rank * (n + 1) + after
        k *= 2


def interval(text: np.ndarray, order: np.ndarray, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place in `order` of the suffixes that begin with
    each row of `query` (its first `size` words), by binary search.

    text has as many zeros behind its last word as `query` has columns.
    """
    at = np.arange(query.shape[1])
    known = at[None, :] < size[:, None]
    ends = []
    for past in (False, True):
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            there = text[order[np.minimum(mid, len(order) - 1)][:, None] + at]
            differs = (there != query) & known
            first = differs.argmax(1)
            row = np.arange(len(query))
            same = ~differs[row, first]
            below = np.where(same, past, there[row, first] < query[row, first])
            go = lo < hi
            lo, hi = np.where(go & below, mid + 1, lo), np.where(go & ~below, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


class Items:
    """A block of benchmark items: their words, and where each window begins."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], window: int):
        self.ids = [i for i, _ in rows]
        names: dict[bytes, int] = {}
        flat = [names.setdefault(w, len(names)) for _, ws in rows for w in ws]
        self.words, self.flat = list(names), np.array(flat, np.int64)
        size = np.array([len(ws) for _, ws in rows], np.int64)
        end = size.cumsum()
        item = np.repeat(np.arange(len(rows)), size)
        start = np.arange(len(flat))
        whole = np.minimum(size, window)[item] if len(flat) else start
        keep = start + whole <= end[item] if len(flat) else start.astype(bool)
        self.item, self.start, self.size, self.end = item[keep], start[keep], whole[keep], end[item[keep]]
        self.window, self.longest = window, int(size.max(initial=0))

    def find(self, text: np.ndarray, order: np.ndarray, names: dict[bytes, int]) -> tuple[np.ndarray, ...]:
        """All locations: place in the text, words of the window, item, and
        words of the longest verbatim match that begins there."""
        ids = np.array([names.get(w, -1) for w in self.words] or [-1], np.int64)
        flat = np.r_[ids[self.flat], np.full(self.window, -1)] if len(self.flat) else np.full(self.window, -1)
        found: list[list[np.ndarray]] = [[], [], [], []]
        at = np.arange(self.window)
        for s in range(0, len(self.start), 1 << 14):
            start, size, item, end = (v[s:s + (1 << 14)] for v in (self.start, self.size, self.item, self.end))
            query = flat[start[:, None] + at]
            live = ((query >= 0) | (at[None, :] >= size[:, None])).all(1)  # a window with a word that the shard lacks has no place in it
            start, size, item, end, query = start[live], size[live], item[live], end[live], query[live]
            if not len(start):
                continue
            lo, hi = interval(text, order, query, size)
            many = hi - lo
            which = np.repeat(np.arange(len(start)), many)
            place = order[np.repeat(lo - np.r_[0, many.cumsum()[:-1]], many) + np.arange(many.sum())]
            length = size[which]
            more = np.arange(len(which))
            while len(more):
                q, p = start[which[more]] + length[more], place[more] + length[more]
                inside = (q < end[which[more]]) & (p < len(text))
                more, q, p = more[inside], q[inside], p[inside]
                more = more[text[p] == flat[q]]
                length[more] += 1
            for f, v in zip(found, (place, size[which], item[which], length), strict=True):
                f.append(v)
        return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list]:
    rows, n = [], 0
    for r in bench.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        w = tokens(r[1])
        if rows and n + len(w) > block_words:
            yield rows
            rows, n = [], 0
        rows.append((r[0], w))
        n += len(w)
    yield rows


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text",
                  window: int = WINDOW, keep_text: bool = True, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated,
    longest_match (words) and matches (array of item_id, first document word and
    words of the longest verbatim match, one for each item that occurs)."""
    spark = docs.sparkSession
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in MADE and (keep_text or c != text_col)]
    now = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("_text"),
                      F.expr("CAST(NULL AS BINARY) AS _hit"), F.expr("0L AS n_words"), F.expr("0L AS n_hit"),
                      F.expr("CAST(NULL AS ARRAY<STRUCT<item_id: STRING, word: BIGINT, n: BIGINT>>) AS matches"))
    for k, rows in enumerate(_blocks(bench, bench_id, bench_text, window, block_words)):
        if k:
            now = stored(now, "decontaminate")
        now = now.mapInArrow(_marker(spark.sparkContext.broadcast(rows), window, shard_words), now.schema)
    ids = F.sort_array(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return now.select(*kept, "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                      F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"),
                      F.coalesce(F.array_max(F.transform("matches", lambda m: m["n"])), F.lit(0)).cast("bigint").alias("longest_match"), "matches")


def _marker(shared, window: int, shard_words: int):
    """The marking of one block of items, a shard of documents at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, window)
        shard = _Shard()
        for b in batches:
            at = 0
            for k, t in enumerate(b.column(b.schema.get_field_index("_text"))):
                shard.add(t.as_py())
                if shard.n >= shard_words:
                    yield from shard.marked(items, [b.slice(at, k + 1 - at)])
                    shard, at = _Shard(), k + 1
            if at < b.num_rows:
                shard.rows.append(b.slice(at))
        yield from shard.marked(items, [])
    return run


class _Shard:
    """Documents of one suffix array: their words as numbers, a 0 after each."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.names: dict[bytes, int] = defaultdict(count(1).__next__)
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, text: str | None) -> None:
        w = tokens(text)
        self.ids.append(np.fromiter(map(self.names.__getitem__, w), np.int64, len(w)))
        self.n += len(w) + 1

    def marked(self, items: Items, more: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the shard with what the items of this block add."""
        if not self.ids:
            return
        size = np.array([len(x) for x in self.ids])
        end = np.array([len(x) + 1 for x in self.ids]).cumsum()
        begin = end - size - 1
        pad = np.zeros(items.window + 1, np.int64)
        text = np.concatenate([y for x in self.ids for y in (x, pad[:1])] + [pad])
        order = suffix_array(text[:end[-1]], items.window)
        place, length, item, longest = items.find(text, order, self.names)
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        hit = cover.cumsum() > 0
        doc = np.searchsorted(end, place, "right")
        by = np.lexsort((place, -longest, item, doc))  # first of each document and item: its longest match
        first = by[np.r_[True, (np.diff(doc[by]) != 0) | (np.diff(item[by]) != 0)]] if len(by) else by
        found: dict[int, list[dict]] = defaultdict(list)
        for k in first:
            found[doc[k]].append({"item_id": items.ids[item[k]], "word": int(place[k] - begin[doc[k]]), "n": int(longest[k])})
        k = 0
        for b in [*self.rows, *more]:
            old = dict(zip(b.schema.names, b.columns, strict=True))
            bits, n_hit, matches = [], [], []
            for was, had in zip(old["_hit"], old["matches"], strict=True):
                own = hit[begin[k]:end[k] - 1]
                if was.is_valid:
                    own = own | np.unpackbits(np.frombuffer(was.as_py(), np.uint8), count=len(own)).astype(bool)
                n_hit.append(int(own.sum()))
                bits.append(np.packbits(own).tobytes() if n_hit[-1] else None)
                matches.append((had.as_py() or []) + found.get(k, []))
                k += 1
            new = {"_hit": pa.array(bits, pa.binary()), "n_words": pa.array(size[k - len(bits):k], pa.int64()),
                   "n_hit": pa.array(n_hit, pa.int64()), "matches": pa.array(matches, b.schema.field("matches").type)}
            yield pa.RecordBatch.from_arrays([new.get(c, v) for c, v in old.items()], b.schema.names)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")
