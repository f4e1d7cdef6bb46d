"""Katz backoff bigram model, trained and evaluated as grouped Spark jobs.

P(w | h) = disc(c(h w)) / c(h) for bigrams seen in training, else
alpha(h) * P(w); P(w) = disc(c(w)) / N for known words, else the mass that
discounting leaves, given to one unknown word. Counts r up to `TOP` get the
Good-Turing discount of Katz; larger ones give up `BACK` of one count, so that
every context keeps mass to back off with. alpha(h) = (1 - sum of seen P(w | h)) /
(1 - sum of their P(w)), over all words seen after h, so each P(. | h) sums to 1.

How it runs. A text is its words and an end token; words are known by their
64-bit XXH64. Each task packs its documents into chunks and sends every bigram
type of a chunk, with the documents that hold it, to the bucket of its second
word; blobs of sorted numbers, not rows, are shuffled. A bucket then has all
occurrences of its words: it knows c(w) and c(h w), and adds up per document the
logarithms of seen bigrams and of word counts. The words frequent enough to
outgrow a bucket (over 1 in `HOT` tokens, hence at most `HOT` of them) are
counted before, and their bigrams spread over all buckets. Left over are the
backed-off bigrams of held-out documents: they go, as the context's counts from
every bucket do, to the bucket of their context, where alpha is computed and
applied; contexts that are hot words are summed apart and their alphas sent to
all tasks. The stored table has one partition for each kind of record: chunk
directories, document sums, context counts, backed-off bigrams, counts of counts.
A last grouping by chunk adds up the sums of each document.

Nothing is pruned: every n-gram of every training document counts. Buckets and
chunks have bounded size, their number grows with the text.

Edge cases: null and empty texts are one end token; a null doc_id counts as the
text "" in the split; repeated rows are scored and counted each; without training
rows every count is 0, N is 0 and P is 1 for any word; an empty table gives an
empty result. Equal 64-bit hashes of different words would be counted as one.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import stored, table, words

TOP = 5
BACK = 0.1
HOT = 1024
CHUNK_TOKENS = 2_000_000
BUCKET_BYTES = 10_000_000
END, START = 1, 2  # as hashes; a word with one of these is as unlikely as any other clash
DIRECTORY, SUMS, CONTEXTS, BACKED, COUNTS = range(5)
_RECORD = "kind int, at string, to int, blob binary"


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, 5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def discounts(n: list[int]) -> list[float]:
    """disc(r) for r in 0..TOP from n[r], the types that occur r times."""
    out = [0.0]
    a = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        out.append(r * d if 0 < d < 1 else r - 0.5)  # too few counts for Good-Turing: absolute
    return out


def spread(h: np.ndarray, n: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "at", "to", "blob"])


class _Chunk:
    """Documents of one task, until they have enough tokens."""

    def __init__(self) -> None:
        self.names: dict[bytes, int] = defaultdict(count(2).__next__)  # 0: end, 1: start
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, key, held: bool, text: str | None) -> None:
        w = (text or "").encode().lower().split()
        self.ids.append(np.fromiter(map(self.names.__getitem__, w), np.int64, len(w)))
        self.docs.append((key, held, len(w) + 1))
        self.n += len(w) + 1

    def records(self, at: str, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.docs)), key=lambda k: self.docs[k][1])  # training documents first
        docs = [self.docs[k] for k in order]
        n_train = sum(not d[1] for d in docs)
        yield _batches([(DIRECTORY, at, int(spread(np.array([xxhash.xxh64_intdigest(at)], np.uint64), n_buckets)[0]), pack(docs, n_train))])
        hashes = np.fromiter((END, START, *map(xxhash.xxh64_intdigest, self.names)), np.uint64, len(self.names) + 2)
        first = np.concatenate([y for k in order for y in ([1], self.ids[k])])
        second = np.concatenate([y for k in order for y in (self.ids[k], [0])])
        self.ids = []
        doc = np.repeat(np.arange(len(docs), dtype=np.uint16 if len(docs) <= 1 << 16 else np.uint32), [d[2] for d in docs])
        key = (second << 32) | first
        del first, second
        by = np.argsort(key, kind="stable")
        key, doc = key[by], doc[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        two, one = key[start] >> 32, key[start] & 0xFFFFFFFF
        del key, by
        h2, h1 = hashes[two], hashes[one]
        to = spread(h2, n_buckets)
        wide = np.isin(h2, hot)
        to[wide] = spread(h2[wide] ^ (h1[wide] * np.uint64(0xC2B2AE3D27D4EB4F)), n_buckets)
        rank = np.argsort(to.astype(np.int32), kind="stable")
        ends = np.searchsorted(to[rank], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            t = rank[ends[b]:ends[b + 1]]
            if not len(t):
                continue
            run = np.flatnonzero(np.r_[True, two[t][1:] != two[t][:-1]])
            place = np.repeat(start[t] - np.r_[0, size[t].cumsum()[:-1]], size[t]) + np.arange(size[t].sum())
            yield _batches([(SUMS, at, b, pack(h2[t[run]], np.diff(np.r_[run, len(t)]).astype(np.uint32), h1[t], size[t].astype(np.uint16 if size[t].max() < 1 << 16 else np.uint32), doc[place], n_train, len(docs)))])


def _per_context(h1: np.ndarray, c12: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context of the types: c, types by count 1..TOP and above, and of
    its words the number by count 1..TOP, above, and the sum of those above."""
    by = np.argsort(h1, kind="stable")
    h1, c12, c2 = h1[by], c12[by], c2[by]
    start = np.flatnonzero(np.r_[True, h1[1:] != h1[:-1]]) if len(h1) else np.zeros(0, np.int64)
    cols = [c12, *(c12 == r for r in range(1, TOP + 1)), c12 > TOP, *(c2 == r for r in range(1, TOP + 1)), c2 > TOP, np.where(c2 > TOP, c2, 0)]
    sums = np.stack([np.add.reduceat(c.astype(np.int64), start) if len(start) else np.zeros(0, np.int64) for c in cols])
    return h1[start], sums


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8 if a.max(initial=0) < 256 else np.uint32 if a.max() < 1 << 32 else np.int64)


def _bucket(rows: list[tuple], n_buckets: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """What a bucket of second words says about documents and contexts."""
    blobs = [(at, *unpack(blob)) for at, blob in rows]
    h2 = np.concatenate([np.repeat(b[1], b[2]) for b in blobs])
    h1 = np.concatenate([b[3] for b in blobs])
    train = np.concatenate([np.add.reduceat((b[5] < b[6]).astype(np.int64), np.r_[0, b[4].astype(np.int64).cumsum()[:-1]]) for b in blobs])
    by = np.lexsort((h1, h2))
    s1, s2 = h1[by], h2[by]
    new2 = np.r_[True, s2[1:] != s2[:-1]]
    new = new2 | np.r_[True, s1[1:] != s1[:-1]]
    at_type, at_word = np.flatnonzero(new), np.flatnonzero(new2)
    c12 = np.add.reduceat(train[by], at_type)
    t1, t2 = s1[at_type], s2[at_type]
    cw = np.add.reduceat(train[by], at_word)
    w = s2[at_word]
    keys = np.array(sorted(hot), np.uint64)
    is_hot = np.isin(w, keys)
    if is_hot.any():
        cw[is_hot] = [hot[int(x)] for x in w[is_hot]]
    c2 = cw[np.searchsorted(at_word, at_type, "right") - 1]
    own = cw[~is_hot]  # hot words are in many buckets, and counted apart
    counts = np.array([[(c12 == r).sum(), (own == r).sum()] for r in range(1, TOP + 2)]), int((c12 > TOP).sum()), int((own > TOP).sum()), int((own > 0).sum()), int(own.sum())
    seen = c12 > 0
    del s1, s2, new, new2
    ctx, sums = _per_context(t1[seen], c12[seen], c2[seen])
    wide = np.isin(ctx, keys)
    yield _batches([(COUNTS, "", 0, pack(counts, ctx[wide], sums[:, wide]))])
    ctx, sums = ctx[~wide], sums[:, ~wide]
    to = spread(ctx, n_buckets)
    for b in np.unique(to):
        yield _batches([(CONTEXTS, "", int(b), pack(ctx[to == b], *(_small(x) for x in sums[:, to == b])))])
    back = np.empty(len(by), np.int64)
    back[by] = np.repeat(np.arange(len(at_type)), np.diff(np.r_[at_type, len(by)]))
    c12, c2 = c12[back], c2[back]
    value = np.where(c12 > TOP, np.log10(np.maximum(c12 - BACK, 1e-9)), 0.0) - np.where(h2 != END, np.log10(np.maximum(c2, 1)), 0.0)
    lo, left = 0, defaultdict(list)
    for at, _, _, one, size, doc, _, n_docs in blobs:
        hi = lo + len(one)
        a, b, v = c12[lo:hi], c2[lo:hi], value[lo:hi]
        add = lambda x: np.bincount(doc, np.repeat(x, size), n_docs)  # noqa: B023, E731
        ranks = [add(a == r).astype(np.int64) for r in range(1, TOP + 1)]
        yield _batches([(SUMS, at, 0, pack(add(v).astype(np.float32), add(np.log10(b + 1.0)), _small(add(b > 0).astype(np.int64)), *map(_small, ranks)))])
        k = np.flatnonzero(a == 0)
        if len(k):
            which = np.repeat(np.arange(len(one)), size)
            place = np.flatnonzero(a[which] == 0)
            which = which[place]
            h, d = one[which], doc[place].astype(np.uint64)
            to = np.where(np.isin(h, keys), spread(h ^ (d * np.uint64(0xD6E8FEB86659FD93)), n_buckets), spread(h, n_buckets))
            for q in np.unique(to):
                m = to == q
                left[int(q)].append((at, h[m], doc[place][m], _small(b[which][m])))
        lo = hi
    for q, parts in left.items():
        yield _batches([(BACKED, "", q, pack(parts))])


def alphas(sums: np.ndarray, uni: list[float], bi: list[float], n_tokens: int) -> np.ndarray:
    """Backoff weight of each context from its counts (see `_per_context`)."""
    c = np.maximum(sums[0], 1)
    kept = sums[0] - sum((r - bi[r]) * sums[r] for r in range(1, TOP + 1)) - BACK * sums[TOP + 1]
    words_ = sum(uni[r] * sums[TOP + 1 + r] for r in range(1, TOP + 1)) + sums[2 * TOP + 3] - BACK * sums[2 * TOP + 2]
    return np.where(sums[0] > 0, (1 - kept / c) / (1 - words_ / max(1, n_tokens)), 1.0)


def _grouped(df: DataFrame, key: str, work) -> tuple:
    """`df` dealt and sorted by key, and a function for mapInArrow that calls
    `work(key, rows)` for all rows of each key, one key at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for r in b.to_pylist():
                if held and r[key] != now:
                    yield from work(now, held)
                    held = []
                now = r[key]
                held.append(r)
        if held:
            yield from work(now, held)
    return df.repartition(key).sortWithinPartitions(key), run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: str = "crc32(coalesce(string({id}), '')) % 7 = 2",
                chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    sc = docs.sparkSession.sparkContext
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.expr(held.format(id=f"`{id_col}`")).alias("held"), text.alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    hot, n_docs = _hot_counts(rows)
    shared = sc.broadcast((hot, np.array(sorted(hot), np.uint64)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for b in batches:
            for key, out, t in zip(*b.columns, strict=True):
                chunk.add(key.as_py(), out.as_py(), t.as_py())
                if chunk.n >= chunk_tokens:
                    yield from chunk.records(f"{part}-{nth}", n_buckets, shared.value[1])
                    nth, chunk = nth + 1, _Chunk()
        if chunk.n:
            yield from chunk.records(f"{part}-{nth}", n_buckets, shared.value[1])

    def bucket(to: int, records: list[dict]) -> Iterator[pa.RecordBatch]:
        own = [(r["at"], r["blob"]) for r in records if r["kind"] == SUMS]
        same = [(r["kind"], r["at"], 0, r["blob"]) for r in records if r["kind"] == DIRECTORY]
        if same:
            yield _batches(same)
        if own:
            yield from _bucket(own, n_buckets, shared.value[0])

    dealt, work = _grouped(rows.mapInArrow(chunks, _RECORD), "to", bucket)
    counted = stored(dealt.mapInArrow(work, _RECORD), "katz")

    total, over, known, n_tokens = np.zeros((TOP + 1, 2), np.int64), np.zeros(2, np.int64), 0, 0
    wide: dict[int, np.ndarray] = {}
    for r in counted.where(f"kind = {COUNTS}").select("blob").toLocalIterator():  # a few numbers and at most HOT contexts for each bucket
        (n, big2, big1, k, s), ctx, sums = unpack(r[0])
        total, over, known, n_tokens = total + n, over + [big2, big1], known + k, n_tokens + s
        for h, x in zip(ctx.tolist(), sums.T, strict=True):
            wide[h] = wide.get(h, 0) + x
    for h, c in hot.items():
        if h != START:
            known, n_tokens = known + (c > 0), n_tokens + c
            if 0 < c <= TOP + 1:
                total[c - 1, 1] += 1
            over[1] += c > TOP
    bi, uni = (discounts([0, *total[:, k].tolist()]) for k in (0, 1))
    left = (sum((r - uni[r]) * total[r - 1, 1] for r in range(1, TOP + 1)) + BACK * over[1]) / max(1, n_tokens) if n_tokens else 1.0
    contexts = sorted(wide)
    alpha = alphas(np.array([wide[h] for h in contexts]).T, uni, bi, n_tokens) if contexts else []
    hot_alpha = {h: (float(a), int(wide[h][0])) for h, a in zip(contexts, alpha, strict=True)}
    model = sc.broadcast((uni, bi, float(left), n_tokens, hot_alpha))

    def backed(to: int, records: list[dict]) -> Iterator[pa.RecordBatch]:
        uni, bi, left, n_tokens, hot_alpha = model.value
        parts = [p for r in records if r["kind"] == BACKED for p in unpack(r["blob"])[0]]
        if not parts:
            return
        need = np.unique(np.concatenate([p[1] for p in parts]))
        sums = np.zeros((2 * TOP + 4, len(need)), np.int64)
        for r in records:
            if r["kind"] == CONTEXTS:
                ctx, *cols = unpack(r["blob"])
                at = np.searchsorted(need, ctx)
                fits = (at < len(need)) & (need[np.minimum(at, len(need) - 1)] == ctx)
                for k, c in enumerate(cols):
                    sums[k, at[fits]] += c[fits]
        alpha, c1 = alphas(sums, uni, bi, n_tokens), np.maximum(sums[0], 1)
        for k, h in enumerate(need.tolist()):
            if h in hot_alpha:
                alpha[k], c1[k] = hot_alpha[h]
        weight = np.log10(alpha) + np.log10(np.maximum(c1, 1))
        p_word = lambda c: np.where(c > TOP, (c - BACK) / max(1, n_tokens), np.array([left * max(1, n_tokens), *uni[1:]])[np.minimum(c, TOP)] / max(1, n_tokens))
        per = defaultdict(list)
        for at, h, doc, c2 in parts:
            per[at].append((doc.astype(np.int64), weight[np.searchsorted(need, h)] + np.log10(p_word(c2.astype(np.int64)))))
        for at, found in per.items():
            doc, inverse = np.unique(np.concatenate([d for d, _ in found]), return_inverse=True)
            yield _batches([(BACKED, at, 0, pack(doc, np.bincount(inverse, np.concatenate([v for _, v in found]), len(doc))))])

    dealt, work = _grouped(counted.where(f"kind IN ({CONTEXTS}, {BACKED})"), "to", backed)
    late = dealt.mapInArrow(work, _RECORD)
    n_vocab = int(known)

    def scored(at: str, records: list[dict]) -> Iterator[pa.RecordBatch]:
        uni, bi, left, n_tokens, _ = model.value
        docs, n_train = next(unpack(r["blob"]) for r in records if r["kind"] == DIRECTORY)
        score, base, n_known = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        for r in records:
            if r["kind"] == SUMS:
                a, b, k, *ranks = unpack(r["blob"])
                score += a
                base += b
                n_known += k
                for x, n in enumerate(ranks, 1):
                    score += n.astype(np.int64) * math.log10(bi[x])
            elif r["kind"] == BACKED:
                doc, v = unpack(r["blob"])
                score[doc] += v
        size = np.array([d[2] for d in docs], np.int64)
        base -= size * math.log10(n_tokens + n_vocab + 1)
        score -= math.log10(max(1, n_docs))  # the context of each first token
        held_out = np.arange(len(docs)) >= n_train
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], id_type), pa.array(held_out), pa.array(size), pa.array(n_known),
                                          pa.array(np.full(len(docs), n_tokens)), pa.array(base), pa.array(score)],
                                         [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(rows.schema["id"].dataType)
    dealt, work = _grouped(counted.where(f"kind IN ({DIRECTORY}, {SUMS})").unionByName(late), "at", scored)
    return dealt.mapInArrow(work, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _hot_counts(rows: DataFrame) -> tuple[dict[int, int], int]:
    """Training counts of the end, the start and of every word that may be more
    than one in HOT tokens, by hash, and the number of training documents.

    The list only decides where bigrams are counted, so a sample may draw it up;
    the counts are of all rows.
    """
    n_docs = rows.where("NOT held").count()
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(16)) == 0).select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").count()
    seen = some.agg(F.sum("count")).first()[0] or 0
    names = {r[0].encode().lower() for r in some.where(F.col("count") * HOT > seen).select("w").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, found = shared.value, Counter()
        for b in batches:
            for t in b.column(0):
                n = Counter((t.as_py() or "").encode().lower().split())
                for w in hot & n.keys():
                    found[w] += n[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

    exact = rows.where("NOT held").select("text").mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n")).collect()
    counts = dict.fromkeys((xxhash.xxh64_intdigest(w) for w in names), 0) | {xxhash.xxh64_intdigest(bytes(r[0])): r[1] for r in exact}
    return counts | {END: n_docs, START: n_docs}, n_docs


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
