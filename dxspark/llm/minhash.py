"""MinHash near-duplicates: bottom-k sketches, inverted lists, exact check.

A document is its set of distinct word shingles, hashed once. It keeps the `K`
smallest hashes, or all if it has no more. Two documents link if they share at
least `percent` % of the union of their sets.

Lists. Of the K smallest hashes of a linked pair's union, about 85 % are in both
sketches; `SHARED` of 64 or fewer has a chance under 1e-6 right at the limit and
falls fast above it; for sets of at most 54 shingles the bound is exact. Two
sketches with so many values in common also share one among the K - SHARED + 1
rarest of each (the prefix filter), so that only those are listed, by how many
documents retain a value. A passage that a third of the documents hold thus makes
no list: its documents have rarer values of their own.

No pairs per group. Exact copies (of the set) are one class from the start. In a
list the class whose values are most often retained, mostly the text that others
were copied from, is its leader and is compared with all others. What shares much
with it is near, and what links to it is connected. Two near sets differ exactly
where just one of them differs from the leader, so the links among near members
come from these short differences, in a task, of which only those that join
something leave it. The Jaccard distance obeys the triangle inequality: what is not
near cannot link with what links to the leader, which therefore leaves the list.
Lists with open pairs go on with another leader; the last of them are compared in
blocks of `BLOCK`, each pair of blocks a group of its own. So a group of near
copies costs a row a member, and no partner is left out.

Checks. The K smallest values of a pair's two sketches are a sketch of its union,
whose share in both estimates the similarity and drops most candidates; the rest
are confirmed on their full sets, made anew from the texts of those documents
alone. Links join into components.

Edge cases: null, empty and wordless texts have no shingle and link with nothing,
not even each other. A text of fewer words than a shingle has one shingle, all of
it. A null id stays and is no candidate for the smallest id; its row is kept if
its whole component has no id. Repeated rows stay, a row each. Very long texts
are taken whole. An empty table gives an empty result; other columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import connected_components, stored, table

SEED = 42
K, SHARED = 64, 38
#: near a leader: so many of the K smallest of the union are shared, and so many per
#: cent of all. What shares under 70 % with a leader cannot link with what links to
#: the leader (twice the distance of a link); of such pairs the sketch drops one in 1e8
FAR_SHARED, FAR = 24, 40
#: largest size of a set for which no linked partner has more than K shingles
WHOLE = K * 85 // 100
BLOCK = 4096
#: lists longer than this get another leader before they are compared in blocks
LONG = 1024
#: text hashes, 16 bytes each, that are sent to every task at most
BROADCAST_KEYS = 1_000_000
#: word hashes that a task keeps at hand
WORDS = 1 << 20


class _Hashes(dict):
    """64-bit hash of a word, made once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, size: int = 3) -> np.ndarray:
    """The distinct shingle hashes of a text, rising (int64)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    size = min(size, len(words))
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mixed(h + w[k:k + n])
    return np.unique(h.view(np.int64))


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    x = h.view(np.uint64)
    a, b = _mixed(x + np.uint64(1)).sum(dtype=np.uint64), _mixed(x ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def with_sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, t, n, sa, sb, sketch) of every row: text hash, size and digest of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            n, digests, flat, ends = [], [], [], [0]
            for text in b.column(2):
                h = shingle_set(text.as_py(), hashes, size)
                n.append(len(h))
                digests.append(_digest(h))
                flat.append(h[:K])
                ends.append(ends[-1] + min(K, len(h)))
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))
            sa, sb = (pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), sa, sb, sketch], ["id", "t", "n", "sa", "sb", "sketch"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _text_hash(text_col).alias("t"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t bigint, n bigint, sa bigint, sb bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(sa, sb, set) of the texts whose hash is in `wanted` (t), each text once."""
    if wanted.count() <= BROADCAST_KEYS:  # else the texts are shuffled to them
        wanted = F.broadcast(wanted)
    texts = (docs.select(_text_hash(text_col).alias("t"), F.col(f"`{text_col}`").cast("string").alias("text")).join(wanted, "t", "left_semi")
             .groupBy("text").agg(F.first("t").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for text in b.column(0):
                h = shingle_set(text.as_py(), hashes, size)
                sa, sb = _digest(h)
                yield pa.RecordBatch.from_arrays([pa.array([sa]), pa.array([sb]), pa.array([h], pa.list_(pa.int64()))], ["sa", "sb", "set"])

    return texts.select("text").mapInArrow(run, "sa bigint, sb bigint, set array<bigint>")


def need(n: Column, percent: int) -> Column:
    """How many retained values a set of n shingles shares with a linked one."""
    exact = F.ceil(n * percent / 100)
    return F.when(n <= WHOLE, exact).otherwise(F.lit(SHARED)).cast("int")


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def rare_values(classes: DataFrame, percent: int) -> DataFrame:
    """(cid, n, weight, v): the listed values of each class; weight: how often all
    its values are retained.

    classes: (cid, n, sketch). Values that one class alone retains are rarest and
    need no list."""
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(often, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
    kept = F.least(F.col("n"), F.lit(K)).cast("int")
    listed = kept - need(F.col("n"), percent) + 1 - (kept - F.size("shared"))
    weight = F.aggregate("shared", F.lit(0).cast("bigint"), lambda s, x: s + x["df"])
    return (held.where(listed > 0).select("cid", "n", weight.alias("weight"), F.slice("shared", F.lit(1), listed).alias("shared"))
            .select("cid", "n", "weight", F.explode("shared.v").alias("v")))


def star_pairs(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each list's leader against its other members, where that is still open.

    lists: (v, cid, n, weight, seen). Returns the pairs (x, r), each once, and
    the lists without their leaders, with the leader's number as `lead`."""
    best = F.max_by(F.struct("cid", "n", "seen"), F.struct("weight", -F.col("cid")))
    leaders = lists.groupBy("v").agg(best.alias("lead"), F.count("*").alias("members")).where("members > 1").select("v", "lead")
    met = stored(lists.join(leaders, "v").where(F.col("cid") != F.col("lead.cid")), "minhash_lists")
    pairs = met.where(~F.arrays_overlap("seen", "lead.seen") & sizes_fit(F.col("n"), F.col("lead.n"), FAR)).select(F.col("cid").alias("x"), F.col("lead.cid").alias("r")).distinct()
    return pairs, met.withColumn("lead", F.col("lead.cid"))


def near_leaders(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """(x, r, n, linked, delta) of the pairs that are near: whether they link, and
    the shingles that only one of the two has.

    pairs: (x, r). The union sketch drops most; the full sets decide."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.struct("n", "t", "sa", "sb").alias(f"{c}_of"), F.col("sketch").alias(f"{c}_sketch"))
    both, union = F.array_intersect("x_sketch", "r_sketch"), F.slice(F.array_sort(F.array_union("x_sketch", "r_sketch")), 1, K)
    nx, nr = F.col("x_of.n"), F.col("r_of.n")
    alike = F.when((nx <= K) & (nr <= K), 100 * F.size(both) >= FAR * (nx + nr - F.size(both))).otherwise(F.size(F.array_intersect(union, both)) >= FAR_SHARED)
    likely = stored(pairs.join(side("x"), "x").join(side("r"), "r").where(alike).select("x", "r", "x_of", "r_of"), "minhash_likely")
    wanted = stored(likely.select("x_of.t").unionByName(likely.select("r_of.t")).distinct(), "minhash_wanted")
    sets = stored(full_sets(docs, text_col, wanted, size), "minhash_sets")
    of = lambda c: sets.select(F.struct("sa", "sb").alias(f"{c}_key"), F.col("set").alias(f"{c}_set"))
    keyed = likely.withColumn("x_key", F.struct("x_of.sa", "x_of.sb")).withColumn("r_key", F.struct("r_of.sa", "r_of.sb"))
    delta = F.array_union(F.array_except("x_set", "r_set"), F.array_except("r_set", "x_set"))
    total, apart = F.size("x_set") + F.size("r_set"), F.size("delta")
    within = lambda p: (100 - p) * total >= (100 + p) * apart
    made = keyed.join(of("x"), "x_key").join(of("r"), "r_key").withColumn("delta", delta).where(within(FAR))
    return stored(made.select("x", "r", F.size("x_set").cast("bigint").alias("n"), within(percent).alias("linked"), "delta").dropDuplicates(["x", "r"]), "minhash_near")


def _tally(sets: list[np.ndarray]):
    """A function: how many values set i shares with each set."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    here = np.zeros(ids.max() + 2 if len(ids) else 1, np.int64)

    def shared(i: int) -> np.ndarray:
        own = ids[ends[i] - sizes[i]:ends[i]]
        here[own] = 1
        sums = np.r_[0, np.cumsum(here[ids])]
        here[own] = 0
        return sums[ends] - sums[ends - sizes]

    return shared


def _spanning(cid: np.ndarray, n: np.ndarray, linked: np.ndarray, deltas: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links that join what links among a leader's near members; those that link
    to the leader are joined already. Two sets differ where just one differs from
    the leader."""
    sizes, shared = np.array([len(x) for x in deltas]), _tally(deltas)
    root = np.where(linked, -1, np.arange(len(cid)))
    a, b = [], []
    for i in np.flatnonzero(~linked):
        apart = sizes + sizes[i] - 2 * shared(i)
        for j in np.flatnonzero(((100 - percent) * (n + n[i]) >= (100 + percent) * apart) & (root != root[i])):
            if root[j] != root[i]:
                a.append(cid[i])
                b.append(cid[j])
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return a, b


def _in_blocks(rows: DataFrame, keys: list[str], work, out: str) -> DataFrame:
    """`work(rows of one key)` -> two lists, for every run of rows with equal keys."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = work(list({r[0]: r for r in held}.values()))  # a block against itself brings a member once
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (a, b)], ["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() if not pa.types.is_list(c.type) else [x.values.to_numpy() for x in c] for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:k] != key:
                    yield from flush()
                    held, key = [], row[:k]
                held.append(row[k:])
        yield from flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def delta_links(near: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between near members of one leader, of which at least one does
    not link to it. A leader's members are dealt into blocks, those that link apart
    from those that don't, and each pair of blocks with one that don't is a group."""
    counts = near.groupBy("r").agg(F.count_if(~F.col("linked")).alias("open"), F.count("*").alias("members")).where("open > 0 AND members > 1")
    u, m = F.ceil(F.col("open") / BLOCK).cast("int"), F.ceil((F.col("members") - F.col("open")) / BLOCK).cast("int")
    rows = near.join(counts.select("r", u.alias("u"), m.alias("m")), "r")
    h = F.xxhash64("x")
    own = F.when(F.col("linked"), F.col("u") + F.pmod(h, F.greatest("m", F.lit(1)))).otherwise(F.pmod(h, F.col("u"))).cast("int")
    others = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("u") - 1)).otherwise(F.sequence(F.lit(0), F.col("u") + F.col("m") - 1))
    dealt = (rows.withColumn("own", own).withColumn("other", F.explode(others))
             .select("r", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("x").alias("cid"), "n", "linked", "delta"))

    def work(rows: list[tuple]) -> tuple[list, list]:
        cid, n, linked = (np.array([r[k] for r in rows]) for k in range(3))
        return _spanning(cid, n, linked, [r[3] for r in rows], percent)

    return _in_blocks(dealt, ["r", "i", "j"], work, "a bigint, b bigint")


def open_lists(met: DataFrame, near: DataFrame, seen: DataFrame) -> DataFrame:
    """The lists with pairs that no leader has decided: without the leader and what
    links to it, and only while no leader is near to all members. seen: (x, r) of
    all rounds."""
    gone = near.where("linked").select(F.col("x").alias("cid"), F.col("r").alias("lead"), F.lit(True).alias("gone"))
    kept = met.join(gone, ["cid", "lead"], "left").where("gone IS NULL").drop("gone", "lead", "seen", "members")
    leads = seen.groupBy(F.col("x").alias("cid")).agg(F.collect_set("r").alias("seen"))
    now = stored(kept.join(leads, "cid", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>"))), "minhash_now")
    each = now.groupBy("v").agg(F.count("*").alias("members")).where("members > 1")
    near_all = now.select("v", F.explode("seen").alias("r")).groupBy("v", "r").agg(F.count("*").alias("k")).groupBy("v").agg(F.max("k").alias("near_all"))
    going = each.join(near_all, "v", "left").where("near_all IS NULL OR near_all < members").select("v", "members")
    return stored(now.join(going, "v"), "minhash_open")


def _across(cid: np.ndarray, n: np.ndarray, seen: list[set], sketches: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Pairs of a list's members, near no common leader, that share enough values."""
    least, shared = np.where(n <= WHOLE, -(-n * percent // 100), SHARED), _tally(sketches)
    a, b = [], []
    for i in range(len(cid)):
        fit = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        for j in np.flatnonzero(fit & (cid > cid[i]) & (shared(i) >= np.maximum(least, least[i]))):
            if not (seen[i] and seen[j] and seen[i] & seen[j]):
                a.append(cid[i])
                b.append(cid[j])
    return a, b


def block_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, r): members of one list, near no common leader, that share enough of
    their sketches. lists: (v, cid, n, seen, members)."""
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    dealt = (lists.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "n", "seen"))
    rows = dealt.join(classes.select("cid", "sketch"), "cid").select("v", "i", "j", "cid", "n", "seen", "sketch")

    def work(rows: list[tuple]) -> tuple[list, list]:
        cid, n = (np.array([r[k] for r in rows], np.int64) for k in range(2))
        return _across(cid, n, [set(r[2].tolist()) for r in rows], [r[3] for r in rows], percent)

    return _in_blocks(rows, ["v", "i", "j"], work, "a bigint, b bigint").select(F.col("a").alias("x"), F.col("b").alias("r")).distinct()


def minhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, rounds: int = 3) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of `docs`.

    The bounds of the sketch are for 85 % or more. rounds: leaders that a long
    list gets at most before it is compared in blocks."""
    if percent < 85:
        raise ValueError("the sketch's bounds are for 85 % or more")
    marks = stored(with_sketch(docs, id_col, text_col, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    key = ["sa", "sb", "n"]
    named = stored(marks.where("n > 0").groupBy(*key).agg(F.min("row").alias("cid"), F.min("id").alias("least_id")), "minhash_classes")
    classes = stored(marks.join(named.select(F.col("cid").alias("row")), "row", "left_semi").withColumnRenamed("row", "cid").drop("id"), "minhash_sketches")

    lists = rare_values(classes, percent).withColumn("seen", F.array().cast("array<bigint>"))
    rest, seen, links = stored(lists, "minhash_values"), None, None
    for k in range(rounds):
        pairs, met = star_pairs(rest)
        near = near_leaders(pairs, classes, docs, text_col, size, percent)
        found = near.where("linked").select(F.col("x").alias("a"), F.col("r").alias("b")).unionByName(stored(delta_links(near, percent), "minhash_delta"))
        links = links.unionByName(found) if links else found
        both = near.select("x", "r").unionByName(near.select(F.col("r").alias("x"), "r").distinct())
        seen = seen.unionByName(both) if seen else both
        rest = open_lists(met, near, seen)
        if not rest.where(F.col("members") > LONG).take(1):
            break
    last = near_leaders(stored(block_pairs(rest, classes, percent), "minhash_last"), classes, docs, text_col, size, percent)
    links = links.unionByName(last.where("linked").select(F.col("x").alias("a"), F.col("r").alias("b")))

    roots = connected_components(links.select("a", "b")).select(F.col("node").alias("cid"), "root")
    rooted = stored(named.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "minhash_rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = stored(rooted.join(least, "root").select(*key, "component_id"), "minhash_labels")
    out = marks.select("id", *key).join(labels, key, "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
