from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from dxspark.llm import minhash
from dxspark.llm.common import stored, table
from tests.conftest import SF_SMALL
from tests.llm import brute

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]
SCHEMA = "doc_id bigint, text string"


def shingles(text: str | None) -> frozenset:
    w = brute.WORD.findall(brute.ascii_lower(text or ""))
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(docs: list[tuple[int | None, str | None]], percent: int = 85) -> list[tuple]:
    """Every pair of different sets that have a shingle in common, in full."""
    sets = [shingles(t) for _, t in docs]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(s for s in sets if s))}
    root = list(range(len(kinds)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x
    holders = defaultdict(list)
    every = list(kinds)
    for k, s in enumerate(every):
        met = defaultdict(int)
        for x in s:
            for other in holders[x]:
                met[other] += 1
            holders[x].append(k)
        for other, both in met.items():
            if 100 * both >= percent * (len(s) + len(every[other]) - both):
                root[find(k)] = find(other)
    least: dict[int, int] = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if s and i is not None:
            c = find(kinds[s])
            least[c] = min(i, least.get(c, i))
    out = []
    for (i, _), s in zip(docs, sets, strict=True):
        c = least.get(find(kinds[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def got(df, **kw) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in minhash.minhash_classes(df, **kw).collect()), key=repr)


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def family(rng: random.Random, sizes=(5, 30, 55, 58, 63, 66, 70, 76, 90, 200, 600)) -> list[tuple[int, str]]:
    """Copies of base texts around the limit, with and without their base; a
    passage that all share; chains in which only neighbours link."""
    rows = []
    passage = [f"p{k}" for k in range(60)]
    for size in sizes:
        base = [f"b{size}x{k}" for k in range(size)]
        rows += [edited(rng, base, rng.randrange(1 + size // 20 + 2)) for _ in range(14)]
        rows += [passage + [f"q{size}x{k}x{j}" for j in range(9 + k)] for k in range(4)]
        chain = [f"c{size}x{k}" for k in range(size + 60)]
        rows += [chain[k:k + size] for k in range(0, 40, max(1, size // 25))]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_given_documents(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert sum(not w[3] for w in want) > 5


@pytest.mark.parametrize("block, long, seed", [(4096, 64, 1), (7, 4, 2)])
def test_families_at_the_limit(spark, monkeypatch, block, long, seed):
    """Also with short blocks and several leaders for each list."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LONG", long)
    rows = family(random.Random(seed))
    assert got(stored(spark.createDataFrame(rows, SCHEMA), "family")) == plain(rows)


def test_texts_shuffled_to_the_wanted(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 0)
    rows = family(random.Random(3), (66, 90, 200))
    assert got(stored(spark.createDataFrame(rows, SCHEMA), "family")) == plain(rows)


def test_large_group_makes_no_pairs(spark):
    """A group of near copies: candidates in proportion to its members."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    sizes = []
    for n in (100, 300):
        rows = [(k, " ".join(edited(rng, base, k and rng.randrange(1, 12)))) for k in range(n)]
        marks = minhash.with_sketch(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", 3)
        classes = stored(marks.withColumn("cid", marks["id"]), "classes")
        lists = minhash.rare_values(classes, 85).selectExpr("*", "CAST(array() AS array<bigint>) AS seen")
        sizes.append(minhash.star_pairs(lists)[0].count())
    assert sizes[1] < 4 * sizes[0] and sizes[1] < 4 * 300
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_edges(spark):
    """Null ids and texts, repeated rows, wordless, short and very long texts."""
    more = [(500, "one two"), (501, "One  TWO"), (502, "two one"), (503, "one"), (None, "alone here without id now"), (504, ""), (505, None), (506, "É é"), (507, "é é")]
    df = brute.edge_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA))
    df = stored(df.selectExpr("*", "1 AS n", "2 AS cid", "'x' AS t", "3 AS id", "4 AS row"), "edge")
    assert got(df) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_table(spark):
    out = minhash.minhash_classes(spark.createDataFrame([], SCHEMA))
    assert out.columns == COLUMNS and out.collect() == []


def test_digest_tells_sets_apart():
    hashes = minhash._Hashes()
    a, b = (minhash.shingle_set(t, hashes) for t in ("a b c d", "b c d a"))
    assert minhash._digest(a) != minhash._digest(b)
    assert np.array_equal(a, minhash.shingle_set("A b\tC\nd", hashes))
