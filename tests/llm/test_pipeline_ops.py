from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dxspark.llm import decontaminate as D
from dxspark.llm import mixing, quality, shard, simhash
from dxspark.llm.common import connected_components, stored, table
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def edge(spark):
    return stored(brute.edge_documents(spark), "edge")


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1400)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if all(a == b for a, b in pairs if x in (a, b))}
    assert got == {x: r for x, r in root.items() if x not in alone}


@pytest.mark.parametrize("width", [3, 4, 5])
def test_covering_loses_no_pair(width):
    from itertools import combinations
    groups = [set(g) for g in simhash.covering(width)]
    assert all(any(g <= set(five) for g in groups) for five in combinations(range(8), 5))


@pytest.mark.parametrize("block", [4096, 3])
def test_near_edges_hot_lists(spark, monkeypatch, block):
    """A dense family, also with every list dealt in blocks of three."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    got = {r.fp % (1 << 64): r.root % (1 << 64) for r in simhash.linked_classes(stored(df, "fps")).collect()}
    want = brute.classes(fps)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for x, c in zip(fps, want, strict=True):
        by_got[got[x]].add(x)
        by_want[c].add(x)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


@pytest.mark.parametrize("source", ["edge", "small"])
def test_simhash(spark, edge, source):
    docs = edge if source == "edge" else table(spark, SF_SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute.fingerprint(t) for _, t in rows]
    cls = brute.classes(fps)
    least = {c: min((i for (i, _), k in zip(rows, cls, strict=True) if k == c and i is not None), default=None) for c in set(cls)}
    want = sorted(((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, cls, strict=True)), key=repr)
    assert _rows(simhash.simhash_classes(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.first_of_classes(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


@pytest.mark.parametrize("source", ["edge", "small"])
def test_quality_base(spark, edge, source):
    docs = edge if source == "edge" else table(spark, SF_SMALL, "documents")
    got = _rows(quality.quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in docs.collect():
        b = brute.base_quality(r.text)
        want.append((r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert got == sorted(want, key=repr)


def test_quality_lines(spark, edge):
    got = {r.doc_id: r for r in quality.quality(edge).where("source = 'host'").collect()}
    for k in range(15):
        assert got[100 + k].kept and got[100 + k].n_removed_lines == 1 and got[100 + k].clean_text.startswith("u")
    for k in range(3):  # nothing is left but one word
        assert not got[200 + k].kept and got[200 + k].n_left_words == 1


def test_quality_copies_are_no_boilerplate(spark):
    text = "\n".join(" ".join(f"w{brute.letter(i)}v{brute.letter(j)}" for j in range(12)) for i in range(6))
    near = [(k, text.replace("wava ", f"edit{brute.letter(k)} "), "en", "s", 0) for k in range(40)]
    rows = [(1000 + k, text, "en", "s", 0) for k in range(50)] + near
    rows += [(2000 + k, " ".join(f"z{brute.letter(k)}y{brute.letter(j)}" for j in range(30)), "en", "s", 0) for k in range(60)]
    assert quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).where("NOT kept").count() == 0


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("n_template", [10, 20, 80])
def test_quality_template_pages(spark, n_template):
    """Different pages with a long template in common: all of its lines go."""
    rng = random.Random(n_template)
    template = "\n".join(_prose(rng, 3) for _ in range(n_template))
    rows = [(k, f"{template}\n{_prose(rng, 20)}", "en", "s", 0) for k in range(200)]
    rows += [(1000 + k, _prose(rng, 30), "en", "s", 0) for k in range(200)]
    out = quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert Counter(r.n_removed_lines for r in out) == {n_template: 200, 0: 200}
    assert {r.doc_id for r in out if r.n_left_words != (20 if r.doc_id < 1000 else 30)} == set()


def test_quality_rare_boilerplate_of_a_hot_host(spark):
    """Lines that 1, 3 and 10 % of a host's texts hold go from all of them; one
    in 0.2 % stays."""
    rng = random.Random(9)
    held = {_prose(rng, 8): step for step in (100, 33, 10, 500)}
    rows = [(k, "\n".join([x for x, step in held.items() if k % step == 0] + [_prose(rng, 30), _prose(rng, 30)]), "en", "hot", 0) for k in range(4000)]
    got = {r.doc_id: r.n_removed_lines for r in quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert got == {k: sum(k % step == 0 for step in (100, 33, 10)) for k in range(4000)}


def test_quality_judges_every_passage(spark):
    """Texts of mostly own passages are different documents, also if those of
    smallest hash are the host's."""
    word = lambda k, of: of + "".join(chr(97 + int(c)) for c in str(k))
    triples = spark.createDataFrame([tuple(word(k, c) for c in "xyz") for k in range(3000)], "a string, b string, c string")
    common = [" ".join(r) for r in triples.orderBy(F.xxhash64("a", "b", "c")).limit(16).collect()]
    rows = []
    for d in range(40):
        own = [f"{c} {word(100 * d + k, 'u')}" for k, c in enumerate(common)] + [" ".join(word(1000 * d + 3 * k + j, "v") for j in range(3)) for k in range(20)]
        rows.append((d, "\n".join(["read more of this on the front page", *own]), "en", "host", 0))
    got = quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).select("n_removed_lines").distinct().collect()
    assert [r[0] for r in got] == [1]


def test_quality_edited_copies_anywhere(spark):
    """A text with one word changed, in any line, is no other document."""
    rng = random.Random(8)
    text = [_prose(rng, 12).split() for _ in range(20)]
    rows = []
    for k in range(200):
        now = [list(x) for x in text]
        now[rng.randrange(20)][rng.randrange(12)] = _prose(rng, 1)
        rows.append((k, "\n".join(map(" ".join, now)), "en", "s", 0))
    rows += [(1000 + k, _prose(rng, 30), "en", "s", 0) for k in range(200)]
    assert quality.quality(spark.createDataFrame(rows, brute.SCHEMA)).where("NOT kept OR n_removed_lines > 0").count() == 0


@pytest.mark.parametrize(("shard_words", "block_words"), [(1_000_000, 2_000_000), (300, 60)])
def test_decontaminate(spark, edge, shard_words, block_words):
    docs = table(spark, SF_SMALL, "documents")
    if shard_words == 300:
        docs = docs.where("doc_id < 60")
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()][: 40 if shard_words > 300 else 8]
    items += [(900, None), (901, "..."), (902, "one two"), (903, "One  TWO!"), (903, "one two three four five one two three four five one two three four"), (None, "w1 über1")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    out = D.decontaminate(both, bench, shard_words=shard_words, block_words=block_words)
    got = _rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own = [(i, t) for i, t in items if i is not None]
    want = []
    for r in both.collect():
        n, hit, k, digest, bad = brute.contamination(r.text, own)
        full = brute.contamination(r.text, items)
        want.append((r.doc_id, n, full[1], k, digest, full[4]))
    assert got == sorted(want, key=repr)


def test_suffix_array_and_matches(spark):
    ids = np.random.default_rng(1).integers(1, 4, 200)
    order = D.suffix_array(ids, 256)
    assert list(order) == sorted(range(200), key=lambda k: (list(ids[k:]),))
    item = " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x y {item.upper()} z"), (2, "b0 b1 b2")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in D.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert out[1].longest_match == 30 and out[1].matches[0].asDict() == {"item_id": "7", "word": 2, "n": 30} and out[2].matches == []


def test_sharding(spark, edge):
    docs = table(spark, SF_SMALL, "documents").repartition(5).select("doc_id", "text")
    docs = stored(docs.unionByName(edge.select("doc_id", "text")), "docs")
    out = shard.shard_rows(docs, block_rows=4).collect()
    n = docs.count()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} <= {n // 16, -(-n // 16)}
    again = shard.shard_rows(docs, block_rows=4).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert shard.shard_rows(docs.where("doc_id = 4")).count() == docs.where("doc_id = 4").count()
    assert shard.shard_rows(docs.where("doc_id = -1")).count() == 0


def test_matrix_is_hypergeometric():
    sizes, capacity = np.array([30, 0, 50, 20]), np.array([60, 40])
    rows = np.array([[shard.matrix_row(sizes, capacity, p, seed) for p in range(4)] for seed in range(3000)])
    assert (rows.sum(2) == sizes).all() and (rows.sum(1) == capacity).all()
    assert abs(rows[:, 0, 0].mean() - 18) < 0.2 and abs(rows[:, 0, 0].var() - 30 * 0.6 * 0.4 * 70 / 99) < 0.4
    rng = np.random.default_rng(0)
    big = np.array([shard.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 1000) for _ in range(4000)])
    assert abs(big.mean() - 600) < 1.5 and abs(big.var() - 240) < 25


def test_mixing(spark, edge):
    docs = table(spark, SF_SMALL, "documents").unionByName(edge)
    out = mixing.mix(docs, range_rows=4, keep_text=False)
    rows = out.collect()
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(brute.WORD.findall(r.text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert len(rows) == docs.count()
    one = mixing.mix(docs, range_rows=1 << 20, keep_text=False).collect()  # ranges do not matter
    assert sorted(map(repr, one)) == sorted(map(repr, rows))


def test_equal_rows_are_cut_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 100 + [(2, "d e", "t")] * 100, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).groupBy("source").sum("taken").collect()
    goal = dict(zip("st", mixing.targets([300, 200], [3, 1]), strict=True))
    assert all(abs(r[1] - goal[r[0]]) <= 1.5 for r in got)
    assert mixing.mix(docs.where("doc_id = 3")).count() == 0


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5, 6, "n")] * 3, "doc_id bigint, text string, source string, size int, shard int, n_words string")
    for out in (quality.quality(docs), mixing.mix(docs), shard.shard_rows(stored(docs, "x")), simhash.first_of_classes(docs),
                D.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string"))):
        assert out.count() in (1, 3) and len(set(out.columns)) == len(out.columns)


def test_pipeline(spark):
    import corpus_pipeline
    docs = table(spark, SF_SMALL, "documents")
    want, now = None, docs
    for name, f in corpus_pipeline.STAGES:
        before = now.collect()
        now = stored(f(spark, now, SF_SMALL), name)
        if name != "sharding":
            assert now.columns == docs.columns
        after = Counter(r.doc_id for r in now.collect())
        if name == "near_duplicates":
            cls = brute.classes([brute.fingerprint(r.text) for r in before])
            want = Counter(min(r.doc_id for r, k in zip(before, cls, strict=True) if k == c) for c in set(cls))
            assert after == want
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
            assert after == Counter(r.doc_id for r in before if not brute.contamination(r.text, items)[4])
    assert now.select("shard").distinct().count() == 16
