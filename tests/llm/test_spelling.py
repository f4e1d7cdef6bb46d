from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dxspark.llm import spelling
from dxspark.llm.common import stored, table
from tests.conftest import SF_SMALL
from tests.llm import brute

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs: list[tuple[int | None, str | None]]) -> set[tuple]:
    counts: Counter[str] = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_gap = defaultdict(set)  # words under each of their single deletions, and under themselves
    for w in words:
        by_gap[w].add(w)
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1:]].add(w)
    links = defaultdict(set)
    for group in by_gap.values():
        for a in group:
            links[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n, len(links[w]), form[w] and words[form[w]]) for w, n in words.items()}


def got(df) -> set[tuple]:
    rows = [tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_documents(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert sum(w[1] is not None for w in want) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_family(spark, monkeypatch, seed):
    """Words of two letters, so that nearly every edit meets another word."""
    monkeypatch.setattr(spelling, "LETTERS", 50)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé÷" if k % 9 == 0 else "ab") for _ in range(rng.randrange(4, 9))) for k in range(300)]
    texts = [(k, " ".join(rng.choices(pool, weights=[1 + j % 17 for j in range(300)], k=400))) for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert got(stored(df, "dense")) == plain(texts)


def test_chain_ties_and_code_points(spark):
    text = "abcdefg " * 40 + "abcdefh " * 12 + "abcdxfh " * 5 + "zebraé " * 9 + "zebraÉ " * 9 + "zebra " * 3 + "ZEBRAX " * 3
    rows = [(1, text)]
    want = plain(rows)
    by = {w[0]: w for w in want}
    assert by["abcdxfh"][1:3] == ("abcdefh", "abcdefg")
    assert by["zebra"][1] == "zebraÉ"  # two near words of one count: the first code point
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_edges(spark):
    """Null ids and texts, repeated rows, a very long word, other columns."""
    df = brute.edge_documents(spark)
    long = [(900 + k, "y" * 50_000 + "z" * k, None, None, None) for k in (0, 1) for _ in range(3)]
    df = stored(df.unionByName(spark.createDataFrame(long, brute.SCHEMA)).selectExpr("*", "1 AS n", "'x' AS word", "2 AS id"), "edge")
    assert got(df) == plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_table(spark):
    df = spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string"))
    assert df.columns == COLUMNS
    assert df.collect() == []
