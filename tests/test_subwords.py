"""Sub-word tokens against the public library that owns the rank file."""

import base64

import pytest
from pyspark.sql import functions as F

from dxspark.operators import subwords as W
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_features import SUBWORD_RANKS
from tests.conftest import SF_SMALL

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return W.sent_ranks(spark, SUBWORD_RANKS)


@pytest.fixture(scope="module")
def own():
    with open(SUBWORD_RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=W.PATTERN, mergeable_ranks=table, special_tokens={})


ODD = [(1, None), (2, ""), (3, "a"), (4, "  two  blanks \n\n and\tthis  "), (5, "Ünïcödé 漢字 🙂🙂🙂 don't we'll"), (None, "no id"), (6, "x" * 3000),
       (7, "<|endoftext|> stays text"), (7, "<|endoftext|> stays text"), (8, "\u0000\u0001")]


def test_equals_the_library(spark, ranks, own):
    docs = fx(spark, SF_SMALL, "fx_all_text").unionByName(spark.createDataFrame(ODD, "doc_id bigint, text string"))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).cache()
    got = {r.row: list(r.ids) for r in W.subword_ids(rows, "row", "text", ranks, None).collect()}
    want = {r.row: own.encode_ordinary(r.text or "") for r in rows.collect()}
    assert got == want


def test_round_trip_and_cut(spark, ranks):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    whole = W.subword_ids(df, "doc_id", "text", ranks, None)
    assert sorted(r.again for r in W.subword_text(whole, "ids", ranks, "again").collect()) == sorted(t or "" for _, t in ODD)
    for r in W.subword_ids(df, "doc_id", "text", ranks, 5, pad=-7).collect():
        assert len(r.ids) == 5 and r.n_kept == min(5, r.n_tokens)
        assert r.ids[r.n_kept:] == [-7] * (5 - r.n_kept)


def test_empty_table_and_large_vocabulary(spark, ranks, monkeypatch):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert W.subword_ids(empty, "doc_id", "text", ranks).collect() == []
    monkeypatch.setattr(W, "LARGEST", 100)
    with pytest.raises(ValueError, match="more than 100"):
        W.read_ranks(spark, SUBWORD_RANKS)


def test_long_pieces_take_few_lookups():
    """Only the ranks of pairs next to a joined one are looked up again."""
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

    letters = [bytes([97 + k]) for k in range(26)]
    pairs = [letters[k] + letters[k + 1] for k in range(0, 26, 2)]
    ranks = Counted({t: i for i, t in enumerate(letters + pairs)})
    piece = b"".join(letters) * 40
    assert W.merged(piece, ranks) == [26 + k for k in range(13)] * 40
    assert Counted.n < 4 * len(piece)
