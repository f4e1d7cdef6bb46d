from __future__ import annotations

import math
import random

import numpy as np
import pytest

from dxspark.llm import whiten as W
from dxspark.llm.common import table
from tests.conftest import SF_SMALL


def plain(rows: list[tuple[int | None, list[float]]], k: int = 8) -> dict:
    """Everything over Python's own integers, and one eigh."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    centred = np.array([[(n * v[j] - s[j]) / n for j in range(d)] for v in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return {"deviation": [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x], "e": e, "u": u,
            "explained": e / np.trace(cov), "whitened": centred @ u / np.sqrt(e)}


def agrees(got: list, rows: list[tuple], k: int = 8) -> None:
    want = plain(rows, k)
    assert len(got) == len(rows)
    by_id = {r.vec_id: r for r in got}
    w = np.array([by_id[i].whitened for i, _ in rows])
    signs = np.sign((w * want["whitened"]).sum(0))
    assert np.abs(w * signs - want["whitened"]).max() < 1e-8
    assert [int(by_id[i].deviation) for i, _ in rows] == want["deviation"]
    assert np.allclose(got[0].explained, want["explained"], rtol=1e-9)
    assert got[0].identity_error < 1e-9
    assert {r.n for r in got} == {len(rows)}


@pytest.mark.parametrize("size", [(4096, 1024), (64, 1024), (64, 3)])
def test_given_vectors(spark, size):
    """Also in many blocks, and in several stripes."""
    df = table(spark, SF_SMALL, "embeddings")
    agrees(W.whiten(df, rows_per_block=size[0], stripe=size[1]).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_query(spark):
    rows = W.op11_whitening(spark, SF_SMALL)
    assert rows.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    out = rows.collect()
    n = table(spark, SF_SMALL, "embeddings").count()
    assert len(out) == 8 * n and {r.component for r in out} == set(range(1, 9))
    share = {r.component: r.explained for r in out}
    assert all(share[c] >= share[c + 1] for c in range(1, 8))


def test_rows_that_do_not_take_part(spark):
    rng = random.Random(4)
    fine = [(k, [rng.gauss(j, 1 + j) for j in range(5)]) for k in range(60)]
    fine += [(60, fine[0][1]), (61, fine[0][1])]  # equal vectors are rows of their own
    bad = [(None, None), (100, []), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, [1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(fine + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS n", "'x' AS index", "2 AS task", "'y' AS id")
    got = W.whiten(df).collect()
    agrees(got, fine, 5)
    again = sorted((r.vec_id, r.whitened) for r in got)
    assert [w for i, w in again if i in (0, 60, 61)] == [again[0][1]] * 3


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    rows = [(None if k % 3 else 7, [rng.random(), rng.random()]) for k in range(30)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=2).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in rows)


def test_flat_directions_are_left_out(spark):
    rows = [(k, [float(k), 2.0 * k, 3.0]) for k in range(20)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {len(r.whitened) for r in got} == {1}
    assert abs(got[0].explained[0] - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []
