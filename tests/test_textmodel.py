"""The text classifier by epochs, and the explanations of it, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dxspark.operators import features as J
from dxspark.operators import metrics as K
from dxspark.operators import models as M
from dxspark.operators import textexplain as E
from dxspark.operators import textmodel as T
from dxspark.plans.fixtures import fx
from tests.conftest import SF_SMALL

DIMS = 512


@pytest.fixture(scope="module")
def fitted(spark):
    t = fx(spark, SF_SMALL, "fx_text").withColumn("label", F.col("label").cast("double"))
    t = J.split_stratified(t, "doc_id", "label", 0.2, 42).checkpoint()
    return t, T.fit_text_epochs(t.where("split = 'train'"), t.where("split = 'test'"), "text", epochs=3, dims=DIMS)


def plain_score(model, ids) -> float:
    x = np.zeros(len(model.weights))
    for i in ids:
        if i >= 0:
            x[i] += model.idf[i]
    norm = math.sqrt((x * x).sum())
    return 1 / (1 + math.exp(-(model.bias + (model.weights @ x / norm if norm else 0))))


def test_learns_planted_words(spark):
    rng = random.Random(1)
    rows = []
    for k in range(1200):
        y = k % 2
        words = [f"common{rng.randrange(300)}" for _ in range(20)] + [f"{'good' if y else 'bad'}{rng.randrange(12)}" for _ in range(2)]
        rows.append((k, " ".join(rng.sample(words, len(words))), float(y)))
    df = spark.createDataFrame(rows + [(9000, None, 1.0), (9001, "", 0.0), (9002, "no label here", None)], "id int, text string, label double").repartition(6)
    train, test = df.where("id % 5 <> 0 OR id >= 9000"), df.where("id % 5 = 0 AND id < 9000")
    model = T.fit_text_epochs(train, test, "text", epochs=4)
    assert [r["step"] for r in model.log] == [1, 2, 3, 4]
    assert model.log[-1]["loss"] < model.log[0]["loss"]
    assert model.log[model.epoch - 1]["eval_f1"] > 0.97
    assert M.predict_scores(model, df.where("id >= 9000"), ["id"]).count() == 3


def test_chosen_pass_is_the_best_of_the_log(spark, fitted):
    t, model = fitted
    best = K.training_log_best(T.log_table(model), "model").first()
    assert (best.best_step, best.best_eval_f1) == (model.epoch, max(r["eval_f1"] for r in model.log))
    scored = M.predict_scores(model, t.where("split = 'test'"), ["doc_id"]).withColumn("m", F.lit("text"))
    got = K.binary_metrics(scored, "m").first()
    for c in ("accuracy", "precision", "recall", "f1"):
        assert math.isclose(got[c], model.log[model.epoch - 1][f"eval_{c}"], abs_tol=1e-12)


def test_passes_are_repeatable(spark, fitted):
    t, model = fitted
    again = T.fit_text_epochs(t.where("split = 'train'"), t.where("split = 'test'"), "text", epochs=3, dims=DIMS)
    assert again.epoch == model.epoch
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_scores_equal_plain_scores(spark, fitted):
    t, model = fitted
    rows = t.select("doc_id", "text", "label", T.term_ids("text", DIMS).alias("ids"))
    want = {r.doc_id: plain_score(model, r.ids) for r in rows.collect()}
    got = {r.doc_id: r.score for r in M.predict_scores(model, rows, ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


# ------------------------------------------------------------------ L2

def test_masks_and_their_scores(spark, fitted):
    _, model = fitted
    rng = np.random.default_rng(0)
    ids, counts = rng.integers(-1, 40, 60), rng.integers(1, 5, 60)  # features met by several words, and words without one
    on = E.masks(60, 500, 7)
    assert on.shape == (500, 60) and on[0].all()
    dropped = (~on[1:]).sum(1)
    assert dropped.min() == 1 and dropped.max() == 60
    assert (E.masks(60, 500, 7) == on).all()
    got = E._Text(ids, counts, model.weights, model.bias, model.idf).scores(on)
    for k in range(0, 500, 37):
        assert math.isclose(got[k], plain_score(model, [i for i, c, m in zip(ids, counts, on[k]) for _ in range(c) if m]), abs_tol=1e-12)


@pytest.mark.parametrize("n, d", [(80, 12), (40, 90)])
def test_ridge_equals_normal_equations(n, d, monkeypatch):
    """Both sides, also in pieces, against the augmented system with a free intercept."""
    monkeypatch.setattr(E, "PIECE", 40 * 16)
    rng = np.random.default_rng(n)
    on, y, weight, alpha = rng.random((n, d)) < 0.5, rng.random(n), rng.random(n) + 0.1, 0.7
    coef, intercept = E.ridge(on, y, weight, alpha)
    x = np.hstack([on.astype(float), np.ones((n, 1))])
    penalty = np.diag([alpha] * d + [0.0])
    want = np.linalg.solve(x.T @ (weight[:, None] * x) + penalty, x.T @ (weight * y))
    assert np.allclose(np.append(coef, intercept), want, atol=1e-9)


def test_surrogate_rows(spark, fitted):
    t, model = fitted
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (None, "two words two"), (-4, "it is of a")], "doc_id bigint, text string")
    docs = t.select("doc_id", "text").unionByName(more).selectExpr("*", "1 AS id", "2 AS token")
    out = E.text_surrogate(docs, "doc_id", "text", model).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    n_words = {r.doc_id: r.n for r in docs.select("doc_id", F.size(F.array_distinct(J.tokens("text", J.TOKEN_PATTERN))).alias("n")).collect()}
    assert set(by) == {i for i, n in n_words.items() if n}
    score = {r.doc_id: r.score for r in M.predict_scores(model, docs.withColumn("label", F.lit(0)), ["doc_id"]).collect()}
    for i, rows in by.items():
        assert sorted(r["rank"] for r in rows) == list(range(1, min(20, n_words[i]) + 1))
        assert max(r.gap for r in rows) < 1e-9
        assert math.isclose(rows[0].score, score[i], abs_tol=1e-12)
        assert [abs(round(r.weight, 12)) for r in sorted(rows, key=lambda r: r["rank"])] == sorted((abs(round(r.weight, 12)) for r in rows), reverse=True)
    assert all(abs(r.weight) < 1e-12 for r in by[-4])


def test_surrogate_finds_the_words_that_matter(spark, fitted):
    _, model = fitted
    words = [f"w{k}" for k in range(30)]
    ids = [r.i for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.term_id(F.col("w"), DIMS).alias("i")).collect()]
    flat = T.HashedTextModel(spark, "text", np.zeros(DIMS), 0.0, np.ones(DIMS))
    flat.weights[ids[3]], flat.weights[ids[11]] = 4.0, -4.0
    out = E.text_surrogate(spark.createDataFrame([(1, " ".join(words))], "id int, text string"), "id", "text", flat, top=5).collect()
    w = {r.token: r.weight for r in out}
    mates = lambda k: {words[j] for j, i in enumerate(ids) if i == ids[k]}
    assert mates(3) <= {t for t, v in w.items() if v > 0.02} and mates(11) <= {t for t, v in w.items() if v < -0.02}


# ------------------------------------------------------------------ L3

def plain_owen(score, n, seed, contexts):
    """The same tree with every coalition written out as a set of tokens."""
    out = {}

    def visit(a, b, others, value):
        if b - a == 1:
            out[a] = value
            return
        mid = (a + b + 1) // 2
        left, right = set(range(a, mid)), set(range(mid, b))
        shares = []
        for bits in E.context_bits(len(others), contexts, seed, a, b):
            c = set().union(*[o for o, on in zip(others, bits) if on]) if others else set()
            none, one, two, both = score(c), score(c | left), score(c | right), score(c | left | right)
            shares.append((((one - none) + (both - two)) / 2, ((two - none) + (both - one)) / 2))
        first, second = np.mean(shares, 0)
        move = (value - first - second) / 2
        visit(a, mid, [*others, right], first + move)
        visit(mid, b, [*others, left], second + move)

    visit(0, n, [], score(set(range(n))) - score(set()))
    return [out[k] for k in range(n)]


@pytest.mark.parametrize("n, contexts", [(1, None), (2, None), (7, 64), (33, None), (40, 6)])
def test_owen_equals_written_out_coalitions(fitted, n, contexts):
    _, model = fitted
    ids = np.random.default_rng(n).integers(-1, 20, n)
    got = E.owen_values(ids, model.weights, model.bias, model.idf, 5, contexts)
    want = plain_owen(lambda on: plain_score(model, [ids[k] for k in on]), n, 5, contexts or max(1, math.ceil(math.log2(max(n, 2)))))
    assert np.allclose(got, want, atol=1e-10)


def test_owen_of_two_spans_is_shapley(fitted):
    """Two tokens: the exact Shapley value over both orders."""
    _, model = fitted
    ids = np.array([3, 17])
    f = {s: plain_score(model, [ids[k] for k in s]) for r in range(3) for s in itertools.combinations(range(2), r)}
    want = [(f[(0,)] - f[()] + f[(0, 1)] - f[(1,)]) / 2, (f[(1,)] - f[()] + f[(0, 1)] - f[(0,)]) / 2]
    assert np.allclose(E.owen_values(ids, model.weights, model.bias, model.idf, 1), want, atol=1e-12)


def test_contributions_sum_to_the_score(spark, fitted):
    t, model = fitted
    long = " ".join(f"word{k * k % 977}" for k in range(20_000))
    more = spark.createDataFrame([(-1, None), (-2, " "), (None, "two words"), (-3, long)], "doc_id bigint, text string")
    docs = t.where("split = 'test'").select("doc_id", "text").unionByName(more)
    out = E.token_contributions(docs, "doc_id", "text", model)
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("contribution").alias("s"), F.first("score").alias("score"), F.first("base").alias("base")).collect()
    n = {r.doc_id: r.n for r in docs.select("doc_id", F.size(F.coalesce(J.tokens("text", J.TOKEN_PATTERN), F.array().cast("array<string>"))).alias("n")).collect()}
    assert {r.doc_id: r.n for r in got} == {i: k for i, k in n.items() if k > 0}
    assert n[-3] == 20_000
    assert all(math.isclose(r.s, r.score - r.base, abs_tol=1e-9) for r in got)


def test_owen_values_of_a_level_together(monkeypatch):
    """Levels in one piece, in many pieces and of one node at a time give the same,
    and a long text takes some tens of array steps a level, not some a token."""
    rng = np.random.default_rng(2)
    w, idf = rng.normal(size=300), rng.random(300) + 1
    ids = rng.integers(-1, 300, 700)
    calls, once = [], E.context_bits
    monkeypatch.setattr(E, "context_bits", lambda *a: calls.append(1) or once(*a))
    whole = E.owen_values(ids, w, 0.2, idf, 9)
    assert len(calls) <= 12
    score = lambda v: 1 / (1 + np.exp(-(0.2 + v)))
    f, c = np.unique(ids[ids >= 0], return_counts=True)
    v = c * idf[f]
    assert abs(whole.sum() - score(w[f] @ v / np.sqrt(v @ v)) + score(0.0)) < 1e-9
    monkeypatch.setattr(E, "PIECE", 1)
    assert np.allclose(E.owen_values(ids, w, 0.2, idf, 9), whole, atol=1e-12)


@pytest.mark.parametrize("n, kinds", [(1, 1), (2, 1), (2, 50), (60, 12), (400, 500)])
def test_occlusion_takes_each_token_out(fitted, n, kinds):
    _, model = fitted
    ids = np.random.default_rng(n).integers(-1 if kinds > 1 else 0, kinds, n)
    whole = plain_score(model, ids)
    want = [whole - plain_score(model, np.delete(ids, k)) for k in range(n)]
    assert np.allclose(E.occlusions(ids, model.weights, model.bias, model.idf), want, atol=1e-12)


def test_token_occlusion_scores_the_texts_without_each_token(spark, fitted, monkeypatch):
    """The query against texts that are written out without the token."""
    from dxspark.plans import queries_explain as Q
    t, model = fitted
    docs = spark.createDataFrame([(1, "uno dos uno tres"), (2, "sola"), (3, "a, b; a b c"), (4, None)], "doc_id bigint, text string")
    monkeypatch.setattr(Q, "text_model", lambda *_: (t, model))
    monkeypatch.setattr(Q, "fx", lambda *_: docs)
    got = Q.q_token_occlusion(spark, SF_SMALL).collect()
    assert {"doc_id", "pos", "token", "contribution", "occlusion"} == set(got[0].asDict())
    of = {i: [r.token for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.pos)] for i in (1, 2, 3)}
    less = [(i, k, " ".join(w[:k] + w[k + 1:])) for i, w in of.items() for k in range(len(w))] + [(i, -1, " ".join(w)) for i, w in of.items()]
    p = {(r.i, r.k): r.probability[1] for r in model.transform(spark.createDataFrame(less, "i int, k int, text string")).collect()}
    assert len(got) == 4 + 1 + 5
    assert all(math.isclose(r.occlusion, p[r.doc_id, -1] - p[r.doc_id, r.pos], abs_tol=1e-12) for r in got)
