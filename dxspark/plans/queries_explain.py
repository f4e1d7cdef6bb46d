"""Registered queries: attributions (L*)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxspark.operators import explain as L
from dxspark.operators import models as M
from dxspark.operators import textexplain as L2
from dxspark.operators import treeshap as S
from dxspark.operators.agg import sample_n
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_agg import DIAG_COLS
from dxspark.plans.queries_models import TEST_VISITS_SQL, _boosted, coded_data, text_model
from dxspark.plans.registry import query

N_SAMPLES, TOP = 500, 20
TOKENS_SQL = r"(SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM fx_all_text)"


def _surrogates(spark, sf):
    """Every document, explained under the fitted text classifier."""
    _, model = text_model(spark, sf)
    return model, L2.text_surrogate(fx(spark, sf, "fx_all_text"), "doc_id", "text", model, N_SAMPLES, TOP, 42)


@query("text_perturbation")
def q_text_perturbation(spark, sf):
    return _surrogates(spark, sf)[1].select("doc_id", "token", "weight", "rank")


@query("text_perturbation_check", f"""
SELECT doc_id, CAST(least({TOP}, len(list_distinct(l))) AS BIGINT) AS n_weights, true AS ranks_fit, true AS solves_normal_equations,
       true AS adds_up, true AS score_is_the_models
FROM {TOKENS_SQL} t WHERE len(l) > 0""")
def q_text_perturbation_check(spark, sf):
    """What holds for a weighted ridge fit: its residuals are orthogonal to every
    mask column up to the penalty; and its parts belong together."""
    model, s = _surrogates(spark, sf)
    each = s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_weights"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"), F.max("gap").alias("gap"),
        F.max(F.abs("weight")).alias("largest"), F.max(F.when(F.col("rank") == 1, F.abs("weight"))).alias("first"),
        F.sum("weight").alias("sum"), F.first("intercept").alias("intercept"), F.first("local_score").alias("local"), F.first("score").alias("score"))
    scored = model.transform(fx(spark, sf, "fx_all_text")).select("doc_id", vector_to_array("probability")[1].alias("p"))
    return each.join(scored, "doc_id").select(
        "doc_id", "n_weights",
        ((F.col("last") == F.col("n_weights")) & (F.col("ranks") == F.col("n_weights")) & (F.col("largest") - F.col("first") < 1e-9)).alias("ranks_fit"),
        (F.col("gap") < 1e-8).alias("solves_normal_equations"),
        (F.abs(F.col("sum") + F.col("intercept") - F.col("local")) < 1e-9).alias("adds_up"),
        (F.abs(F.col("score") - F.col("p")) < 1e-9).alias("score_is_the_models"))


@query("word_weights")
def q_word_weights(spark, sf):
    return L.word_weights(_surrogates(spark, sf)[1])


@query("global_importance", """
SELECT feature, round(avg(abs(value)), 6) AS importance FROM fx_attr GROUP BY feature
ORDER BY round(avg(abs(value)), 9) DESC, feature LIMIT 20""")
def q_global_importance(spark, sf):
    return L.global_importance(fx(spark, sf, "fx_attr"), "feature", "value", 20) \
        .withColumn("importance", F.round("importance", 6))


@query("row_waterfall", """
WITH r AS (SELECT row_id, feature, value,
                  row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature, value) AS rank FROM fx_attr),
top AS (SELECT row_id, CAST(rank AS INTEGER) AS rank, feature, value FROM r WHERE rank <= 3
        UNION ALL SELECT row_id, 4, 'other', sum(value) FROM r WHERE rank > 3 GROUP BY row_id)
SELECT row_id, rank, feature, round(value, 6) + 0.0 AS value,
       round(sum(value) OVER (PARTITION BY row_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumulative FROM top""")
def q_row_waterfall(spark, sf):
    out = L.row_waterfall(fx(spark, sf, "fx_attr"), "row_id", "feature", "value", k=3)
    return out.withColumn("value", F.round("value", 6)).withColumn("cumulative", F.round("cumulative", 6))


@query("importance_matrix", """
WITH top AS (SELECT feature FROM fx_attr GROUP BY feature ORDER BY round(avg(abs(value)), 9) DESC, feature LIMIT 10),
s AS (SELECT row_id, feature, sum(value) AS value FROM fx_attr WHERE feature IN (SELECT feature FROM top) GROUP BY 1, 2)
SELECT r.row_id, t.feature, round(coalesce(s.value, 0.0), 6) + 0.0 AS value
FROM (SELECT DISTINCT row_id FROM fx_attr) r CROSS JOIN top t
LEFT JOIN s ON s.row_id = r.row_id AND s.feature = t.feature""")
def q_importance_matrix(spark, sf):
    return L.importance_matrix(fx(spark, sf, "fx_attr"), "row_id", "feature", "value", 10) \
        .withColumn("value", F.round("value", 6))


# ------------------------------------------------------------ model-based (R)

def _explained_forest(d):
    return M.fit_random_forest(d.where("split = 'train'"), None, num_trees=50, max_depth=10)


@query("shapley_sampling")
def q_shapley_sampling(spark, sf):
    """Sampled values, for any model: each (row, permutation) draws a background row."""
    d = coded_data(spark, sf)
    model = _explained_forest(d)
    wide = d.select("visit_id", "split", *[F.col("x")[k].alias(c) for k, c in enumerate(DIAG_COLS)])
    background = sample_n(wide.where("split = 'train'"), "visit_id", 50, seed=42)
    out = L.shapley_sampling(_FromColumns(model), wide.where("split = 'test'"), "visit_id", DIAG_COLS, background, n_perm=8)
    d.unpersist()
    return out


class _FromColumns:
    """A fitted model over `features`, applied to the columns that make them."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return self.model.transform(df.withColumn("features", array_to_vector(F.array(*DIAG_COLS))))


def _exact(spark, sf):
    """Exact values of the test rows: a forest's probability, and the margin of the
    chosen boosted model at its full length."""
    d = coded_data(spark, sf)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    forest, boosted = _explained_forest(d), _boosted(train, "codigos", "GradientBoostingClassifier")
    d.unpersist()
    for name, nodes, score in (("random_forest", S.node_table(forest), vector_to_array(F.col("probability"))[1]),
                               ("gradient_boosting", boosted.attribution_nodes(), F.col("margin") - boosted.base[0])):
        model = forest if name == "random_forest" else boosted
        scored = model.transform(test).select("visit_id", score.alias("f"))
        yield S.tree_shap(test, "visit_id", "x", DIAG_COLS, nodes).withColumn("model", F.lit(name)), scored.withColumn("model", F.lit(name))


@query("shapley_exact")
def q_shapley_exact(spark, sf):
    return reduce(DataFrame.unionByName, [v for v, _ in _exact(spark, sf)]).select("model", "visit_id", "feature", "value")


@query("shapley_exact_check", f"""
SELECT m.model, t.visit_id, CAST({len(DIAG_COLS)} AS BIGINT) AS n_features, true AS sums_to_score, true AS score_is_the_models
FROM {TEST_VISITS_SQL} t CROSS JOIN (VALUES ('random_forest'), ('gradient_boosting')) m(model)""")
def q_shapley_exact_check(spark, sf):
    """A row's values sum to f(row) - mean f, and f is what the model gives."""
    parts = list(_exact(spark, sf))
    values, scored = (reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in (0, 1))
    each = values.groupBy("model", "visit_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("value").alias("sum"), F.first("score").alias("score"), F.first("base").alias("base"))
    near = lambda a, b: F.abs(a - b) < 1e-9
    return each.join(scored, ["model", "visit_id"]).select(
        "model", "visit_id", "n_features", near(F.col("sum"), F.col("score") - F.col("base")).alias("sums_to_score"), near(F.col("score"), F.col("f")).alias("score_is_the_models"))


@query("token_occlusion")
def q_token_occlusion(spark, sf):
    """Every token of every text: `occlusion` is f(text) - f(text without the token),
    `contribution` its value over all spans that hold it."""
    _, model = text_model(spark, sf)
    return L2.token_contributions(fx(spark, sf, "fx_all_text"), "doc_id", "text", model).select("doc_id", "pos", "token", "contribution", "occlusion")


@query("token_occlusion_check", f"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_tokens, true AS sums_to_score, true AS score_is_the_models, true AS base_is_of_no_text
FROM {TOKENS_SQL} t WHERE len(l) > 0""")
def q_token_occlusion_check(spark, sf):
    """Contributions of every token of every text sum to f(text) - f(no text)."""
    _, model = text_model(spark, sf)
    texts = fx(spark, sf, "fx_all_text")
    each = L2.token_contributions(texts, "doc_id", "text", model).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("contribution").alias("sum"), F.first("score").alias("score"), F.first("base").alias("base"))
    none = model.transform(spark.createDataFrame([("",)], "text string")).select(vector_to_array("probability")[1]).first()[0]
    scored = model.transform(texts).select("doc_id", vector_to_array("probability")[1].alias("p"))
    near = lambda x, y: F.abs(x - y) < 1e-9
    return each.join(scored, "doc_id").select(
        "doc_id", "n_tokens", near(F.col("sum"), F.col("score") - F.col("base")).alias("sums_to_score"),
        near(F.col("score"), F.col("p")).alias("score_is_the_models"), near(F.col("base"), F.lit(none)).alias("base_is_of_no_text"))


@query("text_perturbation_model")
def q_text_perturbation_model(spark, sf):
    """The surrogates of the held-out documents with how well they fit."""
    t, model = text_model(spark, sf)
    out = L2.text_surrogate(t.where("split = 'test'"), "doc_id", "text", model, N_SAMPLES, TOP, 42)
    return out.select("doc_id", "token", "weight", "rank", "score", "intercept", "local_score", "fit")
