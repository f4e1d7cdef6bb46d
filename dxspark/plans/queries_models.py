"""Registered queries: evaluation tables (K7-K15, A9) and fitted models (K1-K6).

Metric queries run over `fx_scored` (pred = score >= 0.5, model key = grp)
and have DuckDB oracles. Fitted-model queries return prediction or result
tables and are checked by property tests (quality above the majority class,
schema, row counts)."""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxspark.operators import boosting as B
from dxspark.operators import features as J
from dxspark.operators import metrics as K
from dxspark.operators import models as M
from dxspark.operators import textmodel as T
from dxspark.operators import treeshap as S
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_agg import DIAG_COLS
from dxspark.plans.queries_codes import BINARY_BASE
from dxspark.plans.queries_reshape import LANGS
from dxspark.plans.registry import query
from dxspark.session import scratch_path
from dxspark.sources import io

SCORED_SQL = "(SELECT row_id, grp, y, CAST(score >= 0.5 AS INTEGER) AS pred, score FROM fx_scored)"
COUNTS_SQL = f"""(SELECT grp, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN y <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN y = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN y <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn, count(*) AS n FROM {SCORED_SQL} s GROUP BY grp)"""


def sdiv(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


def _scored(spark, sf):
    s = fx(spark, sf, "fx_scored")
    return s.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("confusion_matrix", f"""
SELECT g.grp, c.y, c.pred, count(s.grp) AS n
FROM (SELECT DISTINCT grp FROM fx_scored) g CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(y, pred)
LEFT JOIN {SCORED_SQL} s ON s.grp = g.grp AND s.y = c.y AND s.pred = c.pred
GROUP BY 1, 2, 3""")
def q_confusion_matrix(spark, sf):
    return K.confusion_matrix(_scored(spark, sf), "grp")


METRICS_SQL = f"""SELECT grp, round((tp + tn) / n, 6) AS accuracy, round({sdiv('tp', 'tp + fp')}, 6) AS precision,
       round({sdiv('tp', 'tp + fn')}, 6) AS recall, round({sdiv('2 * tp', '2 * tp + fp + fn')}, 6) AS f1
FROM {COUNTS_SQL} c"""


@query("binary_metrics", METRICS_SQL)
def q_binary_metrics(spark, sf):
    return r6(K.binary_metrics(_scored(spark, sf), "grp"), ["accuracy", "precision", "recall", "f1"])


def _report_sql() -> str:
    def cls(label, tp, fp, fn):
        return (f"SELECT grp, '{label}' AS label, {sdiv(tp, f'{tp} + {fp}')} AS precision, "
                f"{sdiv(tp, f'{tp} + {fn}')} AS recall, {sdiv(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, "
                f"CAST({tp} + {fn} AS BIGINT) AS support FROM {COUNTS_SQL} c")
    per = f"{cls('0', 'tn', 'fn', 'fp')} UNION ALL {cls('1', 'tp', 'fp', 'fn')}"
    return f"""WITH pc AS ({per}), tot AS (SELECT grp, n, tp, tn FROM {COUNTS_SQL} c)
SELECT grp, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT * FROM pc
  UNION ALL SELECT grp, 'accuracy', NULL, NULL, (tp + tn) / n, n FROM tot
  UNION ALL SELECT grp, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc GROUP BY grp
  UNION ALL SELECT grp, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc GROUP BY grp) r"""


@query("classification_report", _report_sql())
def q_classification_report(spark, sf):
    return r6(K.classification_report(_scored(spark, sf), "grp"), ["precision", "recall", "f1"])


SCORE_TABLE = """(SELECT grp, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
       sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM fx_scored GROUP BY 1, 2)"""


@query("roc_curve", f"""
WITH c AS (SELECT grp, score,
                  sum(pos) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
                  sum(neg) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
                  sum(pos) OVER (PARTITION BY grp) AS p, sum(neg) OVER (PARTITION BY grp) AS n FROM {SCORE_TABLE} s)
SELECT grp, score AS threshold, round(cn / nullif(n, 0), 6) AS fpr, round(cp / nullif(p, 0), 6) AS tpr FROM c
UNION ALL SELECT DISTINCT grp, 'inf'::DOUBLE, 0.0, 0.0 FROM fx_scored""")
def q_roc_curve(spark, sf):
    return r6(K.roc_curve(fx(spark, sf, "fx_scored"), "grp"), ["fpr", "tpr"])


AUC_RAW_SQL = f"""SELECT grp, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below
      FROM {SCORE_TABLE} s) c GROUP BY grp"""
AUC_SQL = f"SELECT grp, round(auc, 6) AS auc FROM ({AUC_RAW_SQL}) a"


@query("roc_auc", AUC_SQL)
def q_roc_auc(spark, sf):
    return r6(K.roc_auc(fx(spark, sf, "fx_scored"), "grp"), ["auc"])


def _compare_sql() -> str:
    raw = re.sub(r"round\((.*?), 6\) AS", r"\1 AS", METRICS_SQL)
    long = f"""(SELECT grp AS model, metric, value FROM (
      SELECT grp, 'accuracy' AS metric, accuracy AS value FROM ({raw}) m
      UNION ALL SELECT grp, 'precision', precision FROM ({raw}) m
      UNION ALL SELECT grp, 'recall', recall FROM ({raw}) m
      UNION ALL SELECT grp, 'f1', f1 FROM ({raw}) m
      UNION ALL SELECT grp, 'auc', auc FROM ({AUC_RAW_SQL}) a) u WHERE grp IN ({', '.join(repr(m) for m in LANGS)}))"""
    cols = ", ".join(f"round_even(max(CASE WHEN model = '{m}' THEN value END), 4) AS {m}" for m in LANGS)
    return f"""WITH l AS {long},
b AS (SELECT metric, model AS best FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, model) AS r FROM l) x WHERE r = 1)
SELECT l.metric, {cols}, b.best FROM l JOIN b ON l.metric = b.metric GROUP BY l.metric, b.best"""


@query("compare_models", _compare_sql())
def q_compare_models(spark, sf):
    return K.compare_models(_scored(spark, sf), "grp", LANGS)


@query("subset_accuracy", f"""
SELECT count(*) AS n, round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy
FROM (SELECT * FROM {SCORED_SQL} s ORDER BY row_id LIMIT 100) h""")
def q_subset_accuracy(spark, sf):
    return r6(K.subset_accuracy(_scored(spark, sf), "row_id", 100), ["accuracy"])


@query("training_log_best", """
SELECT model, best_step, best_eval_f1 FROM (
  SELECT model, run_id AS best_step, f1 AS best_eval_f1,
         row_number() OVER (PARTITION BY model ORDER BY f1 DESC, run_id) AS r FROM fx_grid) t WHERE r = 1""")
def q_training_log_best(spark, sf):
    g = fx(spark, sf, "fx_grid")
    log = F.array(F.struct(F.col("run_id").alias("step"), F.col("recall").alias("loss"),
                           F.lit(None).cast("double").alias("eval_f1")),
                  F.struct(F.col("run_id").alias("step"), F.lit(None).cast("double").alias("loss"),
                           F.col("f1").alias("eval_f1")))
    path = scratch_path(spark, "trainer_log")
    g.select("model", log.alias("log_history")).write.json(path)
    logs = spark.read.schema("model string, log_history array<struct<step:bigint,loss:double,eval_f1:double>>") \
        .json(path)
    return K.training_log_best(logs, "model")


# The gradient-boosting grid of the reference (2,187 candidates).
GB_GRID = {
    "n_estimators": [100, 200, 300],
    "learning_rate": [0.01, 0.05, 0.1],
    "max_depth": [3, 5, 7],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "subsample": [0.6, 0.8, 1.0],
    "max_features": ["sqrt", "log2", None],
}


def _labelled_visits(spark, sf):
    """Visits whose target is exactly F20 or F20.89; label 1 = F20.89."""
    v = fx(spark, sf, "fx_visits").where(F.col("psq").isin("F20", "F20.89"))
    return v.select("visit_id", (F.col("psq") == "F20.89").cast("int").alias("label"))


def _grid_sql() -> str:
    keys = sorted(GB_GRID)
    tables, pid = [], "0"
    for i, k in enumerate(keys):
        vals = ", ".join(f"({j}, {'NULL' if v is None else repr(str(v))})" for j, v in enumerate(GB_GRID[k]))
        tables.append(f"(VALUES {vals}) t{i}(p{i}, \"{k}\")")
        pid = f"({pid}) * {len(GB_GRID[k])} + p{i}"
    folds = """(SELECT fold, count(*) AS n_valid, sum(count(*)) OVER () AS n_all FROM (
      SELECT CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(visit_id AS VARCHAR)), visit_id) - 1) % 5 AS INTEGER) AS fold
      FROM (SELECT visit_id, CAST(psq = 'F20.89' AS INTEGER) AS label FROM fx_visits WHERE psq IN ('F20', 'F20.89')) v) f
      GROUP BY fold)"""
    return (f"SELECT CAST({pid} AS BIGINT) AS candidate_id, {', '.join(keys)}, f.fold, "
            f"CAST(f.n_all - f.n_valid AS BIGINT) AS n_train, f.n_valid FROM {' CROSS JOIN '.join(tables)} "
            f"CROSS JOIN {folds} f")


@query("param_grid_table", _grid_sql())
def q_param_grid_table(spark, sf):
    grid = K.param_grid(spark, GB_GRID)
    folds = J.kfold_assign(_labelled_visits(spark, sf), "visit_id", "label", 5, 42)
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid"))
    total = folds.count()
    per_fold = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    # five rows, one per fold: a bounded broadcast
    return per_fold.join(F.broadcast(sizes), "fold").withColumn("n_train", F.lit(total) - F.col("n_valid"))


@query("export_metrics", METRICS_SQL.replace("SELECT grp,", "SELECT grp AS dataset,", 1))
def q_export_metrics(spark, sf):
    m = r6(K.binary_metrics(_scored(spark, sf), "grp"), ["accuracy", "precision", "recall", "f1"])
    long = m.unpivot(["grp"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    _, json_path = io.export_metrics(long, scratch_path(spark, "metrics"), "grp", "metric", "value")
    back = spark.read.text(json_path).select(F.explode(F.from_json("value", "map<string,map<string,double>>"))
                                             .alias("dataset", "m"))
    return back.select("dataset", *[F.col("m")[k].alias(k) for k in ("accuracy", "precision", "recall", "f1")])


# ------------------------------------------------------------ fitted models (R)

#: the test rows of `coded_data` in SQL
TEST_VISITS_SQL = """(SELECT visit_id, label FROM (
  SELECT visit_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(visit_id AS VARCHAR)), visit_id) AS r,
         ceil(count(*) OVER (PARTITION BY label) * 0.3) AS cut
  FROM (SELECT visit_id, CAST(regexp_matches(psq, 'F20.89') AS INTEGER) AS label FROM BINARY_BASE b) l) s WHERE r <= cut)""".replace("BINARY_BASE", BINARY_BASE)


def coded_data(spark, sf, variant: str = "codes"):
    """A variant of the binary dataset (I9) with label 1 = F20.89, a stratified
    70/30 split, and its columns as label numbers (J1): `x` and `features`."""
    from dxspark.operators.codes import build_binary_dataset
    base = build_binary_dataset(fx(spark, sf, "fx_diag_wide"), "visit_id", DIAG_COLS, "psq", fx(spark, sf, "fx_crosswalk"), variant=variant)
    if variant == "codes":
        base = base.withColumn("label", F.col("psq").rlike("F20.89").cast("double"))
    else:  # the target is described there: the label is that of the visit's code
        codes = fx(spark, sf, "fx_visits").select("visit_id", F.col("psq").rlike("F20.89").cast("double").alias("label"))
        base = base.join(codes, "visit_id")
    data = M.encode_codes(base.checkpoint(), "visit_id", DIAG_COLS).select("visit_id", "label", "x", "features").checkpoint()
    return J.split_stratified(data, "visit_id", "label", 0.3, 42).persist()


#: trees of the chosen forest that one fit grows: the fits share the cores and the driver holds few unfinished trees
TREES_A_FIT = 15


def _forest(train, dataset: str):
    """The chosen forest of a dataset: balanced class weights, full depth."""
    p = M.TREE_PARAMS[dataset]["RandomForestClassifier"]
    weighted = J.class_weights(train, "label").persist()
    model = M.fit_random_forest(weighted, None, num_trees=p["n_estimators"], max_depth=p["max_depth"], impurity=p["criterion"],
                                feature_subset=p["max_features"], weight="weight", trees_a_fit=TREES_A_FIT)
    weighted.unpersist()
    return model


def _boosted(train, dataset: str, name: str):
    return B.fit_boosted(train, "visit_id", "x", "label", B.booster(name, M.TREE_PARAMS[dataset][name]))


@query("fit_random_forest")
def q_fit_random_forest(spark, sf):
    d = coded_data(spark, sf)
    model = _forest(d.where("split = 'train'"), "codigos")
    d.unpersist()  # fitted; scoring re-reads the checkpointed rows lazily
    return M.predict_scores(model, d.where("split = 'test'"), ["visit_id"])


@query("fit_decision_tree")
def q_fit_decision_tree(spark, sf):
    d = coded_data(spark, sf)
    model = M.fit_decision_tree(d.where("split = 'train'"), None, max_depth=5)
    d.unpersist()
    return M.predict_scores(model, d.where("split = 'test'"), ["visit_id"])


@query("fit_decision_tree_check", f"""
SELECT visit_id, label AS y, true AS score_in_range, true AS score_is_a_leafs FROM {TEST_VISITS_SQL} t""")
def q_fit_decision_tree_check(spark, sf):
    """The scored keys and labels; every score is the share of class 1 in a leaf."""
    d = coded_data(spark, sf)
    model = M.fit_decision_tree(d.where("split = 'train'"), None, max_depth=5)
    d.unpersist()
    leaves = S.node_table(model).where("left < 0").select(F.round("value", 9).alias("_leaf")).distinct()
    s = M.predict_scores(model, d.where("split = 'test'"), ["visit_id"])
    return (s.join(leaves, F.round("score", 9) == F.col("_leaf"), "left")
            .select("visit_id", "y", F.col("score").between(0, 1).alias("score_in_range"), F.col("_leaf").isNotNull().alias("score_is_a_leafs")))


@query("fit_gradient_boosting")
def q_fit_gradient_boosting(spark, sf):
    d = coded_data(spark, sf)
    model = _boosted(d.where("split = 'train'"), "codigos", "GradientBoostingClassifier")
    d.unpersist()
    return M.predict_scores(model, d.where("split = 'test'"), ["visit_id"])


BOOSTED = ("GradientBoostingClassifier", "XGBClassifier")
VARIANTS = {"codigos": "codes", "descripciones": "descriptions", "combinado": "combined"}


def _boosted_sets(spark, sf):
    """Every boosted parameter set at its full length on its dataset: (dataset, rows
    with a split, settings by name, model whose fits are in that order)."""
    data = {dataset: coded_data(spark, sf, variant) for dataset, variant in VARIANTS.items()}
    sets = {dataset: {name: B.booster(name, M.TREE_PARAMS[dataset][name]) for name in BOOSTED} for dataset in VARIANTS}

    def fit(dataset: str):
        return B.boost_many(data[dataset].where("split = 'train'"), "visit_id", "x", "label", list(sets[dataset].values()))

    models = B.side_by_side(spark, fit, [(dataset,) for dataset in VARIANTS])  # a fit alone has few tasks
    for (dataset, d), model in zip(data.items(), models, strict=True):
        d.unpersist()
        yield dataset, d, sets[dataset], model


@query("boosted_models")
def q_boosted_models(spark, sf):
    """Metrics of every boosted parameter set on the test rows of its dataset."""
    scored = []
    for dataset, d, sets, model in _boosted_sets(spark, sf):
        for k, name in enumerate(sets):
            s = M.predict_scores(_Fit(model, k), d.where("split = 'test'"), ["visit_id"])
            scored.append(s.withColumn("model", F.lit(f"{dataset} {name}")))
    return K.metric_table(reduce(DataFrame.unionByName, scored), "model")


class _Fit:
    """One of a model's fits."""

    def __init__(self, model, fit: int):
        self.model, self.fit = model, fit

    def transform(self, df):
        return self.model.transform(df, self.fit)


def _rounds_sql() -> str:
    rows = ", ".join(f"('{d}', '{n}', {M.TREE_PARAMS[d][n]['n_estimators']})" for d in VARIANTS for n in BOOSTED)
    return f"(VALUES {rows}) v(dataset, model, trees)"


@query("boosted_models_check", f"""
SELECT v.dataset, v.model, CAST(v.trees AS BIGINT) AS trees, t.n AS n_scored, true AS sums_add_up, true AS leaves_are_newton_steps,
       true AS splits_keep_limits, true AS margins_are_sums_of_leaves
FROM {_rounds_sql()} CROSS JOIN (SELECT count(*) AS n FROM {TEST_VISITS_SQL} t) t""")
def q_boosted_models_check(spark, sf):
    """What holds for the trees of every set: a node's sums are those of its
    children, a leaf's value follows from its sums, no split breaks its limits, and
    a row's margin is the start plus the values of the leaves whose path it fits."""
    out = []
    for dataset, d, sets, model in _boosted_sets(spark, sf):
        test = d.where("split = 'test'")
        for k, (name, p) in enumerate(sets.items()):
            t = model.nodes.where(F.col("fit") == k)
            kids = t.select("tree", F.col("node").alias("_n"), F.col("g").alias("_g"), F.col("h").alias("_h"), F.col("cover").alias("_c"))
            inner = t.where("left >= 0").join(kids, "tree").where("_n = left OR _n = right").groupBy("tree", "node").agg(
                F.first("g").alias("g"), F.sum("_g").alias("g2"), F.first("h").alias("h"), F.sum("_h").alias("h2"), F.first("cover").alias("c"),
                F.sum("_c").alias("c2"), F.min("_c").alias("least"), F.min("_h").alias("least_h"), F.first("gain").alias("gain"))
            near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-6
            limits = (F.col("gain") > 0) & (F.col("least") >= p.leaf_rows) & (F.col("least_h") >= p.child_weight - 1e-9) & (F.col("c") >= p.split_rows)
            sums = inner.agg(F.min(near("g", "g2") & near("h", "h2") & near("c", "c2")).alias("sums_add_up"), F.min(limits).alias("splits_keep_limits"))
            step = -p.rate * F.col("g") / (F.col("h") + p.l2)
            leaves = t.where("left < 0").agg(F.min(F.abs(F.col("value") - step) < 1e-9).alias("leaves_are_newton_steps"))
            paths = S.tree_scores(test, "visit_id", "x", model.attribution_nodes(k))
            scored = model.transform(test, k).join(paths, "visit_id")
            margins = scored.agg(F.count(F.lit(1)).alias("n_scored"), F.min(F.abs(F.col("margin") - F.col("f") - model.base[k]) < 1e-9).alias("margins_are_sums_of_leaves"))
            trees = t.agg(F.countDistinct("tree").alias("trees"))
            rows = [x.withColumn("model", F.lit(name)) for x in (trees, margins, sums, leaves)]  # one row each
            out.append(reduce(lambda a, b: a.join(b, "model"), rows).select(
                       F.lit(dataset).alias("dataset"), "model", "trees", "n_scored",
                               F.coalesce("sums_add_up", F.lit(True)).alias("sums_add_up"), "leaves_are_newton_steps",
                               F.coalesce("splits_keep_limits", F.lit(True)).alias("splits_keep_limits"), "margins_are_sums_of_leaves"))
    return reduce(DataFrame.unionByName, out)


def text_model(spark, sf):
    """The labelled texts with a stratified 80/20 split, and the classifier that
    five passes over the training part give."""
    t = J.split_stratified(fx(spark, sf, "fx_text").withColumn("label", F.col("label").cast("double")),
                           "doc_id", "label", 0.2, 42).checkpoint()  # read several times
    return t, T.fit_text_epochs(t.where("split = 'train'"), t.where("split = 'test'"), "text", epochs=TEXT_EPOCHS)


TEXT_EPOCHS = 5
TEST_TEXTS_SQL = """(SELECT doc_id, label FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
         ceil(count(*) OVER (PARTITION BY label) * 0.2) AS cut FROM fx_text) s WHERE r <= cut)"""


@query("fit_text_classifier")
def q_fit_text_classifier(spark, sf):
    t, model = text_model(spark, sf)
    return M.predict_scores(model, t.where("split = 'test'"), ["doc_id"])


@query("fit_text_classifier_check", f"""
SELECT doc_id, CAST(label AS INTEGER) AS y, true AS score_in_range, true AS pred_is_half_or_more FROM {TEST_TEXTS_SQL} t""")
def q_fit_text_classifier_check(spark, sf):
    """The scored keys and labels, and what holds for every score."""
    s = q_fit_text_classifier(spark, sf)
    return s.select("doc_id", "y", F.col("score").between(0, 1).alias("score_in_range"),
                    (F.col("pred") == (F.col("score") >= 0.5).cast("int")).alias("pred_is_half_or_more"))


@query("text_training_log")
def q_text_training_log(spark, sf):
    """A row per pass: loss and evaluation, and whether it is the pass that was kept."""
    _, model = text_model(spark, sf)
    return (T.log_table(model).select("model", F.inline("log_history"))
            .withColumn("kept", F.col("step") == model.epoch))


@query("text_training_check", f"""
SELECT CAST({TEXT_EPOCHS} AS BIGINT) AS passes, true AS kept_is_first_best, true AS log_agrees_with_scores, count(*) AS n_scored
FROM {TEST_TEXTS_SQL} t""")
def q_text_training_check(spark, sf):
    """K15 over the written log finds the pass that was kept, and the log's
    figures of that pass are those of the scores."""
    t, model = text_model(spark, sf)
    path = scratch_path(spark, "text_log")
    log = T.log_table(model)
    log.write.json(path)
    best = K.training_log_best(spark.read.schema(log.schema).json(path), "model")
    scored = M.predict_scores(model, t.where("split = 'test'"), ["doc_id"]).withColumn("model", F.lit("text"))
    now = K.binary_metrics(scored, "model").join(scored.groupBy("model").agg(F.count(F.lit(1)).alias("n_scored")), "model")
    kept = log.select("model", F.size("log_history").cast("bigint").alias("passes"), F.inline("log_history")).where(F.col("step") == model.epoch)
    same = [F.abs(F.col(c) - F.col(f"eval_{c}")) < 1e-9 for c in ("accuracy", "precision", "recall", "f1")]
    return (kept.join(best, "model").join(now, "model")
            .select("passes", (F.col("best_step") == F.col("step")).alias("kept_is_first_best"),
                    (same[0] & same[1] & same[2] & same[3]).alias("log_agrees_with_scores"), "n_scored"))


@query("predict_scores")
def q_predict_scores(spark, sf):
    """K5 + K9/K12: metrics of the fitted tree models on the same test split."""
    d = coded_data(spark, sf)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    fits = {"random_forest": _forest(train, "codigos"),
            "decision_tree": M.fit_decision_tree(train, None),
            "gradient_boosting": _boosted(train, "codigos", "GradientBoostingClassifier"),
            "xgboost": _boosted(train, "codigos", "XGBClassifier")}
    d.unpersist()
    scored = [M.predict_scores(m, test, ["visit_id"]).withColumn("model", F.lit(name)) for name, m in fits.items()]
    return K.metric_table(reduce(DataFrame.unionByName, scored), "model")


def grid_candidates() -> list[tuple[int, str, dict]]:
    """The candidates of GB_GRID in the order of `param_grid` (K7)."""
    keys = sorted(GB_GRID)
    return [(k, "GradientBoostingClassifier", dict(zip(keys, values, strict=True))) for k, values in enumerate(itertools.product(*[GB_GRID[k] for k in keys]))]


def _grid_results(spark, sf):
    d = coded_data(spark, sf)
    train = J.kfold_assign(d.where("split = 'train'").drop("split"), "visit_id", "label", 5, 42)
    out = B.grid_search(train, "visit_id", "x", "label", "fold", grid_candidates(), scratch_path(spark, "grid"))
    d.unpersist()
    return out


@query("grid_search")
def q_grid_search(spark, sf):
    """K6: mean f1 of each candidate over its folds, best first in `place`."""
    mean = _grid_results(spark, sf).groupBy("candidate_id").agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("folds"))
    grid = K.param_grid(spark, GB_GRID)
    better = Window.orderBy(F.round("mean_f1", 9).desc(), "candidate_id")  # one row a candidate
    return mean.join(grid, "candidate_id").withColumn("place", F.row_number().over(better))


@query("grid_search_check", f"""
SELECT CAST(candidate_id AS BIGINT) AS candidate_id, CAST(count(*) AS BIGINT) AS folds, true AS f1_in_range FROM ({_grid_sql()}) g
GROUP BY candidate_id""")
def q_grid_search_check(spark, sf):
    """Every candidate with each fold once, under its number in K7's table."""
    grid = K.param_grid(spark, GB_GRID)
    found = _grid_results(spark, sf).groupBy("candidate_id").agg(F.countDistinct("fold").alias("folds"), F.min(F.col("f1").between(0, 1)).alias("f1_in_range"))
    return grid.select("candidate_id").join(found, "candidate_id", "left")


@query("best_model_per_metric", f"""
WITH l AS (SELECT grp AS model, metric, value FROM (
      SELECT grp, 'accuracy' AS metric, accuracy AS value FROM ({METRICS_SQL}) m
      UNION ALL SELECT grp, 'precision', precision FROM ({METRICS_SQL}) m
      UNION ALL SELECT grp, 'recall', recall FROM ({METRICS_SQL}) m
      UNION ALL SELECT grp, 'f1', f1 FROM ({METRICS_SQL}) m) u)
SELECT metric, model AS best, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS r FROM l) x WHERE r = 1""")
def q_best_model_per_metric(spark, sf):
    """F8: per metric the model with the largest value (ties to the first model name)."""
    from dxspark.operators.agg import best_per_group
    m = r6(K.binary_metrics(_scored(spark, sf), "grp"), ["accuracy", "precision", "recall", "f1"])
    long = m.unpivot(["grp"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
    best = best_per_group(long, "metric", "grp", "value", out="best")
    return best.join(long.withColumnRenamed("grp", "best"), ["metric", "best"])
