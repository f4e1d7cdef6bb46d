"""Evaluation operators (inventory K7-K15) as aggregations over a scored
table `(group, y, pred, score)`; `group` is the model / dataset key.

All metrics of all models come from one `groupBy(group)` pass. ROC points and
the exact, tie-aware AUC use running sums over the distinct scores of a group,
computed through range buckets (no single-partition window), so a group with
billions of distinct scores still spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.operators.ordering import join_groups, ordered_running


def _safe_div(a: Column, b: Column) -> Column:
    """Zero division gives 0, as the reference's metric functions do."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary_counts(scored: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return scored.groupBy(group).agg(F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"),
                                     F.count_if(yy & ~pp).alias("fn"), F.count_if(~yy & ~pp).alias("tn"),
                                     F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """K8: counts by (true, predicted) on the complete 2x2 grid (zero cells
    present), in one aggregation; a null group is a group."""
    grid = [(a, b) for a in (0, 1) for b in (0, 1)]
    counts = scored.groupBy(group).agg(*[F.count_if((F.col(y) == a) & (F.col(pred) == b)).alias(f"_{a}{b}") for a, b in grid])
    cells = F.array(*[F.struct(F.lit(a).alias(y), F.lit(b).alias(pred), F.col(f"_{a}{b}").alias("n")) for a, b in grid])
    return counts.select(group, F.inline(cells))


def binary_metrics(scored: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """K9: accuracy, precision, recall, f1 of class 1 per group; 0 when undefined."""
    c = binary_counts(scored, group, y, pred)
    precision = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(group,
                    ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
                    precision.alias("precision"), recall.alias("recall"),
                    _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def classification_report(scored: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / f1 / support, then accuracy, macro
    and weighted averages, as rows (group, label, precision, recall, f1, support)."""
    c = binary_counts(scored, group, y, pred)
    rows = []
    for cls, tp, fp, fn in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        p = _safe_div(F.col(tp), F.col(tp) + F.col(fp))
        r = _safe_div(F.col(tp), F.col(tp) + F.col(fn))
        f = _safe_div(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))
        rows.append(F.struct(F.lit(cls).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                             (F.col(tp) + F.col(fn)).alias("support")))
    per = c.select(group, "n", "tp", "tn", F.array(*rows).alias("_r"))
    classes = per.select(group, F.inline("_r"))
    avg = per.select(
        group, F.lit("macro avg").alias("label"),
        F.aggregate("_r", F.lit(0.0), lambda a, x: a + x["precision"]).alias("precision"),
        F.aggregate("_r", F.lit(0.0), lambda a, x: a + x["recall"]).alias("recall"),
        F.aggregate("_r", F.lit(0.0), lambda a, x: a + x["f1"]).alias("f1"), F.col("n").alias("support"))
    avg = avg.select(group, "label", (F.col("precision") / 2).alias("precision"), (F.col("recall") / 2).alias("recall"),
                     (F.col("f1") / 2).alias("f1"), "support")
    def weighted(m: str) -> Column:
        return F.aggregate("_r", F.lit(0.0), lambda a, x: a + x[m] * x["support"]) / F.col("n")

    wavg = per.select(group, F.lit("weighted avg").alias("label"),
                      *[weighted(m).alias(m) for m in ("precision", "recall", "f1")], F.col("n").alias("support"))
    acc = per.select(group, F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     ((F.col("tp") + F.col("tn")) / F.col("n")).alias("f1"), F.col("n").alias("support"))
    return classes.unionByName(acc).unionByName(avg).unionByName(wavg)


def _score_table(scored: DataFrame, group: str, y: str, score: str) -> DataFrame:
    """One row per (group, distinct score) with positive / negative counts."""
    return scored.groupBy(group, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"),
                                            F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def roc_curve(scored: DataFrame, group: str, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, ties merged,
    starting at (0, 0) with threshold +inf. No point is dropped. A rate over a
    class that the group lacks is null."""
    t = _score_table(scored, group, y, score)
    run = ordered_running(t, [F.col(score).desc()], groups=[group], sums=["pos", "neg"], pos=None)
    tot = run.groupBy(group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = join_groups(run, tot, [group]).select(
        group, F.col(score).cast("double").alias("threshold"),
        F.when(F.col("_N") > 0, F.col("cum_neg") / F.col("_N")).alias("fpr"),
        F.when(F.col("_P") > 0, F.col("cum_pos") / F.col("_P")).alias("tpr"))
    start = tot.select(group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(scored: DataFrame, group: str, y: str = "y", score: str = "score") -> DataFrame:
    """Exact tie-aware area: sum over scores of pos * (negatives below +
    half the tied negatives), divided by P * N. Equals pair counting. Null where
    a group has one class only."""
    t = _score_table(scored, group, y, score)
    run = ordered_running(t, [F.col(score).asc()], groups=[group], sums=["neg"], pos=None)
    part = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + 0.5 * F.col("neg"))
    agg = run.groupBy(group).agg(F.sum(part).alias("_a"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pairs = F.col("_P").cast("double") * F.col("_N")
    return agg.select(group, F.when(pairs > 0, F.col("_a") / pairs).alias("auc"))


def metric_table(scored: DataFrame, group: str, y: str = "y", pred: str = "pred",
                 score: str = "score") -> DataFrame:
    """Long (metric, model, value): K9 + K12 for every model."""
    m = join_groups(binary_metrics(scored, group, y, pred), roc_auc(scored, group, y, score), [group])
    return m.unpivot([group], ["accuracy", "precision", "recall", "f1", "auc"], "metric", "value") \
        .withColumnRenamed(group, "model")


def compare_models(scored: DataFrame, group: str, models: Sequence[str], y: str = "y", pred: str = "pred",
                   score: str = "score", digits: int = 4) -> DataFrame:
    """Metric x model table, half-even rounded, with the best of `models` per
    metric on unrounded values (ties to the first in `models` order; an
    undefined value never wins over a number)."""
    long = metric_table(scored, group, y, pred, score).where(F.col("model").isin(list(models)))
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    rank = F.struct(F.col("value").isNull().alias("u"), (-F.col("value")).alias("v"), order.alias("o"))
    return long.groupBy("metric").agg(
        *[F.bround(F.max(F.when(F.col("model") == m, F.col("value"))), digits).alias(m) for m in models],
        F.min_by("model", rank).alias("best"))


def subset_accuracy(scored: DataFrame, order: str, n: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy on the first n rows of a defined order."""
    head = scored.orderBy(order).limit(n)
    return head.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def training_log_best(logs: DataFrame, model: str, log_col: str = "log_history", metric: str = "eval_f1",
                      step: str = "step") -> DataFrame:
    """Best step per model from per-step log records; records without
    the metric are training rows. Ties go to the earliest step."""
    rec = logs.select(model, F.explode(log_col).alias("_r")).select(
        model, F.col(f"_r.{step}").alias("step"), F.col(f"_r.{metric}").alias("metric"))
    rec = rec.where(F.col("metric").isNotNull())
    best = F.min_by(F.struct("step", "metric"), F.struct((-F.col("metric")).alias("m"), F.col("step").alias("s")))
    return rec.groupBy(model).agg(best.alias("_b")).select(
        model, F.col("_b.step").alias("best_step"), F.col("_b.metric").alias("best_" + metric))


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence], id_col: str = "candidate_id") -> DataFrame:
    """K7: every parameter combination as a row, values as text (None -> null),
    in scikit-learn's order (keys sorted, last key fastest). Built by
    successive explodes of small literal arrays (no join)."""
    keys = sorted(grid)
    df = spark.range(1).select(F.lit(0).cast("long").alias(id_col))
    for k in keys:
        vals = [None if v is None else str(v) for v in grid[k]]
        arr = F.array(*[F.lit(v).cast("string") for v in vals])
        df = df.select("*", F.posexplode(arr).alias(f"_p_{k}", k)) \
            .withColumn(id_col, F.col(id_col) * len(vals) + F.col(f"_p_{k}")).drop(f"_p_{k}")
    return df
