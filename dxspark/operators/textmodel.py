"""A text classifier trained by epochs (inventory K4).

The contract of a fine-tuned classifier: several passes over the training texts,
an evaluation after each, a log, and the pass with the best f1 as the result. The
model is a logistic regression on hashed, length-normalised TF-IDF, with the same
settings: learning rate with warm-up and decay, batch size, epochs, weight decay.

Words are hashed to `dims` features (no vocabulary is collected or cut; it is a
table of `dims` numbers however many words there are). A pass is one Spark job:
each task goes through its rows in batches, starting at the pass's weights, and
hands on the changes of the features that it met; the changes are summed by
feature and averaged over rows. Only vectors of `dims` numbers are held by the
driver and sent to the tasks. Passes read a checkpointed table, so a lost executor
repeats its tasks from the same rows in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.operators.features import STOP_WORDS, WORD_PATTERN, tokens

DIMS = 1 << 18
#: tasks of a training pass at most; each hands on at most `dims` rows
SHARDS = 64


def term_id(word: Column, dims: int) -> Column:
    """Feature of a lower-case word; -1 for stop words and single characters."""
    no_term = word.isin(*STOP_WORDS) | (F.length(word) < 2)
    return F.when(no_term, F.lit(-1)).otherwise(F.pmod(F.xxhash64(word), F.lit(dims)).cast("int"))


def term_ids(text, dims: int = DIMS) -> Column:
    """The features of a text's words, in order, repeats included (null: none)."""
    words = F.filter(tokens(text, WORD_PATTERN), lambda w: ~w.isin(*STOP_WORDS))
    return F.coalesce(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int")), F.array().cast("array<int>"))


def _unit(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text and their values, of length 1."""
    at, tf = np.unique(ids, return_counts=True)
    x = tf * idf[at]
    return at, x / np.sqrt((x * x).sum()) if len(at) else x


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield flat[a:b]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class HashedTextModel:
    """Weights per feature, as `transform` and the explanations use them."""

    spark: SparkSession
    text: str
    weights: np.ndarray
    bias: float
    idf: np.ndarray
    epoch: int = 0
    log: list[dict] = field(default_factory=list)

    def shared(self):
        """The model's arrays, sent to each executor once."""
        if getattr(self, "_sent", None) is None:
            self._sent = self.spark.sparkContext.broadcast((self.weights, self.bias, self.idf))
        return self._sent

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `probability` (vector) and `prediction`, like an ML model."""
        sent = self.shared()

        @F.pandas_udf("double")
        def p1(ids: pd.Series) -> pd.Series:
            w, b, idf = sent.value
            return pd.Series([float(sigmoid(b + w[at] @ x)) for at, x in (_unit(np.asarray(v, np.int64), idf) for v in ids)])

        p = p1(term_ids(self.text, len(self.weights)))
        return (df.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1"))))
                .withColumn("prediction", (F.col("_p1") >= 0.5).cast("double")).drop("_p1"))


def inverse_frequencies(ids: DataFrame, dims: int) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of every feature, over the rows of `ids` (column ids)."""
    n = ids.count()
    counts = ids.select(F.explode(F.array_distinct("ids")).alias("i")).groupBy("i").count().toPandas()  # at most `dims` rows
    df = np.zeros(dims)
    df[counts["i"].to_numpy(np.int64)] = counts["count"]
    return np.log((1 + n) / (1 + df)) + 1


def _pass(rows: DataFrame, w: np.ndarray, g: np.ndarray, bias: tuple[float, float], idf: np.ndarray,
          rate, batch: int, decay: float, positive_weight: float) -> tuple[np.ndarray, np.ndarray, tuple[float, float], float]:
    """One pass: the averaged weights and sums of squared gradients, and the mean loss.

    rows: (y, ids). rate: step number -> learning rate."""
    dims = len(w)
    sent = rows.sparkSession.sparkContext.broadcast((w, g, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, g0, idf = sent.value
        w, g = np.append(w0, bias[0]), np.append(g0, bias[1])  # the last is the bias
        met = np.zeros(dims + 1, bool)
        n, loss, step, held = 0, 0.0, 0, []

        def update() -> None:
            nonlocal loss, step
            at = np.concatenate([a for a, _, _ in held])
            of = np.repeat(np.arange(len(held)), [len(a) for a, _, _ in held])
            x = np.concatenate([v for _, v, _ in held])
            y = np.array([v for _, _, v in held])
            p = sigmoid(np.bincount(of, w[at] * x, len(held)))
            cost = np.where(y > 0, positive_weight, 1.0)
            loss -= float((cost * np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-12, 1))).sum())
            grad_at, back = np.unique(at, return_inverse=True)
            grad = np.bincount(back, (cost * (p - y))[of] * x) / len(held)
            g[grad_at] += grad * grad
            lr = rate(step)
            w[grad_at] -= lr * grad / np.sqrt(g[grad_at] + 1e-8)
            w[grad_at[grad_at < dims]] *= 1 - lr * decay
            met[grad_at] = True
            step += 1
            held.clear()

        for b in batches:
            for y, ids in zip(b.column(0).to_pylist(), _rows(b.column(1)), strict=True):
                at, x = _unit(ids, idf)
                held.append((np.append(at, dims), np.append(x, 1.0), float(y)))
                n += 1
                if len(held) == batch:
                    update()
        if held:
            update()
        if n:
            at = np.flatnonzero(met)
            old_w, old_g = np.append(w0, bias[0])[at], np.append(g0, bias[1])[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, dims + 1), pa.int32()), pa.array(np.append((w[at] - old_w) * n, n)),
                                              pa.array(np.append((g[at] - old_g) * n, loss))], ["i", "dw", "dg"])

    changes = rows.mapInArrow(run, "i int, dw double, dg double").groupBy("i").agg(F.sum("dw").alias("dw"), F.sum("dg").alias("dg"))
    found = changes.toPandas()  # at most dims + 2 rows
    sent.destroy()
    rest = found[found["i"] == dims + 1]
    n, loss = (rest["dw"].iloc[0], rest["dg"].iloc[0]) if len(rest) else (1.0, 0.0)
    found = found[found["i"] <= dims]
    w, g, at = np.append(w, bias[0]), np.append(g, bias[1]), found["i"].to_numpy(np.int64)
    w[at] += found["dw"].to_numpy() / n
    g[at] += found["dg"].to_numpy() / n
    return w[:-1], g[:-1], (float(w[-1]), float(g[-1])), loss / n


def evaluate(model: HashedTextModel, rows: DataFrame) -> dict[str, float]:
    """Accuracy, precision, recall and f1 of the positive class; rows: (y, ids)."""
    sent = model.shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, idf = sent.value
        n = np.zeros((2, 2), np.int64)
        for batch in batches:
            for y, ids in zip(batch.column(0).to_pylist(), _rows(batch.column(1)), strict=True):
                at, x = _unit(ids, idf)
                n[int(y > 0), int(sigmoid(b + w[at] @ x) >= 0.5)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in n.ravel()], ["tn", "fp", "fn", "tp"])

    sums = rows.mapInArrow(run, "tn bigint, fp bigint, fn bigint, tp bigint").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).first()
    tn, fp, fn, tp = (sums[c] or 0 for c in ("tn", "fp", "fn", "tp"))
    share = lambda a, b: a / b if b else 0.0
    return {"eval_accuracy": share(tp + tn, tn + fp + fn + tp), "eval_precision": share(tp, tp + fp),
            "eval_recall": share(tp, tp + fn), "eval_f1": share(2 * tp, 2 * tp + fp + fn)}


def fit_text_epochs(train: DataFrame, valid: DataFrame, text: str, label: str = "label", epochs: int = 5,
                    learning_rate: float = 0.2, batch_size: int = 16, weight_decay: float = 0.01, warmup_ratio: float = 0.1,
                    positive_weight: float = 1.0, dims: int = DIMS, shards: int = SHARDS) -> HashedTextModel:
    """K4: train by passes, evaluate after each on `valid`, keep the pass of the
    best f1 (the first of equals). Rows without a label are left out; a null or
    empty text has no features.

    `log` of the result has a record per pass: step, loss, and the evaluation."""
    spark = train.sparkSession
    keep = lambda d: d.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), term_ids(text, dims).alias("ids"))
    rows = keep(train).checkpoint()
    held_out = keep(valid).checkpoint()
    idf = inverse_frequencies(rows, dims)
    n = rows.count()
    rows = rows.coalesce(min(shards, rows.rdd.getNumPartitions()))
    tasks = rows.rdd.getNumPartitions()
    steps = max(1, -(-n // (batch_size * tasks)))
    warm = max(1.0, warmup_ratio * steps * epochs)
    w, g, bias = np.zeros(dims), np.zeros(dims), (0.0, 0.0)
    best, log = None, []
    for epoch in range(1, epochs + 1):
        first = (epoch - 1) * steps

        def rate(step: int, first: int = first) -> float:
            at = first + step + 1
            return learning_rate * (at / warm if at < warm else max(0.05, 1 - (at - warm) / max(1.0, steps * epochs - warm + 1)))

        w, g, bias, loss = _pass(rows, w, g, bias, idf, rate, batch_size, weight_decay, positive_weight)
        model = HashedTextModel(spark, text, w, bias[0], idf, epoch)
        log.append({"step": epoch, "loss": float(loss), **evaluate(model, held_out)})
        if best is None or log[-1]["eval_f1"] > log[best.epoch - 1]["eval_f1"]:
            best = model
    best.log = log
    return best


def log_table(model: HashedTextModel, name: str = "text") -> DataFrame:
    """One row: (model, log_history), the form that `metrics.training_log_best` reads."""
    fields: Sequence[str] = ("step", "loss", "eval_accuracy", "eval_precision", "eval_recall", "eval_f1")
    schema = "model string, log_history array<struct<step:bigint," + ",".join(f"{c}:double" for c in fields[1:]) + ">>"
    return model.spark.createDataFrame([(name, [tuple(r[c] for c in fields) for r in model.log])], schema)
