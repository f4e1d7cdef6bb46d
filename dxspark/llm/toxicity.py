"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text, none of which depends on who wrote it or on its language
tag: densities of three learned lexicons and of a small fixed one, nearness of
second-person words to lexicon words, shares of capitals, of punctuation and of
obfuscated words (digits or signs between letters), and lengths.

The lexicons come from the labels of the training rows. Each word of a labelled
text stands for itself, for its beginnings of `STEMS` letters and for its plain
form (look-alike digits and signs as letters); for each such form the toxic and
clean documents are counted in one grouped aggregation over all training rows,
and the `MAX_TERMS` with the largest log-odds above `MIN_ODDS` kept. That small
table is broadcast; its size is bounded by `MAX_TERMS`. The labels of the training
rows are broadcast to the texts while they measure under `LABEL_BYTES`; beyond
that both sides are shuffled, with the same rows. A form's
counts would betray a training row's own label, so each row is scored with
lexicons learned from other rows: training rows fall in `FOLDS` folds, and the
features of a fold use the counts of the rest.

Trees are fitted on at most about `MAX_FIT` training rows (a hash of doc_id
chooses them). Of these one in three, by another hash, is left to the isotonic
calibration. The score is the calibrated probability of label 1.

Edge cases: null and empty texts have all features zero and get the score of
that point; a null doc_id counts as the text "" in the hashes; a labelled doc_id
that repeats trains once for each of its rows; if training rows lack one of the
classes every score is the share of label 1 (0 without rows); input columns
named as result columns are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import stored, table

STEMS = (4, 5, 6)
FOLDS = 3
MAX_TERMS = 3000
MIN_DOCS = 5
MIN_ODDS = 2.5
MAX_FIT = 60_000
#: forms a task counts before it hands them on
KEEP_FORMS = 400_000
#: the labels of the training rows are broadcast up to so many bytes, and shuffled with the texts beyond
LABEL_BYTES = 32 << 20
#: a few words of abuse, so that a corpus with few labels is not without any
FIXED = {"idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "hate"}
YOU = {"you", "your", "you're", "youre", "yours", "u", "ur", "du", "dich", "dein", "deine", "tu", "toi", "vous", "ton", "votre", "te", "ti", "usted", "eres"}
FEATURES = ["word_odds", "stem_odds", "plain_odds", "n_terms", "term_rate", "strong_rate", "fixed_rate", "you_rate", "near_you", "capital_rate", "shout_rate",
            "punct_rate", "bang_rate", "obfuscated_rate", "obfuscated_terms", "log_words", "mean_word", "repeat_rate", "max_odds", "top3_odds"]
_WORD = re.compile(r"[^\W_](?:[\w@$!*.'-]*[\w@$*])?")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"} | dict.fromkeys("*._'-", ""))


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")


def plain(word: str) -> str:
    return word.translate(_PLAIN)


def forms(word: str) -> set[str]:
    """What a word counts for: itself, its plain form, its beginnings."""
    p = plain(word)
    return {"w:" + word, "p:" + p, *(f"s{n}:{p[:n]}" for n in STEMS if len(p) > n)}


class Lexicon:
    """What each word adds to a text's features, remembered by word."""

    KEEP = 200_000

    def __init__(self, odds: dict[str, float]):
        def book(kind: str) -> dict[str, float]:
            return {f[len(kind):]: x for f, x in odds.items() if f.startswith(kind)}

        self.words, self.plains, self.stems = book("w:"), book("p:"), [(m, book(f"s{m}:")) for m in STEMS]
        self.seen: dict[str, tuple | None] = {}

    def weigh(self, w: str) -> tuple | None:
        """(odds of word, stem, plain form; largest; obfuscated, fixed, you), or
        None for a word that adds nothing."""
        p = w if w.isalpha() else plain(w)
        of_word, of_plain, of_stem = self.words.get(w, 0.0), self.plains.get(p, 0.0), 0.0
        for m, book in self.stems:
            if len(p) > m:
                of_stem = max(of_stem, book.get(p[:m], 0.0))
        top, rest = max(of_word, of_stem, of_plain), (p != w, p in FIXED, w in YOU)
        return (of_word, of_stem, of_plain, top, *rest) if top > 0 or any(rest) else None

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = _WORD.findall(text.lower())
        if not low:
            return [0.0] * len(FEATURES)
        n, bag, seen = len(low), set(low), self.seen
        if len(seen) > self.KEEP:
            seen.clear()
        for w in bag.difference(seen):
            seen[w] = self.weigh(w)
        hits = {w: x for w in bag if (x := seen[w]) is not None}
        found = [(k, hits[w]) for k, w in enumerate(low) if w in hits] if hits else []
        terms = [(k, x) for k, x in found if x[3] > 0]
        you = [k for k, x in found if x[6]]
        near = 0.0
        if terms and you:
            a, y = np.array([k for k, _ in terms]), np.array(you)
            i = np.searchsorted(y, a)
            gap = np.minimum(np.abs(a - y[np.minimum(i, len(y) - 1)]), np.abs(a - y[np.maximum(i - 1, 0)]))
            near = float((1 / (1 + gap)).max())
        best = sorted((x[3] for _, x in terms), reverse=True)[:3]
        raw = text.encode()
        letters = sum(map(len, low))
        total = lambda c: sum(x[c] for _, x in terms)
        return [total(0) / n, total(1) / n, total(2) / n, float(len(terms)), len(terms) / n, sum(x[3] >= 4 for _, x in terms) / n,
                sum(x[5] for _, x in found) / n, len(you) / n, near, (len(raw) - len(raw.translate(None, _CAPITALS))) / letters, len(_SHOUT.findall(text)) / n,
                sum(map(text.count, ".,;:!?")) / n, (text.count("!") + text.count("?")) / n, sum(x[4] for _, x in found) / n,
                float(sum(x[4] for _, x in terms)), math.log1p(n), letters / n, 1 - len(bag) / n, best[0] if best else 0.0, sum(best)]


def counted_forms(labelled: DataFrame) -> DataFrame:
    """(form, and for each fold k toxic<k> and clean<k>): labelled documents of
    a fold that have a form. Counted by number inside a task, and handed on
    when a task has `KEEP_FORMS` of them."""
    columns = [f"{c}{k}" for k in range(FOLDS) for c in ("clean", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}  # of each form
        numbers: dict[str, list[int]] = {}  # of each word's forms
        counts = np.zeros((len(columns), 0), np.int64)
        had = [array("i") for _ in columns]  # numbers not yet in counts, by fold and label

        def tallied() -> np.ndarray:
            total = np.pad(counts, ((0, 0), (0, len(number) - counts.shape[1])))
            for row, some in zip(total, had):
                row += np.bincount(np.array(some, np.intc), minlength=len(number))
            return total

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *map(pa.array, tallied())], ["form", *columns])

        for b in batches:
            for t, fold, y in zip(*b.columns, strict=True):
                found: set[int] = set()
                for w in set(_WORD.findall((t.as_py() or "").lower())):
                    if w not in numbers:
                        numbers[w] = [number.setdefault(f, len(number)) for f in forms(w)]
                    found.update(numbers[w])
                had[2 * fold.as_py() + y.as_py()].extend(found)
                if len(number) > KEEP_FORMS:
                    yield counted()
                    number.clear(), numbers.clear()
                    counts, had = counts[:, :0], [array("i") for _ in columns]
                elif sum(map(len, had)) > 4 * KEEP_FORMS:
                    counts, had = tallied(), [array("i") for _ in columns]
        yield counted()

    rows = labelled.select("text", "fold", "label").mapInArrow(run, "form string, " + ", ".join(f"{c} bigint" for c in columns))
    return rows.groupBy("form").agg(*[F.sum(c).alias(c) for c in columns])


def lexicons(labelled: DataFrame) -> list[dict[str, float]]:
    """Log-odds by form: one lexicon without each fold, the last from all."""
    sizes = {(r.fold, r.label): r["count"] for r in labelled.groupBy("fold", "label").count().collect()}
    counts = stored(counted_forms(labelled), "forms")
    out = []
    for left in [*range(FOLDS), None]:
        used = [k for k in range(FOLDS) if k != left]
        n_toxic, n_clean = (sum(sizes.get((k, y), 0) for k in used) for y in (1, 0))
        toxic, clean = (sum((F.col(f"{c}{k}") for k in used), F.lit(0)) for c in ("toxic", "clean"))
        odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
        rows = (counts.select("form", odds.alias("odds"), toxic.alias("n")).where((F.col("n") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
                .orderBy(F.desc("odds"), F.desc("n"), "form").limit(MAX_TERMS).collect())
        out.append({r.form: r.odds for r in rows})
    return out


def with_features(df: DataFrame, odds: list[dict[str, float]]) -> DataFrame:
    """`df` (columns text, fold and others) with FEATURES in place of the text;
    fold chooses the lexicon, null the last."""
    shared = df.sparkSession.sparkContext.broadcast(odds)
    others = [f for f in df.schema.fields if f.name not in ("text", "fold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Lexicon(x) for x in shared.value]
        for b in batches:
            col = dict(zip(b.schema.names, b.columns, strict=True))
            rows = [books[-1 if (k := f.as_py()) is None else k].features(t.as_py()) for t, f in zip(col["text"], col["fold"], strict=True)]
            table_ = np.array(rows, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(col[f.name] for f in others), *(pa.array(table_[:, j]) for j in range(len(FEATURES)))], [*(f.name for f in others), *FEATURES])

    return df.mapInArrow(run, T.StructType([*others, *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   max_fit: int = MAX_FIT, rounds: int = 25, depth: int = 4) -> DataFrame:
    """(id_col, held_out, score, predicted, n_terms) of every row of `docs`."""
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = F.crc32(name) % 5 == 0
    known = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 != 0))
    known = stored(known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")), "toxic_labels")
    known_bytes = known.agg(F.sum(F.octet_length(F.col(id_col).cast("string")) + 32)).first()[0] or 0
    if known_bytes <= LABEL_BYTES:
        known = F.broadcast(known)
    pick = F.pmod(F.xxhash64(F.lit(3), name), F.lit(1 << 30))
    train = stored(docs.where(~held).join(known, id_col).select(text, "label", F.pmod(F.xxhash64(F.lit(1), name), F.lit(FOLDS)).cast("int").alias("fold"),
                                                               (F.pmod(F.xxhash64(F.lit(2), name), F.lit(3)) == 0).alias("calibrate"), pick.alias("pick")), "toxic")
    n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    base = docs.select(id_col, held.alias("held_out"), text, F.lit(None).cast("int").alias("fold"))
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return base.select(id_col, "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), F.lit(0.0).alias("n_terms"))
    odds = lexicons(train)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    limit = int((1 << 30) * min(1.0, max_fit / sum(n.values())))
    fit = stored(vector.transform(with_features(train.where(F.col("pick") < limit).drop("pick"), odds)).select("label", "calibrate", "features"), "toxic_fit")
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=1, maxBins=64)
    model = trees.fit(fit.where("NOT calibrate").repartition(8))
    margin = vector_to_array("rawPrediction")[1]
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(model.transform(fit.where("calibrate")).select(margin.alias("margin"), F.col("label").cast("double")))
    scored = curve.setPredictionCol("p").transform(model.transform(vector.transform(with_features(base, odds))).withColumn("margin", margin))
    score = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    return scored.select(id_col, "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_terms")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
