"""Feature engineering and splitting (inventory J1-J8).

Vocabulary-sized tables (label vocabularies, the TF-IDF vocabulary) are the
only things joined to the data; the TF-IDF vocabulary is capped by
`max_features`, which is its proven size bound, so it is broadcast.
Splits and folds are exact: rows are ordered by md5(seed|id). A split is cut at
ceil(n * share) per class: counts per hash beginning find the cut, and each row
is compared with it where it is. Folds take positions from range buckets (no
single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxspark.functions.scalars import col
from dxspark.operators.lookup import rekeyed
from dxspark.operators.ordering import join_groups, ordered_running

# The word pattern (two or more word characters, Unicode) and a
# short English function-word list used as the default stop list.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
              "of", "on", "or", "that", "the", "this", "to", "was", "with")


# ------------------------------------------------------------------ J1

def label_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, idx): per column the sorted distinct values (null as '')
    numbered 0..n-1, like a label encoder fitted on the whole table."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
                      for c in cols])
    distinct = df.select(F.inline(cells)).distinct()
    ranked = ordered_running(distinct, ["value"], groups=["column"], pos="_p")
    return ranked.select("column", "value", (F.col("_p") - 1).alias("idx"))


def label_encode_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """J1 in long form: (ids..., column, idx)."""
    vocab = label_vocabulary(df, cols)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
                      for c in cols])
    long = df.select(*ids, F.inline(cells))
    blank = F.col("value") == ""
    found = rekeyed(vocab, "value", "_key").withColumnRenamed("column", "_column")
    rest = long.where(~blank).join(found, (F.col("column") == F.col("_column")) & (F.col("value") == F.col("_key")))
    return rest.select(*ids, "column", "idx").unionByName(long.where(blank).select(*ids, "column", F.lit(0).cast("long").alias("idx")))


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """J1 wide: one integer column per encoded column. Null and '' come first of
    all values, so they are 0 and never looked up."""
    vocab = label_vocabulary(df, cols)
    out = df
    for c in cols:
        value = F.col(c).cast("string")
        v = rekeyed(vocab.where((F.col("column") == c) & (F.col("value") != "")).select("value", F.col("idx").alias(c + suffix)), "value", f"_v_{c}")
        out = out.join(v, F.when(value != "", value) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}") \
            .withColumn(c + suffix, F.coalesce(c + suffix, F.lit(0).cast("long")))
    return out


# ------------------------------------------------------------------ J2

def one_hot(df: DataFrame, ids: Sequence[str], c, values: Sequence[str] | None = None,
            numeric: Sequence[str] = (), max_values: int = 10_000) -> DataFrame:
    """Each row with one 0/1 column per value; `numeric` columns pass through.

    Pass `values` to fix the columns. Otherwise they are the values found, read
    to the driver; more than `max_values` of them are an error. A null is 0 in
    every column."""
    if values is None:
        found = df.select(col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct().limit(max_values + 1).collect()
        if len(found) > max_values:
            raise ValueError(f"one_hot: more than {max_values} values")
        values = sorted(r["_v"] for r in found)
    return df.select(*ids, *numeric, *[F.coalesce((col(c) == v).cast("long"), F.lit(0)).alias(str(v)) for v in values])


# ------------------------------------------------------------------ J3

def tokens(text, pattern: str = WORD_PATTERN, lower: bool = True) -> Column:
    t = F.lower(col(text)) if lower else col(text)
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def ngrams(arr: Column, n_max: int) -> Column:
    """1..n_max-grams of a token array (joined by one blank), in order."""
    grams = arr
    for n in range(2, n_max + 1):
        k = n
        g = F.transform(F.sequence(F.lit(0), F.greatest(F.size(arr) - k, F.lit(-1))),
                        lambda i: F.array_join(F.slice(arr, i + 1, k), " "))
        grams = F.concat(grams, F.when(F.size(arr) >= k, g).otherwise(F.array().cast("array<string>")))
    return grams


def tfidf(df: DataFrame, id_col: str, text: str, max_features: int | None = 500,
          stop_words: Sequence[str] | None = STOP_WORDS, ngram_max: int = 1) -> DataFrame:
    """TF-IDF in long form (id, term, weight) with the conventions of the
    reference's vectorizer: lower-case, words of 2+ characters, stop words out,
    vocabulary = the `max_features` most frequent terms (ties by term),
    idf = ln((1 + n) / (1 + df)) + 1, raw counts, L2 norm per document."""
    toks = tokens(text)
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*stop_words))
    if ngram_max > 1:
        toks = ngrams(toks, ngram_max)
    terms = df.select(id_col, F.explode(toks).alias("term"))
    if max_features:  # the vocabulary first: only its terms are grouped by document
        most = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cf")).orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
        names = df.sparkSession.createDataFrame([(r["term"],) for r in most.collect()], "term string")  # at most max_features rows
        terms = terms.join(F.broadcast(names), "term")
    tf = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = df.count()  # one scalar
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf"))
    vocab = F.broadcast(vocab) if max_features else vocab
    w = tf.join(vocab, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


# ------------------------------------------------------------------ J4-J7

def _hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


#: hexadecimal digits of the hash that are counted to find a cut
CUT_DIGITS = 4
#: classes up to which the cuts are broadcast
CUT_CLASSES = 10_000


def _cuts(keyed: DataFrame, classes: Sequence[str], share: float) -> DataFrame:
    """(classes, _cut): the hash of the last test row of each class that has one.

    Counts per class and hash beginning (at most 16^CUT_DIGITS rows a class) say
    in which beginning the cut lies; only its rows, one in 16^CUT_DIGITS, are ranked."""
    counts = keyed.groupBy(*classes, "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*classes)
    runs = counts.select(*classes, "_p", "_n", F.sum("_n").over(whole.orderBy("_p")).alias("_upto"),
                         F.least(F.ceil(F.sum("_n").over(whole) * share), F.sum("_n").over(whole)).alias("_want"))
    at = runs.where((F.col("_want") > 0) & (F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
    at = _few(at.select(*classes, "_p", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_rank")))
    ranked = join_groups(keyed, at, [*classes, "_p"]).withColumn("_k", F.row_number().over(whole.orderBy("_h")))
    return _few(ranked.where(F.col("_k") == F.col("_rank")).select(*classes, F.col("_h").alias("_cut")))


def _few(per_class: DataFrame) -> DataFrame:
    """A table of at most one row a class, computed; broadcast if it has at most
    CUT_CLASSES rows, else checkpointed and joined as any other."""
    rows = per_class.limit(CUT_CLASSES + 1).collect()
    if len(rows) > CUT_CLASSES:
        return per_class.checkpoint()
    return F.broadcast(per_class.sparkSession.createDataFrame(rows, per_class.schema))


def _split(df: DataFrame, id_col: str, classes: Sequence[str], share: float, seed: int, out: str) -> DataFrame:
    h = F.coalesce(_hash(id_col, seed), F.lit(""))
    cuts = _cuts(df.select(*classes, h.alias("_h"), F.substring(h, 1, CUT_DIGITS).alias("_p")), classes, share)
    if classes:
        joined = join_groups(df, cuts, classes, "left")
    else:  # one value or none
        one = cuts.first()
        joined = df.withColumn("_cut", F.lit(one["_cut"] if one else None).cast("string"))
    return joined.withColumn(out, F.when(h <= F.col("_cut"), "test").otherwise("train")).drop("_cut")


def split_random(df: DataFrame, id_col: str, test_share: float = 0.3, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Exact split, the first ceil(n * share) rows in md5(seed|id) order are
    test. Rows with the same id stay together, on the side of the first of them;
    a null id comes first. The rows are not shuffled: they are compared with the cut."""
    return _split(df, id_col, [], test_share, seed, out)


def split_stratified(df: DataFrame, id_col: str, label: str, test_share: float = 0.3, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exact class shares: per class the first ceil(n_c * share) rows are
    test (as in `split_random`; a null label is a class)."""
    return _split(df, id_col, [label], test_share, seed, out)


def kfold_assign(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                 out: str = "fold") -> DataFrame:
    """Class-balanced folds, fold = (position within class - 1) mod k."""
    p = ordered_running(df.withColumn("_h", _hash(id_col, seed)), ["_h", id_col], groups=[label], pos="_pos")
    return p.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def class_weights(df: DataFrame, label: str, positive: int | None = None, multiplier: float = 1.0,
                  out: str = "weight") -> DataFrame:
    """Weight n / (k * n_c) ("balanced"), times `multiplier` for the positive
    class. Rows without a label are a class of their own."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # the window runs over the per-class table (one row per class), not the data
    everything = Window.partitionBy()
    per = counts.withColumn("_n", F.sum("_nc").over(everything)).withColumn("_k", F.count(F.lit(1)).over(everything))
    weight = F.col("_n") / (F.col("_k") * F.col("_nc"))
    if positive is not None:
        weight = F.when(F.col(label) == positive, weight * multiplier).otherwise(weight)
    return join_groups(df, per.select(label, weight.alias(out)), [label])


# ------------------------------------------------------------------ J8

def tokenize_truncate(df: DataFrame, id_col: str, text: str, max_len: int = 128, pad: str = "[PAD]",
                      out: str = "tokens") -> DataFrame:
    """Lower-case word tokens, cut to `max_len`, padded to exactly `max_len`;
    `n_tokens` counts the real (unpadded) tokens kept."""
    t = F.slice(tokens(text, TOKEN_PATTERN), 1, max_len)
    padded = F.concat(t, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(t)))
    return df.select(id_col, F.size(t).alias("n_tokens"), padded.alias(out))
