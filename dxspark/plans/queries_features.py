"""Registered queries: features, splits, folds (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dxspark.functions.scalars import upper_text
from dxspark.operators import features as J
from dxspark.operators import subwords as W
from dxspark.plans.fixtures import fx
from dxspark.plans.queries_agg import DIAG_COLS
from dxspark.plans.registry import query

STOP_SQL = ", ".join(f"'{w}'" for w in J.STOP_WORDS)


@query("label_encode", "SELECT visit_id, col AS \"column\", dense_rank() OVER (PARTITION BY col ORDER BY v) - 1 AS idx FROM ("
       + f"SELECT visit_id, unnest([{', '.join(repr(c) for c in DIAG_COLS)}]) AS col, "
       + f"unnest([{', '.join(f'''coalesce({c}, '')''' for c in DIAG_COLS)}]) AS v FROM fx_diag_wide) t")
def q_label_encode(spark, sf):
    return J.label_encode_long(fx(spark, sf, "fx_diag_wide"), ["visit_id"], DIAG_COLS)


PROVINCES = [*(f"NATION_{i}" for i in range(25)), "DESCONOCIDO", "NONE"]


@query("one_hot", f"""
SELECT visit_id, {', '.join(f"CAST(coalesce(upper(provincia), 'NONE') = '{p}' AS BIGINT) AS {p}" for p in PROVINCES)}
FROM fx_visits""")
def q_one_hot(spark, sf):
    v = fx(spark, sf, "fx_visits")
    return J.one_hot(v, ["visit_id"], F.coalesce(upper_text("provincia"), F.lit("NONE")), PROVINCES)


def _tfidf_sql(max_features: int) -> str:
    return rf"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM fx_all_text),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP_SQL}) GROUP BY 1, 2),
voc AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_features}),
n AS (SELECT count(*) AS n FROM fx_all_text),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + voc.df)) + 1.0) AS w FROM tf JOIN voc ON tf.term = voc.term, n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("tfidf", _tfidf_sql(500))
def q_tfidf(spark, sf):
    out = J.tfidf(fx(spark, sf, "fx_all_text"), "doc_id", "text", max_features=500)
    return out.withColumn("weight", F.round("weight", 6))


@query("split_random", """
SELECT visit_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(visit_id AS VARCHAR)), visit_id)
                          <= ceil(count(*) OVER () * 0.3) THEN 'test' ELSE 'train' END AS split
FROM fx_visits""")
def q_split_random(spark, sf):
    return J.split_random(fx(spark, sf, "fx_visits").select("visit_id"), "visit_id", 0.3, 42)


@query("split_stratified", """
SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id)
                               <= ceil(count(*) OVER (PARTITION BY label) * 0.3) THEN 'test' ELSE 'train' END AS split
FROM fx_text""")
def q_split_stratified(spark, sf):
    return J.split_stratified(fx(spark, sf, "fx_text").select("doc_id", "label"), "doc_id", "label", 0.3, 42)


@query("kfold_assign", """
SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM fx_text""")
def q_kfold_assign(spark, sf):
    return J.kfold_assign(fx(spark, sf, "fx_text").select("doc_id", "label"), "doc_id", "label", 5, 42)


@query("class_weights", """
SELECT t.doc_id, t.label, round(CASE WHEN t.label = 1 THEN 2.0 ELSE 1.0 END * c.n / (c.k * c.nc), 6) AS weight
FROM fx_text t JOIN (SELECT label, count(*) AS nc, sum(count(*)) OVER () AS n, count(*) OVER () AS k
                     FROM fx_text GROUP BY label) c ON t.label = c.label""")
def q_class_weights(spark, sf):
    out = J.class_weights(fx(spark, sf, "fx_text").select("doc_id", "label"), "label", positive=1, multiplier=2.0)
    return out.select("doc_id", "label", F.round("weight", 6).alias("weight"))


@query("tokenize_truncate", r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens,
       array_to_string(list_concat(t, list_transform(range(128 - len(t)), lambda i: '[PAD]')), ' ') AS tokens
FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1, 128) AS t FROM fx_all_text) s""")
def q_tokenize_truncate(spark, sf):
    out = J.tokenize_truncate(fx(spark, sf, "fx_all_text"), "doc_id", "text", 128)
    return out.select("doc_id", "n_tokens", F.array_join("tokens", " ").alias("tokens"))


#: rank file of a public tokenizer; it is not part of the repository
SUBWORD_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("tokenize_subwords")
def q_tokenize_subwords(spark, sf):
    return W.subword_ids(fx(spark, sf, "fx_all_text"), "doc_id", "text", W.sent_ranks(spark, SUBWORD_RANKS), 128)


@query("tokenize_subwords_check", """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS tokens_give_the_text, true AS cut_is_the_beginning, 128 AS n_cut FROM fx_all_text""")
def q_tokenize_subwords_check(spark, sf):
    """All tokens of a text give the text back; the cut ones are the first of them,
    and with padding always as many."""
    ranks = W.sent_ranks(spark, SUBWORD_RANKS)
    texts = fx(spark, sf, "fx_all_text")
    # lengths, digests and the beginnings are exchanged, not the texts and their tokens
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    whole = W.subword_text(W.subword_ids(texts, "doc_id", "text", ranks, None), "ids", ranks, "again").select(
        "doc_id", F.slice("ids", 1, 128).alias("first"), digest(F.col("again")).alias("again"))
    cut = W.subword_ids(texts, "doc_id", "text", ranks, 128).select("doc_id", "n_kept", "ids")
    begin = F.concat("first", F.array_repeat(F.lit(-1), 128 - F.col("n_kept")))
    text = F.coalesce("text", F.lit(""))
    own = texts.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), digest(text).alias("text"))
    return own.join(whole, "doc_id").join(cut, "doc_id").select(
        "doc_id", "n_bytes", (F.col("again") == F.col("text")).alias("tokens_give_the_text"),
        (F.col("ids") == begin).alias("cut_is_the_beginning"), F.size("ids").alias("n_cut"))
