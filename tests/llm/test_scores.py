from __future__ import annotations

import collections
import zlib

import duckdb

from dxspark.llm import langid, toxicity, urls
from dxspark.llm.common import stored, table
from dxspark.llm.queries import ORACLES, op9_urls
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute


def test_urls_match_sql(spark):
    got = sorted(tuple(r) for r in op9_urls(spark, SF_SMALL).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    assert got == sorted(duckdb.sql(ORACLES["op9_urls"]).fetchall())


def test_url_cases(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/casino"), (4, "http://A.EXAMPLE.org/es/x?casino"), (5, "http://b.org"), (6, "http://b.net/casino#x"),
            (7, "http://b.net/casinos"), (8, "http://ads.b.net/x?bet"), (9, "http://ads.b.net/bet-now/bet"), (10, "http://b.net/ads/ads"), (11, "x://c.com/fr/porn"),
            (12, "http://example.org/en/12"), (13, "http://notexample.org/en/12"), (14, "http://b.net/" + "a/" * 50_000 + "xxx"), (14, "http://b.net/")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string")).collect()
    got = [(r.page_id, r.rule, r.verdict) for r in out]
    assert got == [(1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, "example.org/es/", "block"), (5, None, "allow"), (6, None, "block"),
                   (7, None, "allow"), (8, None, "allow"), (9, None, "block"), (10, None, "allow"), (11, "com/fr/", "allow"),
                   (12, "example.org/en/1", "block"), (13, "org/", "allow"), (14, None, "block"), (14, None, "allow")]
    assert [(r.host, r.path) for r in out][3:5] == [("a.example.org", "/es/x"), ("b.org", "")]


def test_toxicity(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    extra = brute.edge_documents(spark).withColumn("doc_id", brute.F.col("doc_id") + 10_000_000)
    out = toxicity.score_toxicity(docs.unionByName(extra), labels, rounds=5, depth=3).collect()
    assert len(out) == docs.count() + extra.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)
    none = toxicity.score_toxicity(docs.limit(5), labels.where("doc_id < 0")).collect()
    assert len(none) == 5 and all(r.score == 0 for r in none)


def test_forms_by_brute_force(spark, monkeypatch):
    """Counts do not depend on how often a task hands on what it has."""
    docs = table(spark, SF_CHECK, "documents").selectExpr("doc_id", "text").unionByName(brute.edge_documents(spark).select("doc_id", "text"))
    rows = docs.selectExpr("text", "cast(coalesce(doc_id, 0) % 3 as int) AS fold", "cast(coalesce(doc_id, 1) % 2 as int) AS label")
    expected = collections.Counter()
    for r in rows.collect():
        for f in set().union(*map(toxicity.forms, toxicity._WORD.findall((r.text or "").lower()))):
            expected[f, ("toxic" if r.label else "clean") + str(r.fold)] += 1
    for keep in (300, toxicity.KEEP_FORMS):
        monkeypatch.setattr(toxicity, "KEEP_FORMS", keep)
        out = toxicity.counted_forms(rows).collect()
        got = {(r.form, c): r[c] for r in out for c in r.asDict() if c != "form" and r[c]}
        assert got == expected and len(out) == len({f for f, _ in expected})


def test_labels_shuffled_or_broadcast(spark, monkeypatch):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    labels = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 0, 1), (1, 0, None), (2, 0, 7)], labels.schema))
    score = lambda: sorted(tuple(r) for r in toxicity.score_toxicity(docs, labels, rounds=2, depth=2).collect())
    first = score()
    monkeypatch.setattr(toxicity, "LABEL_BYTES", 0)
    assert score() == first


def test_language(spark):
    pages, docs = table(spark, SF_CHECK, "pages"), table(spark, SF_CHECK, "documents")
    odd = spark.createDataFrame([(9000, None, None), (9001, "http://x.y/", ""), (9002, "u", "<html lang=fr>"), (9002, "u", "<html lang=fr>")], "page_id bigint, url string, html string")
    out = stored(langid.identify(pages.unionByName(odd), docs), "l").collect()
    assert len(out) == pages.count() + 4 and all(0 < r.confidence <= 1 + 1e-9 for r in out)
    known = [r for r in out if r.page_id < 9000]
    assert sum(r.lang == r.declared for r in known) >= 0.97 * len(known)
    none = langid.identify(odd, docs.where("doc_id < 0")).collect()
    assert [r.lang for r in none] == [None] * 4


def test_text_model_alone(spark):
    """Languages of documents that the model did not see, read as pages."""
    docs = table(spark, SF_CHECK, "documents")
    seen, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 AND length(text) > 200")
    pages = rest.selectExpr("doc_id AS page_id", "CAST(NULL AS STRING) AS url", "text AS html", "lang AS truth")
    out = langid.identify(pages, seen).collect()
    assert sum(r.text_lang == r.truth for r in out) >= 0.95 * len(out)
