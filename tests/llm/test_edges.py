"""Empty tables, clashing columns and odd rows through every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dxspark.llm import decontaminate, katz, langid, lines, mixing, quality, shard, simhash, toxicity, urls
from dxspark.llm.common import stored, table
from tests.conftest import SF_SMALL
from tests.llm import brute

CLASH = ["n", "h", "fp", "key", "row", "words", "_row", "line", "value", "score", "kept", "id"]


@pytest.fixture(scope="module")
def edge(spark):
    return stored(brute.edge_documents(spark), "edge")


def widened(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH) if c not in df.columns])


def operators(spark):
    bench, labels = table(spark, SF_SMALL, "benchmark"), table(spark, SF_SMALL, "labels")
    return {
        "lines": lambda d: lines.line_classes(d),
        "katz": lambda d: katz.katz_scores(d),
        "quality": lambda d: quality.quality(d),
        "simhash": lambda d: simhash.simhash_classes(d),
        "first_of_classes": lambda d: simhash.first_of_classes(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels, rounds=2, depth=2),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "sharding": lambda d: shard.shard_rows(d),
        "mixing": lambda d: mixing.mix(d),
    }


NAMES = ["lines", "katz", "quality", "simhash", "first_of_classes", "toxicity", "decontaminate", "sharding", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_documents(spark, name):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert operators(spark)[name](empty).collect() == []


@pytest.mark.parametrize("name", ["quality", "simhash", "first_of_classes", "toxicity", "decontaminate", "mixing"])
def test_other_columns_do_not_enter(spark, edge, name):
    """With columns whose names the operators might use themselves."""
    run = operators(spark)[name]
    narrow = run(edge)
    rows = lambda df: sorted(str([r[c] for c in narrow.columns]) for r in df.collect())
    assert rows(run(widened(edge)).select(*narrow.columns)) == rows(narrow)


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.filter_urls(pages).collect() == []
    assert langid.identify(pages, table(spark, SF_SMALL, "documents")).collect() == []


def test_pages_with_other_columns_and_a_long_text(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html lang=de>" + "das ist ein langer text und " * 40_000)], "page_id bigint, url string, html string")
    wide = pages.selectExpr("*", "'zz' AS host", "'p' AS path", "1 AS verdict", "2 AS lang", "'q' AS rule")
    assert langid.identify(pages, table(spark, SF_SMALL, "documents")).first().declared == "de"
    assert len(urls.filter_urls(wide.drop("host", "path", "verdict", "rule")).collect()) == 1


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_pipeline_stages_on_odd_rows(spark, edge, rows):
    """Every stage keeps the columns of documents, and takes null, empty, repeated
    and very long texts as well as no rows at all."""
    docs = edge if rows == "edge" else spark.createDataFrame([], brute.SCHEMA)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), f"odd-{name}")
        sizes.append(docs.count())
        if name != "sharding":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert all(a >= b for a, b in zip(sizes[:3], sizes[1:4], strict=True))
    assert sizes[-1] == sizes[-2] and (sizes[-1] > 0) == (rows == "edge")
