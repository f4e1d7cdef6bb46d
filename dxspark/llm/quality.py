"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits to 0, runs of blanks to one) and
hashed; for every host (the `host_col`) and line hash the different documents
that hold it are counted. A line above both limits, at least `min_docs`
documents and more than `max_share` of the host's, is boilerplate and removed.
A document is depleted, and rejected, if removal leaves it less than
`min_words` words or less than `min_left` of its words. The share makes the
rule behave alike at any size.

Different documents are different texts: exact copies count once, so a text
copied a thousand times is not its own boilerplate. Pages that share a template
and differ in a line of their own are different texts. Copies that were merely
edited are not: what such a text has besides the frequent lines is again made of
passages that many texts of the host have. So the lines above the limits are
counted a second time, where a text has content of its own if more than half of
the passages of its other lines are neither in a frequent line nor above the
limits themselves. Passages part a line at words whose hash is below those of
both neighbours, so every word is in one, and an edit changes those around it.
In each host, all texts without own content count as one document, for the line and for
the host. A line goes if it is above both limits in both counts.

The base rules of a text: at least `min_words` words, and no more than 20 % of
its words inside 5-word windows that occur twice or more in it.

Scale: per-document figures are array expressions in the scan, nothing is
shuffled for them. (host, line hash, text hash) triples are shuffled, made
distinct per text and pre-aggregated by hash. Of texts with a frequent line the
passages, about one for three words, are exchanged once to be counted. Those
above the limits are at most 1 / `max_share` times the mean number of passages
per document for each large host; a text's are looked up among them where they
are. The flagged line hashes, at most 1 / `max_share`
times the mean number of lines per document for each host, go back by host and
are joined by host and hash, never by text.

Edge cases: null and empty texts have no word and fail the base rules; a null
host is a host of its own; repeated rows are judged each and counted once;
a text of one long line is one line; an empty table gives an empty result;
input columns named as result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import n_words, stored, table, words

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT = 20
MIN_DOCS = 10
MAX_SHARE = 0.005
MIN_LEFT = 0.2
MADE = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_left_words", "clean_text"}


def _repeat_words(df: DataFrame, size: int = WINDOW) -> DataFrame:
    """Adds `_repeat`: the words of `_w` in `size`-word windows occurring twice.

    Windows are compared by 64-bit hashes of their words' hashes. Most texts have
    none twice, which one set of the hashes shows; only for the others are
    (hash, place) pairs sorted. The places of equal neighbours, in order, cover
    `size` words each, less where the next one begins earlier.
    """
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_v", F.when(F.size("_h") > size, F.transform(F.sequence(F.lit(0), F.size("_h") - size), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(size)]))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_v")) < F.size("_v"), F.sort_array(F.transform("_v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get("_s", k)["x"] == e["x"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])))
    spans = F.transform("_p", lambda e, k: F.least(F.lit(size), F.coalesce(F.get("_p", k + 1) - e, F.lit(size))))
    total = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return df.withColumn("_repeat", F.coalesce(total, F.lit(0).cast("bigint"))).drop("_h", "_v", "_s", "_p")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _normal(line: Column) -> Column:
    """A line in lower case, blanks and digits run together."""
    return F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D0-9]+", " "))


def line_hash(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(_normal(line))


def _host(host_col: str) -> Column:
    """The host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit(""))


def _passages(lines: Column) -> Column:
    """Different hashes of the passages of normalised lines: a passage goes from a
    word whose hash is a local minimum, or the first, to the next such, with it."""
    hashes = lambda x: F.transform(F.array_remove(F.split(x, " "), ""), lambda w: F.xxhash64(w))
    starts = lambda h: F.filter(F.transform(h, lambda _, i: i), lambda i: (i == 0) | ((F.get(h, i) < F.get(h, i - 1)) & (F.get(h, i) <= F.get(h, i + 1))))
    parts = lambda e: F.transform(e["s"], lambda a, k: F.xxhash64(F.slice(e["h"], a + 1, F.coalesce(F.get(e["s"], k + 1), F.size(e["h"])) - a + 1)))
    cut = F.transform(F.transform(lines, hashes), lambda h: F.struct(h.alias("h"), starts(h).alias("s")))
    return F.array_distinct(F.flatten(F.transform(cut, parts)))


def _above(n: str, min_docs: int, max_share: float) -> Column:
    return (F.col(n) >= min_docs) & (F.col(n) > max_share * F.col("host_docs"))


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_host, line, n_docs, host_docs): the normalised lines above both limits,
    in how many different documents of their host each stands, and how many
    there are in it."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.where(_has_word(text)).select(_host(host_col).alias("_host"), F.xxhash64(text).alias("doc"), F.filter(F.split(text, "\n"), _has_word).alias("lines"))
    each = rows.select("_host", "doc", F.explode(F.array_distinct(F.transform("lines", line_hash))).alias("line")).distinct()
    hosts = stored(rows.select("_host", "doc").distinct().groupBy("_host").agg(F.count("*").alias("host_docs")), "host_docs")
    often = stored(each.groupBy("_host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
                   .join(hosts, "_host").where(_above("n_docs", min_docs, max_share)).select("_host", "line"), "often")

    # one generated row each, so that filters do not compute the arrays again
    by_host = often.groupBy("_host").agg(F.collect_list("line").alias("_often"))
    normal = F.transform("lines", lambda x: F.struct(_normal(x).alias("x"), line_hash(x).alias("h")))
    split = rows.join(by_host, "_host").select("_host", "doc", "_often", F.inline(F.array(F.struct(normal.alias("lines")))))
    split = split.select("_host", "doc", F.inline(F.array(F.struct(
        F.filter("lines", lambda e: F.array_contains("_often", e["h"])).alias("hit"), F.filter("lines", lambda e: ~F.array_contains("_often", e["h"])).alias("rest")))))
    passages = lambda c: _passages(F.array_distinct(F.transform(c, lambda e: e["x"])))
    having = stored(split.where(F.size("hit") > 0).select("_host", "doc", F.array_distinct(F.transform("hit", lambda e: e["h"])).alias("lines"),
                    passages("hit").alias("known"), passages("rest").alias("own")), "having_often")

    own = having.select("_host", "doc", F.explode("own").alias("passage"))
    # one exchange: what is dealt by host and passage stays so for both counts; copies of a text count once
    common = (own.repartition("_host", "passage").distinct().groupBy("_host", "passage").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
              .join(hosts, "_host").where(_above("n", min_docs, max_share)))
    known = stored(having.select("_host", F.explode("known").alias("passage")).unionByName(common.select("_host", "passage")).distinct(), "known")
    new = own.join(known.withColumn("known", F.lit(1)), ["_host", "passage"], "left").groupBy("_host", "doc").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))
    different = new.where(2 * F.col("n_known") < F.col("n")).select("_host", "doc", F.lit(1).alias("own"))
    judged = having.select("_host", "doc", "lines").join(different, ["_host", "doc"], "left")
    judged = stored(judged.select("_host", F.explode("lines").alias("line"), "doc", "own").unionByName(judged.select("_host", F.lit(None).cast("bigint").alias("line"), "doc", "own")).distinct(), "judged")
    others = (judged.where("line IS NULL AND own IS NULL").groupBy("_host").agg(F.count("*").alias("n_others")))
    counted = judged.where("line IS NOT NULL").groupBy("_host", "line").agg((F.count("own") + F.max(F.col("own").isNull().cast("bigint"))).alias("n_docs"))
    left = F.col("host_docs") - F.coalesce(F.col("n_others") - 1, F.lit(0))
    hosts = hosts.join(others, "_host", "left").select("_host", left.alias("host_docs"))
    return counted.join(hosts, "_host").where(_above("n_docs", min_docs, max_share))


def quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT,
            min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, keep_text: bool = True) -> DataFrame:
    """`docs` with the base figures, the verdict, n_removed_lines, n_left_words
    and, with `keep_text`, clean_text (the text without removed lines)."""
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in MADE and (keep_text or c != text_col)]
    often = frequent_lines(docs, text_col, host_col, min_docs, max_share)
    flagged = stored(often.groupBy("_host").agg(F.collect_list("line").alias("_often")), "flagged")

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("_text"), _host(host_col).alias("_host")).join(flagged, "_host", "left")
    df = df.withColumn("_lines", F.split("_text", "\n")).withColumn("_w", words(F.col("_text")))
    df = df.withColumn("_left", F.when(F.col("_often").isNotNull(), F.filter("_lines", lambda x: ~F.array_contains(F.col("_often"), line_hash(x)))).otherwise(F.col("_lines")))
    full = F.filter("_lines", _has_word)
    df = _repeat_words(df.withColumn("_full", full))
    # one generated row each: a filter on the verdict stays above it, and does
    # not compute the array expressions a second time below
    figures = F.struct(
        F.size("_w").cast("bigint").alias("n_words"), F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), (F.size("_lines") - F.size("_left")).cast("bigint").alias("n_removed_lines"))
    df = df.select(*keep, "_text", "_left", F.inline(F.array(figures)))
    removed = F.col("n_removed_lines") > 0
    left = F.when(removed, n_words(F.array_join("_left", "\n")).cast("bigint")).otherwise(F.col("n_words"))
    df = df.withColumn("n_left_words", left)
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("n_left_words") < min_words) | (F.col("n_left_words") < min_left * F.col("n_words"))
    clean = F.when(removed, F.array_join("_left", "\n")).otherwise(F.col("_text")).alias("clean_text")
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                     (~base_failed & ~depleted).alias("kept"), "n_removed_lines", "n_left_words", *([clean] if keep_text else []))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality(docs, keep_text=False).drop("source")

