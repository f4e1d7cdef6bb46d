"""Language of a web page by Bayesian fusion of four kinds of evidence.

- Text: hashed character trigrams of the page's visible text under one
  multinomial model for each language, learned from labelled documents. The
  trigrams of a text depend on each other, so the log-likelihood is the mean per
  trigram times at most `MAX_GRAMS`, times `TEMPER`.
- Markup: the language that the page declares (`lang` of html, or a
  content-language meta tag), with P(declared | language).
- Address suffix: the last label of the host, with P(suffix | language).
- Host: how its other pages read, smoothed towards its domain, that towards
  all pages.

The last three are not assumed but counted: text alone gives each page a
distribution over languages, and grouped sums of these by declared language,
suffix, host and domain give the tables. A page's own share is taken out of its
host's and domain's sums. Sums are pre-aggregated before the shuffle; the pages
meet the tables in joins whose sides are both dealt anew, so that AQE can split
a host with a third of all pages.

The models are fitted on at most about `MAX_TRAIN` documents per language, which
a hash of the id chooses; counts and tables cover every page. At most
`MAX_LANGS` languages may occur, which bounds the broadcast models.

Edge cases: a null or empty page has no text and no declaration, a null url an
empty host, so that only the other evidence speaks; ties go to the language that
sorts first; repeated rows are judged each; without any labelled document `lang`
and `confidence` are null; input columns named as result columns are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxspark.llm.common import stored, table
from dxspark.llm.urls import parts

BUCKETS = 1 << 16
MAX_TRAIN = 4000
MAX_LANGS = 200
MAX_GRAMS = 300
TEMPER = 0.25
SMOOTH = 5.0
MADE = {"host", "declared", "suffix", "text_lang", "lang", "confidence", "n_grams", "domain", "loglik", "q", "_url", "_html"}
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_HTML_LANG = re.compile(r"""(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_META_LANG = re.compile(r"""(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a text's letters."""
    plain = " " + _NO_LETTER.sub(" ", text).lower().strip() + " "
    c = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 4:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77)) ^ (c[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64) % BUCKETS


def visible(page: str) -> str:
    return html.unescape(_HIDDEN.sub(" ", page))


def declared(page: str) -> str | None:
    head = page.split("<body", 1)[0]
    m = _HTML_LANG.search(head) or _META_LANG.search(head)
    return m[1].lower() if m else None


def gram_models(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int) -> tuple[list[str], np.ndarray]:
    """The languages, and log P(bucket | language), buckets by row."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    lang = F.lower(F.col(lang_col))
    sizes = {r[0]: r[1] for r in docs.where(lang.isNotNull()).groupBy(lang.alias("l")).count().orderBy("l").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int((1 << 30) * min(1.0, max_train / sizes[k])))])
    used = docs.where(lang.isNotNull()).where(F.pmod(F.xxhash64(F.lit(5), name), F.lit(1 << 30)) < share[lang]).select(F.col(text_col).cast("string"), lang.alias("l"))
    index = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(index), BUCKETS), np.int64)
        for b in batches:
            for t, k in zip(*b.columns, strict=True):
                np.add.at(count[index[k.as_py()]], grams(t.as_py() or ""), 1)
        i, j = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(count[i, j])], ["l", "b", "n"])

    count = np.zeros((BUCKETS, len(langs)))
    for r in used.mapInArrow(run, "l int, b int, n bigint").groupBy("b").pivot("l", list(range(len(langs)))).sum("n").collect():
        count[r[0]] = [x or 0 for x in r[1:]]
    return langs, np.log((count + 0.5) / (count.sum(0) + 0.5 * BUCKETS))


def identify(pages: DataFrame, docs: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", keep_html: bool = True, max_train: int = MAX_TRAIN) -> DataFrame:
    """`pages` with host, declared, suffix, text_lang (text alone), lang,
    confidence and n_grams."""
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in MADE and (keep_html or c != html_col)]
    langs, model = gram_models(docs, id_col, text_col, lang_col, max_train)
    n = len(langs)
    shared = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    rest = len(kept)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for url, page in zip(b.column(rest), b.column(rest + 1), strict=True):
                host, page = parts(url.as_py())[0].rsplit("@", 1)[-1].split(":", 1)[0], page.as_py() or ""
                g = grams(visible(page))
                at = model[g].mean(0, dtype=float) * min(len(g), MAX_GRAMS) * TEMPER if len(g) else np.zeros(model.shape[1])
                q = np.exp(at - at.max(initial=-np.inf))
                rows.append((host, ".".join(host.split(".")[-2:]), host.rsplit(".", 1)[-1], declared(page), len(g), at.tolist(), (q / q.sum()).tolist() if len(q) else []))
            kinds = [pa.string()] * 4 + [pa.int64()] + [pa.list_(pa.float64())] * 2
            new = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:rest], *new], [*b.schema.names[:rest], "host", "domain", "suffix", "declared", "n_grams", "loglik", "q"])

    given = pages.select(*kept, F.col(f"`{url_col}`").cast("string").alias("_url"), F.col(f"`{html_col}`").cast("string").alias("_html"))
    made = T.StructType.fromDDL("host string, domain string, suffix string, declared string, n_grams bigint, loglik array<double>, q array<double>")
    schema = T.StructType([*pages.select(*kept).schema.fields, *made.fields])
    seen = stored(given.mapInArrow(read, schema), "langid")
    if not n:
        return seen.select(*kept, "host", "declared", "suffix", *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(None).cast("double").alias("confidence"), "n_grams")
    mass = [F.sum(F.col("q")[i]) for i in range(n)]
    by_host = stored(seen.groupBy("host", "domain").agg(F.array(*mass).alias("m")), "langid_hosts")
    vector = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    everything = by_host.agg(vector("m")).first()[0] or [0.0] * n
    everything = [x or 0.0 for x in everything]
    total = sum(everything)
    root = F.array(*[F.lit((x + 1.0) / (total + n)) for x in everything])
    own = F.col("q")
    zipped = lambda a, b, f: F.zip_with(a, b, f)
    by_domain = by_host.groupBy("domain").agg(vector("m").alias("dm"))
    hosts = stored(by_host.join(by_domain, "domain").select("host", "m", "dm"), "langid_priors")
    by_declared = stored(seen.where("declared IS NOT NULL").groupBy("declared").agg(F.array(*mass).alias("lm")), "langid_declared")
    by_suffix = stored(seen.groupBy("suffix").agg(F.array(*mass).alias("sm")), "langid_suffix")
    n_declared, n_suffix = by_declared.count(), by_suffix.count()
    each = F.array(*[F.lit(float(x)) for x in everything])
    told = zipped(F.col("lm"), each, lambda a, t: F.log((a + 0.1) / (t + 0.1 * (n_declared + 1))))
    placed = zipped(F.col("sm"), each, lambda a, t: F.log((a + 0.1) / (t + 0.1 * (n_suffix + 1))))
    left = lambda c: F.transform(zipped(F.col(c), own, lambda a, x: a - x), lambda x: F.greatest(x, F.lit(0.0)))
    size = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    none = F.array(*[F.lit(0.0)] * n)
    df = (seen.join(hosts, "host").join(by_declared, "declared", "left").join(by_suffix, "suffix")
          .withColumn("m", left("m")).withColumn("dm", left("dm")).withColumn("_mn", size("m")).withColumn("_dn", size("dm")))
    domain = zipped(F.col("dm"), root, lambda a, p: (a + SMOOTH * p) / (F.col("_dn") + SMOOTH))
    df = df.withColumn("_p", zipped(F.col("m"), domain, lambda a, p: (a + SMOOTH * p) / (F.col("_mn") + SMOOTH)))
    fused = zipped(zipped(F.col("loglik"), F.coalesce(told, none), lambda a, b: a + b), zipped(placed, F.col("_p"), lambda a, p: a + F.log(p)), lambda a, b: a + b)
    df = df.withColumn("_f", fused)
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda c: F.get(names, F.array_position(F.col(c), F.array_max(c)).cast("int") - 1)
    norm = F.aggregate(F.col("_f"), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_f")))
    return df.select(*kept, "host", "declared", "suffix", pick("loglik").alias("text_lang"), pick("_f").alias("lang"), (1 / norm).alias("confidence"), "n_grams")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return identify(pages, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_html=False).drop("url")
