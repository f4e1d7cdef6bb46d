"""URL filter: allow and block rules, then a weighted vocabulary.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with
A-Z lower-cased; the path goes on up to `?`, `#` or the end. A rule is a host,
which also stands for its subdomains, and the beginning of a path; the longest
that fits decides. Where none does, one Aho-Corasick automaton counts the
vocabulary's terms in host and path: a term counts where no letter or digit
stands on either side of it. One strict term, or `min_soft` different soft ones,
block the url.

Rows are judged one by one in a pandas UDF; nothing is shuffled. The rules and
the vocabulary are arguments of the query, not data.

Edge cases: for a null url, or one without `://`, host and path are empty and the
verdict is allow; repeated rows are judged each; very long urls are read whole;
input columns named as result columns are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
STRICT = ("adult", "casino", "escort", "hentai", "nude", "poker", "porn", "sex", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "banner", "bet", "bonus", "cheap", "click", "deal", "deals", "feed", "free", "gamble", "hot", "loan", "offer", "pills",
        "popup", "promo", "sponsor", "track", "tracker", "win", "winner")
MIN_SOFT = 2
MADE = {"host", "path", "rule", "verdict", "strict_hits", "soft_hits", "_judged"}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Rules:
    """Rules by host; those that fit a url are found from its host's suffixes."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by.setdefault(host, []).append(("/" + path, rule, verdict))

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while self.by:
            for start, rule, verdict in self.by.get(host, ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = (rule, verdict)
            _, dot, host = host.partition(".")
            if not dot:
                break
        return best


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for kind, terms in ((True, strict), (False, soft)):
        for t in terms:
            a.add_word(t, (t, kind))
    a.make_automaton()
    return a


def hits(a, text: str) -> tuple[int, int]:
    """Strict hits, and different soft terms, at word boundaries."""
    n, soft = 0, set()
    for end, (term, strict) in a.iter(text) if len(a) else ():
        begin = end - len(term)
        if (begin >= 0 and text[begin].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if strict:
            n += 1
        else:
            soft.add(term)
    return n, len(soft)


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """`pages` with host, path, rule (null if none fits), strict_hits, soft_hits
    (different terms) and verdict."""
    @F.pandas_udf("host string, path string, rule string, verdict string, strict_hits long, soft_hits long")
    def judge(urls: pd.Series) -> pd.DataFrame:
        book, terms = Rules(rules), automaton(strict, soft)
        rows = []
        for url in urls:
            host, path = parts(url)
            rule, verdict = book.decide(host, path)
            n, k = hits(terms, (host + path).translate(_LOWER))
            rows.append((host, path, rule, verdict or ("block" if n or k >= min_soft else "allow"), n, k))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    kept = [f"`{c}`" for c in pages.columns if c.lower() not in MADE]
    judged = pages.select(*kept, judge(F.col(f"`{url_col}`").cast("string")).alias("_judged"))
    return judged.select(*kept, "_judged.*")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _values(terms) -> str:
    return ", ".join(f"('{t}')" for t in terms)


#: the same verdicts in SQL: a rule or a term is one row, joined to the urls
OP9_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS n FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules
         ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
         AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY n),
terms(term, strict) AS (SELECT *, true FROM (VALUES {_values(STRICT)}) UNION ALL SELECT *, false FROM (VALUES {_values(SOFT)})),
texts AS (SELECT n, host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM p),
found AS (SELECT n, strict, length(regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}])' || term || '($|[^\\p{{L}}\\p{{N}}])', '\\1' || chr(1) || '\\2', 'g'))
                 AS dummy, t, term FROM texts JOIN terms ON regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || term || '($|[^\\p{{L}}\\p{{N}}])')),
counts AS (SELECT n, CAST(sum(CASE WHEN strict THEN len(regexp_extract_all(regexp_replace(t, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g'),
                  '(^|[^\\p{{L}}\\p{{N}}])' || term || '($|[^\\p{{L}}\\p{{N}}])')) ELSE 0 END) AS BIGINT) AS strict_hits,
                  CAST(count(*) FILTER (NOT strict) AS BIGINT) AS soft_hits FROM found GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(strict_hits, 0) > 0 OR coalesce(soft_hits, 0) >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits
FROM p LEFT JOIN fits USING (n) LEFT JOIN counts USING (n)
"""
