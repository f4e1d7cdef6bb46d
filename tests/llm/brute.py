"""Plain versions of the operators, a document at a time, and edge-case rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def letter(k: int) -> str:
    return chr(97 + k)


def edge_documents(spark: SparkSession):
    base = " ".join(f"w{k} über{k % 7}" for k in range(60))
    boiler = "Subscribe to our weekly letter today 2024 please"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, base, "en", "a", len(base)),
        (5, base, "en", "b", len(base)), (5, base, "en", "b", len(base)), (None, base + " end", "en", "a", 0), (6, base.upper(), "de", "a", 0),
        (7, "one two", "en", "c", 7), (8, "one two three four five " * 4000, "en", "a", 0), (9, "x" * 100_000, "en", "a", 0),
        (10, "a b c d e f g h i j\na b c d e f g h i j\nk", "fr", "b", 0), (11, "É é ß # * | <b>", "fr", None, 3),
    ]
    rows += [(100 + k, f"{boiler}\n" + " ".join(f"u{letter(k)}x{letter(j)}" for j in range(20)), "en", "host", 0) for k in range(15)]
    rows += [(200 + k, f"{boiler.upper()}\nu{letter(k)}", "en", "host", 0) for k in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def fingerprint(text: str | None) -> int:
    w = WORD.findall(ascii_lower(text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(fps: list[int]) -> list[int]:
    """Smallest index of the class of each fingerprint."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def base_quality(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def contamination(text: str | None, items: list[tuple[int, str | None]], window: int = 13) -> tuple[int, int, int, str, bool]:
    w = BENCH_WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        x = BENCH_WORD.findall(ascii_lower(t or ""))
        n = min(window, len(x))
        spans = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in spans:
                hit.update(range(i, i + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def crc(x: str | None) -> int:
    return zlib.crc32((x or "").encode())
