from __future__ import annotations

import random
import re
from collections import defaultdict

from dxspark.llm import lines
from dxspark.llm.common import stored, table
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL
from tests.llm import brute


def distance(r: str, s: str) -> int:
    row = list(range(len(r) + 1))
    for j, c in enumerate(s, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(r, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
    return row[-1]


def edited(rng: random.Random, s: str, n: int) -> str:
    s = list(s)
    for _ in range(n):
        k, how = rng.randrange(len(s)), rng.randrange(3)
        s[k:k + (how > 0)] = [] if how == 2 else [rng.choice("abcdeé𝄞")]
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = []
    for k in (1, 2, 3):
        for _ in range(150):
            r = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 25)))
            s = edited(rng, r, rng.randrange(6)) if len(r) > 6 else "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
            if abs(len(r) - len(s)) <= k and s:
                pairs.append((k, r, s))
    df = spark.createDataFrame(pairs, "k int, r string, s string")
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    for k in (1, 2, 3):
        part = df.where(f"k = {k}").select("r", "s", chars("r").alias("x"), chars("s").alias("y"))
        for r in stored(part, "p").select("r", "s", lines.within(F.col("x"), F.col("y"), k).alias("d")).collect():
            want = distance(r.r, r.s)
            assert r.d == want if want <= k else r.d > k, (k, r, want)


def test_letter_counts(spark):
    rng = random.Random(5)
    texts = ["", "e" * 130, "é𝄞e", "\u0301t\u0301"] + ["".join(rng.choice("etaoinsxé𝄞 ") for _ in range(rng.randrange(300))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    for line, sig in df.select("line", lines._letters(F.col("line"))).collect():
        assert sig == sum(line.count(c) % 128 << 8 * k for k, c in enumerate(lines.LETTERS, 1)), line
    plan = df.select(lines._letters(F.col("line")))._jdf.queryExecution().analyzed().toString()
    assert "octet_length" in plan and not re.search(r"(?<!octet_)length\(", plan)  # no walk of the characters


def plain_classes(docs, threshold, min_chars):
    rows = [(i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    kinds = sorted({x for _, _, x in rows if len(x) >= min_chars})
    links, root = defaultdict(set), {x: x for _, _, x in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, r in enumerate(kinds):
        for s in kinds[:i]:
            if abs(len(r) - len(s)) <= threshold and distance(r, s) <= threshold:
                links[r].add(s)
                links[s].add(r)
                root[find(r)] = find(s)
    return [(i, n, find(x), len(links[x])) for i, n, x in rows]


def check(docs, threshold=2, min_chars=32):
    got = lines.line_classes(docs, threshold=threshold, min_chars=min_chars).collect()
    want = plain_classes([(r.doc_id, r.text) for r in docs.collect()], threshold, min_chars)
    by_got, by_want = defaultdict(list), defaultdict(list)
    for r in got:
        by_got[r.class_id].append((r.doc_id, r.line_no, r.n_links))
    for i, n, c, k in want:
        by_want[c].append((i, n, k))
    assert sorted((sorted(v, key=repr) for v in by_got.values()), key=repr) == sorted((sorted(v, key=repr) for v in by_want.values()), key=repr)


def test_edited_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde fghé") for _ in range(rng.randrange(20, 60))) + "x" for _ in range(25)]
    made = [edited(rng, b, rng.randrange(4)) for b in base for _ in range(6)]
    rows = [(k, "\n".join(rng.sample(made, 8)).replace("\r", " ")) for k in range(40)] + [(None, made[0]), (3, None), (4, ""), (5, "\n \n")]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "d")
    check(docs, 2)
    check(docs, 1)
    check(docs, 3, 10)


def test_short_lines(spark):
    """Lines of 1 to 31 characters link as longer ones do."""
    rng = random.Random(6)
    made = ["Are, is anwh reenen.", "Are. Is anwh reenen.", "a", "b", "é", "𝄞", "ab", "𝄞b", "xy", "qrs", "xqy", "wxvy", "mnop"]
    made += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in range(1, 32) for _ in range(3)]
    made += [edited(rng, x, rng.randrange(1, 4)) for x in made if len(x) > 6]
    docs = stored(spark.createDataFrame([(k, "\n".join(rng.sample(made, 9))) for k in range(40)] + [(99, "\n".join(made[:13]))], "doc_id bigint, text string"), "d")
    for threshold in (2, 1, 3):
        check(docs, threshold, 1)
    links = {(r.doc_id, r.line_no): r.n_links for r in lines.line_classes(docs).collect()}
    assert links[99, 0] and links[99, 1]


def test_lines_on_both_sides_of_the_long_ones(spark, monkeypatch):
    """`levenshtein` and the band give the same links, also across LONG."""
    monkeypatch.setattr(lines, "LONG", 40)
    rng = random.Random(8)
    base = ["".join(rng.choice("abc dé𝄞") for _ in range(n)) + "x" for n in range(36, 46) for _ in range(2)]
    made = [edited(rng, b, rng.randrange(4)) for b in base for _ in range(5)]
    docs = stored(spark.createDataFrame([(k, "\n".join(rng.sample(made, 8))) for k in range(40)], "doc_id bigint, text string"), "d")
    for threshold in (2, 1, 3):
        check(docs, threshold, 1)
    for r in lines.line_links(docs).join(lines.lines_of(docs).select(F.col("h").alias("a"), F.col("line").alias("r")).distinct(), "a").join(
            lines.lines_of(docs).select(F.col("h").alias("b"), F.col("line").alias("s")).distinct(), "b").collect():
        assert distance(r.r, r.s) == r.edits


def test_tables_and_edges(spark):
    docs = table(spark, SF_SMALL, "documents").where("doc_id < 50").select("doc_id", "text")
    check(stored(docs.unionByName(brute.edge_documents(spark).where("length(text) < 9000 OR text IS NULL").select("doc_id", "text")), "d"))
    whole = brute.edge_documents(spark)
    assert lines.line_classes(whole).count() == sum(bool(brute.WORD.search(x)) for r in whole.collect() for x in re.split("\n", r.text or ""))
    assert lines.line_classes(whole.where("doc_id = -1")).count() == 0
    kept = lines.without_repeats(whole).collect()
    assert len({r.class_id for r in kept}) == len(kept)
