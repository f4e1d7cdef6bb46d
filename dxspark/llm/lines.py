"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two different lines link if at most `threshold` edits (insert, delete, replace a
character) turn one into the other. A line is split into threshold + 1 segments
of nearly equal length; as so few edits cannot touch every segment, at least one
stands unchanged in the other line. Each line is indexed under (its length,
segment number, segment text), and each probes, for every length from its own
down to `threshold` less, the substrings that the multi-match-aware window
allows for a segment, at most about threshold^2 / 2 + threshold + 1 a length.
The keys are 64-bit hashes. The join also compares the counts of `LETTERS`:
`threshold` edits change them by at most 2 * threshold in all, a test that loses
no link and drops most lines that merely share a segment. What is left is
verified on whole lines: by Spark's bounded `levenshtein`, which walks a line from
its start in every column, and where both lines are longer than `LONG` by a
bit-parallel edit distance in a band of 2 * threshold + 1 diagonals, one aggregate
over the characters.

Exact copies collapse first, by hash, with map-side combining: a line that
stands a million times is indexed once. Texts are shuffled once, for that; the
join moves 24 bytes a key, and whole lines are fetched only for candidates.
Linked lines form classes (connected components).

Lines are what stands between newlines. Those without a word are left out. The
segments need more than `threshold` characters. A shorter line is within
`threshold` edits of every other such line, which needs no pairs: they make a
star. With a longer line it shares a character if they link, and lines of up to
2 * `threshold` characters are joined by that. A caller's `min_chars` above 1
leaves shorter lines duplicates only of their exact copies; they stay in the
result.

Edge cases: null and empty texts have no lines; repeated rows and repeated lines
have a row each; a null doc_id stays; very long lines are compared whole; an
empty table gives an empty result. Other columns do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import connected_components, stored, table

THRESHOLD = 2
MIN_CHARS = 1
LETTERS = "etaoins"
#: characters from which the time of `levenshtein`, which grows with their square, is not worth it
LONG = 2000
#: candidate hashes, 8 bytes each, that are sent to every task at most
BROADCAST_KEYS = 1_000_000


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no from 0, line, h): every line with a word; h its hash."""
    split = docs.select(id_col, F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Begin (from 1) and length of segment i (from 0) of a line so long."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    ahead = F.greatest(F.lit(0), i - parts + longer)  # the last `longer` segments have one more
    return base * i + ahead + 1, base + (i >= parts - longer).cast("int")


def _letters(line: Column) -> Column:
    """Counts of LETTERS modulo 128, a byte each, above an empty low byte. Each is a
    byte, and lengths in bytes, unlike those in characters, need no walk of the line."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate(LETTERS, 1):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(127)), 8 * k))
    return out


def _letters_near(a: Column, b: Column, threshold: int) -> Column:
    """Whether so few edits can turn the counts a into b: each adds at most one
    letter and removes at most one."""
    more = fewer = F.lit(0)
    for k in range(1, len(LETTERS) + 1):
        d = (F.shiftright(a, 8 * k) - F.shiftright(b, 8 * k)).bitwiseAND(F.lit(127))
        more, fewer = more + F.when(d < 64, d).otherwise(0), fewer + F.when(d >= 64, 128 - d).otherwise(0)
    return (more <= threshold) & (fewer <= threshold)


def candidates(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): hashes of lines that share a segment in place, or a character where
    a has at most `threshold`; each pair once, and none where both are so short.

    lines: `h`, `line`, its length `n` and its `sig`, without repeats of h. The
    windows are rows of a small constant array, so that one short expression
    makes every key.
    """
    parts, n = threshold + 1, F.col("n")
    begin, size = _segment(n, F.col("i"), parts)
    long = lines.where(n > threshold)  # one exchange of texts for both sides
    index = (long.select("h", "line", "n", "sig", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("i"))
             .select(F.xxhash64("n", "i", F.substr("line", begin, size)).alias("key"), F.col("h").alias("a"), F.col("sig").alias("a_sig")))
    windows = [(less, i, shift) for less in range(threshold + 1) for i in range(parts)
               for shift in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1)]
    window = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in windows])
    length = n - F.col("less")
    begin, size = _segment(length, F.col("i"), parts)
    begin = begin + F.col("shift")
    probe = (long.select("h", "line", "n", "sig", F.inline(window)).where((length > threshold) & (begin >= 1) & (begin + size - 1 <= n))
             .select(F.col("h").alias("b"), F.xxhash64(length, "i", F.substr("line", begin, size)).alias("key"), F.col("sig").bitwiseOR(F.col("less")).alias("b_sig")))
    once = (F.col("b_sig").bitwiseAND(F.lit(255)) > 0) | (F.col("a") < F.col("b"))
    near = _letters_near(F.col("a_sig"), F.col("b_sig"), threshold)
    met = index.join(probe, "key").where(once & near & (F.col("a") != F.col("b"))).select("a", "b")
    char = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)))).alias("char")
    short = lines.where(n <= threshold).select(F.col("h").alias("a"), n.alias("a_n"), char)
    longer = lines.where((n > threshold) & (n <= 2 * threshold)).select(F.col("h").alias("b"), "n", char)
    return met.unionByName(short.join(longer, "char").where(n <= F.col("a_n") + threshold).select("a", "b")).distinct()


def within(r: Column, s: Column, threshold: int) -> Column:
    """Edit distance of r and s if at most `threshold`, else a larger number.

    Bit b of a state is row j - threshold + b of the table at column j: vp and vn
    hold where a cell is one more or less than the cell above. d follows the
    lowest diagonal down to the last row, and then that row.
    r and s: arrays of characters whose sizes differ by at most `threshold`.
    """
    k, full = threshold, (1 << (2 * threshold + 1)) - 1
    both = lambda x: x.bitwiseAND(F.lit(full))
    bit = lambda x, at: F.shiftrightunsigned(x, at).bitwiseAND(F.lit(1))
    m = F.size(r)

    def step(state: Column, j: Column) -> Column:
        c, vp, vn = F.get(s, j - 1), state["vp"], state["vn"]
        same = F.lit(0)
        for b in range(2 * k + 1):
            same = same + F.when(F.get(r, j - k + b - 1) == c, F.lit(1 << b)).otherwise(0)
        return F.element_at(F.transform(F.array(same), lambda x: _column(x, vp, vn, state["d"], j)), 1)

    def _column(x: Column, vp: Column, vn: Column, d: Column, j: Column) -> Column:
        d0 = both((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))
        return F.element_at(F.transform(F.array(d0), lambda z: _next(z, vp, vn, d, j)), 1)

    def _next(d0: Column, vp: Column, vn: Column, d: Column, j: Column) -> Column:
        hp = vn.bitwiseOR(both(F.bitwise_not(d0.bitwiseOR(vp))))
        hn = d0.bitwiseAND(vp)
        down = F.shiftrightunsigned(d0, 1)
        low = (m - j + k).cast("int")  # place of the last row
        moved = F.when(low >= 2 * k, 1 - bit(d0, 2 * k)).otherwise(
            F.when(F.shiftrightunsigned(hp, 0).bitwiseAND(F.element_at(powers, low + 1)) != 0, F.lit(1))
             .when(hn.bitwiseAND(F.element_at(powers, low + 1)) != 0, F.lit(-1)).otherwise(F.lit(0)))
        return F.struct(hn.bitwiseOR(both(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (d + moved).alias("d"))

    powers = F.array(*[F.lit(1 << b) for b in range(2 * k + 1)])
    start = F.struct(F.lit(full - ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(k), m).alias("d"))
    columns = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, start, step, lambda state: state["d"])


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, edits): hashes of different lines within `threshold` edits, not both
    of at most `threshold` characters."""
    long = lines_of(docs, id_col, text_col).where(F.length("line") >= min_chars).select("h", "line")
    measured = long.select("h", "line", F.length("line").alias("n"), _letters(F.col("line")).alias("sig"))
    pairs = stored(candidates(measured.dropDuplicates(["h", "n"]), threshold), "line_pairs")
    wanted = stored(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), "line_wanted")
    if wanted.count() <= BROADCAST_KEYS:  # else the lines are shuffled to them
        wanted = F.broadcast(wanted)
    chars = F.when(F.length("line") > LONG, F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0)))
    texts = stored(long.join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("h", "line", chars.alias("chars")), "line_texts")
    side = lambda h, line, x: texts.select(F.col("h").alias(h), F.col("line").alias(line), F.col("chars").alias(x))
    met = pairs.join(side("a", "a_line", "r"), "a").join(side("b", "b_line", "s"), "b")
    plain = F.levenshtein("a_line", "b_line", threshold)  # -1: more
    edits = F.when(F.col("r").isNull() | F.col("s").isNull(), plain).otherwise(within(F.col("r"), F.col("s"), threshold))
    return stored(met.select("a", "b", edits.alias("edits")), "line_met").where(F.col("edits").between(0, threshold))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_col, line_no, class_id, n_links): every line with a word, the class it
    is in (the smallest hash of a line in it), and how many different lines are
    within `threshold` edits of it."""
    links = line_links(docs, id_col, text_col, threshold, min_chars)
    n = F.length("line")
    short = stored(lines_of(docs, id_col, text_col).where((n >= min_chars) & (n <= threshold)).select("h").distinct(), "line_short")
    n_short, least = short.agg(F.count("*"), F.min("h")).first()
    star = short.where(F.col("h") != F.lit(least)).select(F.lit(least).cast("bigint").alias("a"), F.col("h").alias("b"))
    ends = (links.select(F.col("a").alias("h"), F.lit(1).alias("k")).unionByName(links.select(F.col("b").alias("h"), F.lit(1).alias("k")))
            .unionByName(short.select("h", F.lit(n_short - 1).alias("k")))
            .groupBy("h").agg(F.sum("k").alias("n_links")))
    classes = stored(connected_components(links.select("a", "b").unionByName(star)).withColumnRenamed("node", "h").join(ends, "h"), "line_classes")
    every = lines_of(docs, id_col, text_col).select(id_col, "line_no", "h")
    return every.join(classes, "h", "left").select(id_col, "line_no", F.coalesce("root", "h").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_col, line_no, class_id): the one line that stays of each class, that
    of the smallest document and place."""
    every = line_classes(docs, id_col, text_col, threshold, min_chars)
    return every.groupBy("class_id").agg(F.min(F.struct(id_col, "line_no")).alias("first")).select("first.*", "class_id")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
