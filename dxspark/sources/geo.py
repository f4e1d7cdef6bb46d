"""Large GeoJSON files, read by many tasks (inventory A8, N1).

A FeatureCollection is one JSON value, whatever its line breaks. It is read in
pieces that end at a closing brace, in splits like any text file. Whether a brace
counts depends on what stands before it, so each task first sums its splits up: the
parity of quotes, and which brackets it closes and opens if it starts outside or
inside a string. Summaries follow each other into the state at the start of every
split (a row a split). With it, tasks cut their features out; what a split border
cuts in two is put together again by the order of the splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = re.compile(r'"features"\s*:\s*\[')
#: splits whose states are sent to every task at most
SPLITS = 1_000_000


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "}").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")))


def _tokens(text: str) -> Iterator[tuple[str, int]]:
    """(quote, bracket, or F for the bracket of the features; its place) in order."""
    opened = {m.end() - 1 for m in FEATURES.finditer(text)}
    for m in re.finditer(r'\\.|["{}\[\]]', text, re.S):
        c = m[0]
        if c[0] != "\\":
            yield ("F" if m.start() in opened else c), m.start()


class _Sum:
    """What a run of text does to the open brackets: closes `pops`, then opens `opened`."""

    def __init__(self):
        self.pops, self.opened = 0, []

    def add(self, c: str) -> None:
        if c in "{[F":
            self.opened.append(c)
        elif self.opened:
            self.opened.pop()
        else:
            self.pops += 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, odd, sums = None, False, None

    def out() -> pa.RecordBatch:
        cols = [[now[0]], [now[1]], [odd], *[[v] for s in sums for v in (s.pops, "".join(s.opened))]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["file", "begin", "odd", "pops0", "opened0", "pops1", "opened1"])

    for b in batches:
        for text, *split in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if split != now:
                if now:
                    yield out()
                now, odd, sums = split, False, (_Sum(), _Sum())
            for c, _ in _tokens(text + "}"):
                if c == '"':
                    odd = not odd
                else:
                    sums[odd].add(c)  # the one of the two cases that is outside a string here
    if now:
        yield out()


def _states(splits: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each split of one file."""
    inside, stack, out = False, "", []
    for r in splits.sort_values("begin").itertuples(index=False):
        out.append((r.file, r.begin, inside, stack))
        pops, opened = (r.pops1, r.opened1) if inside else (r.pops0, r.opened0)
        stack = stack[:max(0, len(stack) - pops)] + opened
        inside ^= r.odd
    return pd.DataFrame(out, columns=["file", "begin", "inside", "stack"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each split: whole ones, and parts (kind: h begins, m goes on, t ends)."""
    now, inside, stack, text, begun = None, False, [], [], True

    def row(kind: str) -> tuple:
        return (*now, kind, "".join(text))

    for b in batches:
        out = []
        for piece, file, begin, start_inside, start_stack in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (file, begin) != now:
                if now and text:
                    out.append(row("h" if begun else "m"))
                now, inside, stack, text = (file, begin), start_inside, list(start_stack), []
                begun = len(stack) < 3 or stack[:2] != ["{", "F"]  # else the split starts in a feature
            piece += "}"
            a = 0 if stack[:2] == ["{", "F"] and len(stack) > 2 else None  # where this piece's part of a feature begins
            for c, at in _tokens(piece):
                if c == '"':
                    inside = not inside
                elif inside:
                    continue
                elif c in "{[F":
                    if c == "{" and stack == ["{", "F"]:
                        a, begun = at, True
                    stack.append(c)
                elif stack:
                    stack.pop()
                    if c == "}" and stack == ["{", "F"]:
                        text.append(piece[a:at + 1])
                        out.append(row("w" if begun else "t"))
                        text, a = [], None
            if a is not None:
                text.append(piece[a:])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "begin", "kind", "feature"])
    if now and text:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row("h" if begun else "m")], ["file", "begin", "kind", "feature"])


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature): the JSON text of every feature of the FeatureCollections at `path`."""
    pieces = _pieces(spark, path)
    sums = pieces.mapInArrow(_summaries, "file string, begin bigint, odd boolean, pops0 bigint, opened0 string, pops1 bigint, opened1 string")
    states = sums.groupBy("file").applyInPandas(_states, "file string, begin bigint, inside boolean, stack string").checkpoint()
    if states.count() <= SPLITS:  # else the pieces are joined to them by a shuffle, in order within a split
        dealt = pieces.join(F.broadcast(states), ["file", "begin"])
    else:
        numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
        dealt = numbered.join(states, ["file", "begin"]).repartition("file", "begin").sortWithinPartitions("file", "begin", "_at")
    cut = dealt.select("value", "file", "begin", "inside", "stack").mapInArrow(_cut, "file string, begin bigint, kind string, feature string").checkpoint()
    order = Window.partitionBy("file").orderBy("begin", F.when(F.col("kind") == "h", 1).otherwise(0))  # only parts at borders
    parts = cut.where("kind <> 'w'").withColumn("_n", F.sum(F.when(F.col("kind") == "h", 1).otherwise(0)).over(order))
    part = F.struct("begin", "feature")
    joined = parts.groupBy("file", "_n").agg(F.array_sort(F.collect_list(part)).alias("p")).select("file", F.array_join("p.feature", "").alias("feature"))
    return cut.where("kind = 'w'").select("file", "feature").unionByName(joined)


def read_features(spark: SparkSession, path: str, key: str = "COD_POSTAL") -> DataFrame:
    """A8 for files of any size: (cod_postal, properties map, geometry JSON text)."""
    f = F.from_json("feature", "properties map<string,string>, geometry string")
    return feature_texts(spark, path).select(f.alias("f")).select(F.col("f.properties")[key].alias("cod_postal"), "f.properties", "f.geometry")


# ------------------------------------------------------------ polygons

def polygons(geometry: Column) -> Column:
    """Polygons of a Polygon or MultiPolygon in JSON: arrays of rings (the first is
    the border, the others holes) of points; null for other geometries."""
    g = F.from_json(geometry, "type string, coordinates string")
    ring = "array<array<array<double>>>"
    return (F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], ring)))
            .when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], f"array<{ring}>")))


def ring_area(ring: Column) -> Column:
    """Area in a ring of points, by the shoelace sum."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
                       lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2


def area(polygons: Column) -> Column:
    """Area of all polygons without their holes."""
    one = lambda p: 2 * ring_area(p[0]) - F.aggregate(p, F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + one(p))


def holes(polygons: Column) -> Column:
    return F.aggregate(polygons, F.lit(0), lambda s, p: s + F.size(p) - 1)


def box(polygons: Column) -> Column:
    """(west, south, east, north) around the borders."""
    points = F.flatten(F.transform(polygons, lambda p: p[0]))
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))
