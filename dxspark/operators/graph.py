"""Diagnosis graph as node / edge DataFrames (inventory M1-M6) and area maps
(N1-N2). The graph store's MERGE / MATCH / DETACH DELETE become set
operations: aggregate-by-key, semi and anti joins. Nothing is written one
row at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dxspark.functions.scalars import PROVINCE_SCALE, NATIONAL_SCALE, bin_frequency, parse_vector_literal
from dxspark.operators.agg import count_per_value_by_area, node_out_degree
from dxspark.operators.lookup import edge_endpoint_join, geo_left_join, neighbour_join
from dxspark.operators.ordering import ordered_running
from dxspark.sources.keyed import merge_into, read_keyed


def upsert_nodes(existing: DataFrame | None, incoming: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    """M1: merge by key, properties of the last write (largest `ord`) win;
    rows without a key are rejected. `max_by` aggregates map-side first."""
    allrows = incoming if existing is None else existing.unionByName(incoming)
    cols = [c for c in allrows.columns if c != key]
    packed = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(ord_col))
    return (allrows.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_n"))
            .select(key, *[F.col(f"_n.{c}").alias(c) for c in cols]))


def merge_edges(edges: DataFrame, src: str, dst: str, nodes: DataFrame, key: str,
                out_src: str = "source", out_dst: str = "target") -> DataFrame:
    """M2: an edge is created once, and only between existing nodes."""
    e = edge_endpoint_join(edges.select(F.col(src).alias(out_src), F.col(dst).alias(out_dst)),
                           out_src, out_dst, nodes, key)
    return e.distinct()


def store_nodes(path: str, incoming: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    """M1 into a stored graph: a second run merges into what the first left."""
    merge_into(f"{path}/nodes", incoming, [key], ord_col)
    return read_keyed(incoming.sparkSession, f"{path}/nodes")


def store_edges(path: str, edges: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """M2 into a stored graph: edges between stored nodes, each once over all runs."""
    spark = edges.sparkSession
    merge_into(f"{path}/edges", merge_edges(edges, src, dst, read_keyed(spark, f"{path}/nodes"), key), ["source", "target"])
    return read_keyed(spark, f"{path}/edges")


def node_table(nodes: DataFrame, embedding_text: str = "embedding_text") -> DataFrame:
    """M3: node export with the embedding parsed to array<float>."""
    return nodes.withColumn("embedding", parse_vector_literal(embedding_text)).drop(embedding_text)


def node_count(nodes: DataFrame) -> DataFrame:
    """M5: number of nodes."""
    return nodes.agg(F.count(F.lit(1)).alias("n"))


def find_node(nodes: DataFrame, key: str, value: str) -> DataFrame:
    """M5: a node by its name (0..1 rows after an upsert)."""
    return nodes.where(F.col(key) == value)


def node_degree(nodes: DataFrame, key: str, edges: DataFrame, src: str = "source") -> DataFrame:
    """M5: related nodes per node, 0 for isolated ones."""
    return node_out_degree(nodes, key, edges, src)


def node_neighbours(nodes: DataFrame, key: str, edges: DataFrame, src: str = "source",
                    dst: str = "target") -> DataFrame:
    """M5: directed neighbours of every node."""
    return neighbour_join(nodes, key, edges, src, dst)


def delete_nodes_detach(nodes: DataFrame, key: str, edges: DataFrame, doomed: Column,
                        src: str = "source", dst: str = "target") -> tuple[DataFrame, DataFrame]:
    """M6: delete the nodes matching `doomed` together with every edge that
    touches them; returns the surviving (nodes, edges)."""
    gone = nodes.where(doomed).select(F.col(key).alias("_g")).distinct()
    kept_nodes = nodes.join(gone, F.col(key) == F.col("_g"), "left_anti")
    kept_edges = (edges.join(gone, F.col(src) == F.col("_g"), "left_anti")
                  .join(gone, F.col(dst) == F.col("_g"), "left_anti"))
    return kept_nodes, kept_edges


# ------------------------------------------------------------------ geography

def area_density(areas: DataFrame, area_key: str, counts: DataFrame, count_key: str, count: str,
                 scale: Sequence[float] = NATIONAL_SCALE) -> DataFrame:
    """Every polygon with its count (null = no data) and the class of the count."""
    return geo_left_join(areas, area_key, counts, count_key).withColumn("clase", bin_frequency(count, scale))


def area_density_by_code(rows: DataFrame, code: str, area: str, first_seen: str, areas: DataFrame,
                         area_key: str, scale: Sequence[float] = PROVINCE_SCALE, palette: int = 8) -> DataFrame:
    """Per code, the polygons that have visits with that code, their count
    and class, and a stable code index (order of first appearance mod the
    palette size). Only polygons with data are emitted; the rest of a code's
    map is the polygon table itself (no code x polygon product)."""
    counts = count_per_value_by_area(rows, code, area)
    firsts = rows.groupBy(code).agg(F.min(first_seen).alias("_first"))
    idx = ordered_running(firsts, ["_first", code], pos="_pos") \
        .select(code, ((F.col("_pos") - 1) % palette).cast("int").alias("color_index"))
    joined = counts.join(areas, F.col(area) == F.col(area_key)).drop(area)
    return joined.join(idx, code).withColumn("clase", bin_frequency("frecuencia", scale))
