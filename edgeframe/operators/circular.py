"""What to do with circular references before a graph is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeframe.operators.traverse import back_edge_cycles, cyclic_edges

KEY = ["graph_id", "src", "dst"]


def omit(edges: DataFrame) -> DataFrame:
    """Edges that lie on no cycle."""
    return edges.join(cyclic_edges(edges), KEY, "left_anti").select(*edges.columns)


def omit_closing(edges: DataFrame) -> DataFrame:
    """All but the edges that close a cycle in depth-first order (one task a graph)."""
    path = F.col("path")
    closing = back_edge_cycles(edges).select("graph_id", F.element_at(path, -2).alias("src"), F.element_at(path, -1).alias("dst"))
    return edges.join(closing, KEY, "left_anti").select(*edges.columns)


def reference(edges: DataFrame) -> DataFrame:
    """Edges with ``circular`` and, where it is true, ``target_ref``."""
    marked = edges.join(cyclic_edges(edges).withColumn("circular", F.lit(True)), KEY, "left")
    return marked.select(*edges.columns, F.coalesce("circular", F.lit(False)).alias("circular"), F.when(F.col("circular"), F.col("dst")).alias("target_ref"))


def inline_once(edges: DataFrame) -> DataFrame:
    """(graph_id, cycles): the cycles of each graph, for its metadata."""
    cycles = back_edge_cycles(edges).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("cycle_no", "path"))).alias("cycles"))
    return cycles.select("graph_id", F.col("cycles.path").alias("cycles"))


def rewrite(edges: DataFrame, strategy: str = "reference", closing_only: bool = False) -> DataFrame:
    """The edges under a strategy: omit, reference or inline-once."""
    if strategy == "omit":
        return omit_closing(edges) if closing_only else omit(edges)
    if strategy in ("reference", "inline-once"):
        return reference(edges)
    raise ValueError(f"unknown strategy {strategy}")
