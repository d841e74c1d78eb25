"""Counts, fans, hotspots and complexity; hash aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeframe.functions.columns import base_name, short_path
from edgeframe.operators.build import adjacency
from edgeframe.operators.traverse import weak_components

KEY = ["graph_id", "id"]


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: nodes, edges, async and static counts."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("total_nodes"), F.count_if("is_async").alias("async_nodes"), F.count_if(F.col("is_static") & (F.col("type") == "method")).alias("static_methods"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("total_edges"))
    return n.join(e, "graph_id", "left").fillna(0, ["total_edges"])


def distribution(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy("graph_id", column).agg(F.count("*").alias("n"))


def file_distribution(nodes: DataFrame, relative: bool = False, top: int | None = None) -> DataFrame:
    """Nodes by file name, or by short path; optionally the largest few."""
    out = nodes.groupBy("graph_id", (short_path if relative else base_name)(F.col("file_path")).alias("file")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "file").limit(top) if top else out


def fan(edges: DataFrame, end: str = "src", distinct: bool = False) -> DataFrame:
    """Calls (or distinct neighbours) of each node, out by ``src``, in by ``dst``."""
    return (adjacency(edges) if distinct else edges).groupBy("graph_id", F.col(end).alias("id")).agg(F.count("*").alias("n"))


def average_fan_of_callers(edges: DataFrame) -> DataFrame:
    """Mean calls over nodes that have such edges at all."""
    sides = [fan(edges, e).groupBy("graph_id").agg(F.avg("n").alias(f"avg_fan_{k}")) for e, k in (("src", "out"), ("dst", "in"))]
    return sides[0].join(sides[1], "graph_id")


def average_fan_of_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours over all nodes."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    e = adjacency(edges).groupBy("graph_id").agg(F.count("*").alias("pairs"))
    return n.join(e, "graph_id", "left").select("graph_id", (F.coalesce("pairs", F.lit(0)) / F.col("nodes")).alias("avg_fan"))


def hotspots_distinct(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes with the most distinct callers, uncalled ones included, ties by order."""
    counted = nodes.select(*KEY, "ord").join(fan(edges, "dst", distinct=True), KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.orderBy(F.desc("n"), "ord", "id").limit(top)


def hotspots_calls(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes with the most incoming calls, with their attributes ('unknown' for strangers)."""
    best = fan(edges, "dst").orderBy(F.desc("n"), "id").limit(top)
    # ``top`` rows
    return nodes.select(*KEY, "name", "file_path").join(F.broadcast(best), KEY, "right").select(*KEY, F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("file_path", F.lit("unknown")).alias("file_path"), "n")


def high_fan(edges: DataFrame, end: str = "src", above: int = 5, top: int | None = None) -> DataFrame:
    """Nodes with more calls than a threshold (quirk Q12: over all nodes)."""
    out = fan(edges, end).filter(F.col("n") > above)
    return out.orderBy(F.desc("n"), "id").limit(top) if top else out


def connectivity(edges: DataFrame) -> DataFrame:
    """Edges in and out of each node."""
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).groupBy(*KEY).agg(F.count("*").alias("n"))


def most_connected(nodes: DataFrame, edges: DataFrame, entry: DataFrame, limit: int) -> DataFrame:
    """The entry and the best connected nodes, ``limit`` in all."""
    score = nodes.select(*KEY, "ord").join(connectivity(edges), KEY, "left").join(entry.select(*KEY, F.lit(True).alias("first")), KEY, "left")
    ranked = score.select(*KEY, "ord", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(False)).alias("first"))
    return ranked.orderBy(F.desc("first"), F.desc("n"), "ord", "id").limit(limit).select(*KEY, "n")


def cyclomatic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """max(1, E - N + 2P) of each graph."""
    p = weak_components(nodes, edges).groupBy("graph_id").agg(F.countDistinct("component").alias("components"), F.count("*").alias("n"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("e"))
    return p.join(e, "graph_id", "left").select("graph_id", "components", F.greatest(F.lit(1), F.coalesce("e", F.lit(0)) - F.col("n") + 2 * F.col("components")).alias("cyclomatic"))


def cognitive(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """2 x cycles + floor of the mean distinct fan-out; ``cycles`` has (graph_id, n)."""
    fans = average_fan_of_nodes(nodes, edges)
    return fans.join(cycles, "graph_id", "left").select("graph_id", (2 * F.coalesce("n", F.lit(0)) + F.floor("avg_fan")).alias("cognitive"))


def bundle(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, top: int = 10) -> DataFrame:
    """One row a graph: functions, calls, files, both complexities, and ``hotspots``, the ``top`` most called nodes.

    ``cycles`` has (graph_id, n).  Hotspots are (id, n) by calls, then id; the
    rank limit holds before the shuffle, so a large graph sends ``top`` rows a task.
    """
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("functions"), F.countDistinct("file_path").alias("files"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("calls"))
    called = edges.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    best = called.withColumn("rank", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("n"), "id"))).filter(F.col("rank") <= top)
    hot = best.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "n"))), lambda h: F.struct(h["id"].alias("id"), h["n"].alias("n"))).alias("hotspots"))
    out = n.join(e, "graph_id", "left").join(cyclomatic(nodes, edges).select("graph_id", "cyclomatic"), "graph_id", "left").join(cognitive(nodes, edges, cycles), "graph_id", "left").join(hot, "graph_id", "left")
    none = F.array().cast("array<struct<id:string,n:bigint>>")
    return out.select("graph_id", "functions", F.coalesce("calls", F.lit(0)).alias("calls"), "files", "cyclomatic", F.coalesce("cognitive", F.lit(0)).alias("cognitive"), F.coalesce("hotspots", none).alias("hotspots"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """Totals over (success, millis) rows of a batch."""
    return runs.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.sum("millis").alias("millis"))


def comparison(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """One row a graph: calls, unique functions, files and depth, to compare results."""
    n = nodes.groupBy("graph_id").agg(F.countDistinct("name").alias("unique_functions"), F.countDistinct("file_path").alias("files"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("calls"))
    return n.join(e, "graph_id", "left").join(reached.groupBy("graph_id").agg(F.max("depth").alias("max_depth")), "graph_id", "left")
