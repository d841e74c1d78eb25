"""Graph construction and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.model import AnalysisError, CallGraph


def _first(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row for each key, by the smallest (or greatest) ``order``.

    An aggregate, so it combines before the shuffle and a hot key costs
    nothing; ``dropDuplicates`` would pick any row.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("r"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"r.{c}") for c in df.columns))


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """First node of each id wins."""
    return _first(nodes, ["graph_id", "id"], "ord")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """First edge of each id wins."""
    return _first(edges, ["graph_id", "id"], "ord")


def checked(graph: CallGraph) -> CallGraph:
    """The graph, if nodes have id, name, file and line and edges have both ends."""
    bad = graph.nodes.filter("id is null or id = '' or name is null or file_path is null or line is null").select("id").first()
    if bad:
        raise AnalysisError(f"invalid node: {bad.id}", "INVALID_NODE")
    bad = graph.edges.filter("src is null or dst is null or src = '' or dst = ''").select("src", "dst").first()
    if bad:
        raise AnalysisError(f"invalid edge: {bad.src} -> {bad.dst}", "INVALID_EDGE")
    return graph


def endpoints(edges: DataFrame) -> DataFrame:
    """(graph_id, id) of both ends, once each."""
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for ends of edges that no node has."""
    missing = endpoints(edges).join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    return missing.select("graph_id", "id", F.lit("placeholder").alias("name"), F.lit("unknown").alias("file_path"), F.lit(0).alias("line"), F.lit("function").alias("type"), F.lit(False).alias("is_async"), F.lit("unknown").alias("return_type"))


def with_placeholders(graph: CallGraph) -> CallGraph:
    return CallGraph(graph.nodes.unionByName(placeholders(graph.nodes, graph.edges), allowMissingColumns=True), graph.edges, graph.graphs)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (graph_id, src, dst)."""
    return edges.select("graph_id", "src", "dst").distinct()


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    return adjacency(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti").select(*edges.columns)


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_semi").select(*edges.columns)
    return edges


def with_metadata(graphs: DataFrame, **values) -> DataFrame:
    """Metadata with some columns set; a null leaves the old value."""
    return graphs.withColumns({k: F.coalesce(v if isinstance(v, Column) else F.lit(v), F.col(k)) for k, v in values.items()})


def summary(graph: CallGraph, entry_point: str = "unknown", max_depth: int = 10) -> DataFrame:
    """Metadata of each graph: entry point, depth and distinct files."""
    files = graph.nodes.groupBy("graph_id").agg(F.countDistinct("file_path").alias("total_files"), F.count("*").alias("total_nodes"))
    return files.select("graph_id", F.lit(entry_point).alias("entry_point"), F.lit(max_depth).alias("max_depth"), "total_files", "total_nodes")


def merge_results(parts: list[CallGraph]) -> CallGraph:
    """Results of separate extractions as one graph.

    The last node of an id wins; a target without ``#`` and ``.`` becomes the
    first node with that name; edges without both ends go.
    """
    number = lambda df, i: df.withColumn("part", F.lit(i))
    nodes = reduce(DataFrame.unionByName, (number(g.nodes, i) for i, g in enumerate(parts)))
    edges = reduce(DataFrame.unionByName, (g.edges for g in parts))
    nodes = _first(nodes.withColumn("late", F.struct("part", "ord")), ["graph_id", "id"], "late", last=True).drop("late", "part")
    named = nodes.groupBy("graph_id", F.col("name").alias("dst")).agg(F.min_by("id", F.struct("ord", "id")).alias("found"))
    plain = ~F.col("dst").contains("#") & ~F.col("dst").contains(".")
    columns = edges.columns
    resolved = edges.join(named, ["graph_id", "dst"], "left").withColumn("dst", F.when(plain & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("dst"))).select(*columns)
    return CallGraph(nodes, inner_edges(nodes, resolved))


def concat_results(parts: list[CallGraph]) -> CallGraph:
    """Plain concatenation, as incremental merging does."""
    return CallGraph(reduce(DataFrame.unionByName, (g.nodes for g in parts)), reduce(DataFrame.unionByName, (g.edges for g in parts)))


def file_results(graph: CallGraph) -> DataFrame:
    """One row a file: how many functions, classes and outgoing calls it has."""
    out = graph.edges.join(graph.nodes.select("graph_id", F.col("id").alias("src"), "file_path"), ["graph_id", "src"]).groupBy("graph_id", "file_path").agg(F.count("*").alias("calls"))
    own = graph.nodes.groupBy("graph_id", "file_path").agg(F.count_if(F.col("type") == "function").alias("function_count"), F.countDistinct("class_name").alias("class_count"), F.count("*").alias("node_count"))
    return own.join(out, ["graph_id", "file_path"], "left").fillna(0, ["calls"])


def diagram_entry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first node without incoming edges of each graph, else its first node."""
    called = edges.select("graph_id", F.col("dst").alias("id"), F.lit(True).alias("called")).distinct()
    ranked = nodes.join(called, ["graph_id", "id"], "left")
    return ranked.groupBy("graph_id").agg(F.min_by("id", F.struct(F.coalesce("called", F.lit(False)), "ord", "id")).alias("entry_point_id"))
