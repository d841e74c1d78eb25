"""Graphs derived from relational tables; every source is read by the columns needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeframe.model import CallGraph

#: Table, key, name column and node type of each layer of the entity graph, outermost first.
LAYERS = (
    ("region", "r_regionkey", "r_name", "function"),
    ("nation", "n_nationkey", "n_name", "method"),
    ("customer", "c_custkey", "c_name", "arrow"),
    ("orders", "o_orderkey", None, "method"),
    ("part", "p_partkey", "p_name", "function"),
    ("supplier", "s_suppkey", "s_name", "constructor"),
)
SHORT = {"orders": "order"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each row of the six entity tables; ``ord`` is layer, then key."""
    out = None
    for layer, (name, key, label, kind) in enumerate(LAYERS):
        short, k = SHORT.get(name, name), F.col(key).cast("long")
        rows = table(spark, sf_dir, name).select(
            F.lit("entity").alias("graph_id"),
            (F.lit(layer).cast("long") * 10**12 + k).alias("ord"),
            _id(short, key).alias("id"),
            (F.col(label) if label else _id(short, key)).alias("name"),
            F.concat(F.lit(f"src/{name}/"), (k % 10).cast("string"), F.lit(".ts")).alias("file_path"),
            (k % 100 + 1).cast("int").alias("line"),
            F.lit(kind).alias("type"),
            (k % 3 == 0).alias("is_async"),
            (k % 5 == 0).alias("is_static"),
            F.lit(short if kind in ("method", "constructor") else None).cast("string").alias("class_name"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def entity_edges(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """region -> nation -> customer -> order -> part -> supplier; one order-part edge a line item.

    ``cyclic`` adds supplier -> nation.
    """

    def rows(name: str, src: tuple[str, str], dst: tuple[str, str], kind: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(*src).alias("src"), _id(*dst).alias("dst"), kind.alias("type"))

    status = F.when(F.col("o_orderstatus") == "O", "async").when(F.col("o_orderstatus") == "F", "sync").otherwise("constructor")
    parts = [
        rows("nation", ("region", "n_regionkey"), ("nation", "n_nationkey"), F.lit("sync")),
        rows("customer", ("nation", "c_nationkey"), ("customer", "c_custkey"), F.lit("callback")),
        rows("orders", ("customer", "o_custkey"), ("order", "o_orderkey"), status),
        rows("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), F.lit("sync")),
        rows("lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), F.lit("async")).distinct(),
    ]
    if cyclic:
        parts.append(rows("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), F.lit("callback")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit("entity").alias("graph_id"), "src", "dst", "type")


def entity_graph(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> CallGraph:
    return CallGraph(entity_nodes(spark, sf_dir), entity_edges(spark, sf_dir, cyclic))


def flow_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    """One small cyclic graph a user: an edge from each event type to the next."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph_id"), "event_id", "ts", "event_type")
    order = W.partitionBy("graph_id").orderBy("ts", "event_id")
    edges = events.select("graph_id", F.col("event_id").alias("ord"), F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"), F.lit("sync").alias("type")).filter("dst is not null")
    nodes = events.groupBy("graph_id", F.col("event_type").alias("id")).agg(F.min("event_id").alias("ord")).withColumn("name", F.col("id"))
    return CallGraph(nodes, edges)


def dialogue_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    """One chain a conversation: each turn calls the next."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").cast("long").alias("ord"), F.col("role").alias("name"))
    nodes = turns.select("graph_id", "ord", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("id"), "name")
    order = W.partitionBy("graph_id").orderBy("ord")
    kind = F.when(F.col("name") == "user", "sync").when(F.col("name") == "assistant", "async").otherwise("callback")
    edges = nodes.select("graph_id", "ord", F.col("id").alias("src"), F.lead("id").over(order).alias("dst"), kind.alias("type")).filter("dst is not null")
    return CallGraph(nodes, edges)


def web_graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    """Pages and the targets of their links."""
    pages = table(spark, sf_dir, "pages").select(F.lit("web").alias("graph_id"), F.col("page_id").cast("long").alias("ord"), F.col("url").alias("id"), F.col("url").alias("name"), "html")
    edges = pages.select("graph_id", "ord", F.col("id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("dst"), F.lit("sync").alias("type"))
    return CallGraph(pages.drop("html"), edges)
