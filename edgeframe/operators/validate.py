"""Validation of graphs against a declarative specification.

Patterns are resolved to node ids first, one job for all rules; the rules
are then equi-joins on (src, dst), never pattern against pattern.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.functions.columns import wildcard_regex
from edgeframe.model import CallGraph
from edgeframe.scratch import written


@dataclass(frozen=True)
class Specification:
    """Required and forbidden edges (from, to, type or None) and node patterns, and limits."""

    entry_point: str = ""
    required_edges: tuple[tuple[str, str, str], ...] = ()
    forbidden_edges: tuple[tuple[str, str, str | None], ...] = ()
    required_nodes: tuple[str, ...] = ()
    forbidden_nodes: tuple[str, ...] = ()
    max_depth: int | None = None
    max_complexity: int | None = None
    name: str = ""
    description: str = field(default="", compare=False)

    @classmethod
    def basic(cls, entry_point: str) -> Specification:
        return cls(entry_point=entry_point, required_nodes=(entry_point,), max_depth=10, max_complexity=20)

    def patterns(self, spark: SparkSession) -> DataFrame:
        """(pattern, regex, literal) of every pattern; as many rows as the file has rules."""
        return spark.createDataFrame([(p, wildcard_regex(p), "*" not in p) for p in self._distinct()], "pattern string, regex string, literal boolean")

    def wildcards(self) -> list[str]:
        """The distinct patterns with wildcards."""
        return [p for p in self._distinct() if "*" in p]

    def _distinct(self) -> list[str]:
        found = {p for a, b, _ in (*self.required_edges, *self.forbidden_edges) for p in (a, b)} | {*self.required_nodes, *self.forbidden_nodes}
        return sorted(found | ({self.entry_point} - {""}))

    def edge_rules(self, spark: SparkSession, kind: str) -> DataFrame:
        rules = self.required_edges if kind == "required" else self.forbidden_edges
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_ord int, from string, to string, type string")

    def node_rules(self, spark: SparkSession, kind: str) -> DataFrame:
        rules = self.required_nodes if kind == "required" else self.forbidden_nodes
        return spark.createDataFrame([(i, r) for i, r in enumerate(rules)], "rule_ord int, pattern string")


def pattern_matches(nodes: DataFrame, spec: Specification) -> DataFrame:
    """(graph_id, pattern, id, ord) for every node a pattern names.

    Literal patterns are an equi-join over the specification's rules; those
    with wildcards are expressions on the node's row, with no join at all.
    """
    patterns = spec.patterns(nodes.sparkSession)
    qualified = F.concat_ws(".", "class_name", "name")
    keys = nodes.select("graph_id", "id", "ord", F.explode(F.array_distinct(F.filter(F.array("name", "id", "class_name", qualified), lambda c: c.isNotNull()))).alias("key"))
    found = keys.join(F.broadcast(patterns.filter("literal")), F.col("key") == F.col("pattern")).select("graph_id", "pattern", "id", "ord")
    wild = [F.when(F.col("key").rlike(wildcard_regex(p)), F.lit(p)) for p in spec.wildcards()]
    if wild:
        found = found.unionByName(keys.select("graph_id", F.explode(F.array_compact(F.array(*wild))).alias("pattern"), "id", "ord"))
    return found.distinct()


def _with_rules(graphs: DataFrame, rules: list[dict], fields: str) -> DataFrame:
    """Each row of ``graphs`` with each rule of the specification, as a literal list, so nothing is joined."""
    return graphs.select("*", F.inline(F.from_json(F.lit(json.dumps(rules)), f"array<struct<{fields}>>")))


def required_edges(graph: CallGraph, spec: Specification, hits: DataFrame | None = None) -> DataFrame:
    """(graph_id, rule_ord, status): found, missing_source, missing_target or missing_edge.

    ``hits`` is a table of :func:`pattern_matches`, if at hand, here and below.
    """
    spark = graph.nodes.sparkSession
    hits, ids = (pattern_matches(graph.nodes, spec) if hits is None else hits), graph.nodes.select("graph_id").distinct()
    rules = _with_rules(ids, [{"rule_ord": i, "from": a, "to": b} for i, (a, b, _) in enumerate(spec.required_edges)], "rule_ord: int, `from`: string, `to`: string")
    has = hits.select("graph_id", "pattern").distinct()
    has = lambda side, h=has: h.select("graph_id", F.col("pattern").alias(side), F.lit(True).alias(f"has_{side}"))
    found = _rule_edges(graph, hits, spec.edge_rules(spark, "required")).select("graph_id", "rule_ord", F.lit(True).alias("hit")).distinct()
    out = rules.join(has("from"), ["graph_id", "from"], "left").join(has("to"), ["graph_id", "to"], "left").join(found, ["graph_id", "rule_ord"], "left")
    status = F.when(F.col("has_from").isNull(), "missing_source").when(F.col("has_to").isNull(), "missing_target").when(F.col("hit").isNull(), "missing_edge").otherwise("found")
    return out.select("graph_id", "rule_ord", status.alias("status"))


def _rule_edges(graph: CallGraph, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(graph_id, rule_ord, src, dst, type) of edges that a rule names, an edge a rule."""
    sides = [hits.select("graph_id", F.col("pattern").alias(p), F.col("id").alias(e)) for p, e in (("from", "src"), ("to", "dst"))]
    edges = graph.edges.select("graph_id", "src", "dst", F.col("type").alias("edge_type"))
    starts = edges.join(sides[0].join(F.broadcast(rules), "from"), ["graph_id", "src"])
    return starts.join(sides[1], ["graph_id", "dst", "to"]).filter(F.col("type").isNull() | (F.col("type") == F.col("edge_type"))).select("graph_id", "rule_ord", "src", "dst", "edge_type")


def forbidden_edges(graph: CallGraph, spec: Specification, hits: DataFrame | None = None) -> DataFrame:
    """One row for every edge a rule forbids."""
    return _rule_edges(graph, pattern_matches(graph.nodes, spec) if hits is None else hits, spec.edge_rules(graph.nodes.sparkSession, "forbidden"))


def required_nodes(graph: CallGraph, spec: Specification, hits: DataFrame | None = None) -> DataFrame:
    """(graph_id, pattern) that no node matches."""
    rules = _with_rules(graph.nodes.select("graph_id").distinct(), [{"rule_ord": i, "pattern": p} for i, p in enumerate(spec.required_nodes)], "rule_ord: int, pattern: string")
    return rules.join(pattern_matches(graph.nodes, spec) if hits is None else hits, ["graph_id", "pattern"], "left_anti").select("graph_id", "rule_ord", "pattern")


def forbidden_nodes(graph: CallGraph, spec: Specification, hits: DataFrame | None = None) -> DataFrame:
    """(graph_id, pattern, id) of nodes that a rule forbids."""
    return (pattern_matches(graph.nodes, spec) if hits is None else hits).join(F.broadcast(spec.node_rules(graph.nodes.sparkSession, "forbidden")), "pattern").select("graph_id", "rule_ord", "pattern", "id")


def entry_point(graph: CallGraph, entry: DataFrame, spec: Specification) -> DataFrame:
    """(graph_id, kind): missing_node if the entry (graph_id, id) is no node, type_mismatch if its name isn't the specified one."""
    named = entry.join(graph.nodes.select("graph_id", "id", "name"), ["graph_id", "id"], "left")
    pattern = spec.entry_point
    fits = F.col("name").rlike(wildcard_regex(pattern)) if "*" in pattern else F.col("name") == pattern
    kind = F.when(F.col("name").isNull(), "missing_node").when(~fits if pattern else F.lit(False), "type_mismatch")
    return named.select("graph_id", "id", kind.alias("kind")).filter("kind is not null")


def limits(graph: CallGraph, spec: Specification, depths: DataFrame) -> DataFrame:
    """(graph_id, kind, actual, allowed): ``depths`` has (graph_id, max_depth), measured or configured (quirk Q14)."""
    n = graph.nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(graph.edges.groupBy("graph_id").agg(F.count("*").alias("e")), "graph_id", "left")
    parts = []
    if spec.max_depth is not None:
        parts.append(depths.select("graph_id", F.lit("performance").alias("kind"), F.col("max_depth").cast("long").alias("actual"), F.lit(spec.max_depth).cast("long").alias("allowed")))
    if spec.max_complexity is not None:
        parts.append(n.select("graph_id", F.lit("complexity").alias("kind"), (F.coalesce("e", F.lit(0)) - F.col("n") + 2).cast("long").alias("actual"), F.lit(spec.max_complexity).cast("long").alias("allowed")))
    if not parts:
        return depths.select("graph_id", F.lit("").alias("kind"), F.lit(0).cast("long").alias("actual"), F.lit(0).cast("long").alias("allowed")).limit(0)
    return reduce(DataFrame.unionByName, parts).filter("actual > allowed")


def violations(graph: CallGraph, spec: Specification, entry: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(graph_id, phase, rule_ord, kind, message), all errors; patterns are matched once."""
    hits = written(pattern_matches(graph.nodes, spec), "hits") if hits is None else hits
    rows = lambda df, phase, kind, message, rule="rule_ord": df.select("graph_id", F.lit(phase).alias("phase"), F.col(rule).cast("int").alias("rule_ord"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), message.alias("message"))
    required = required_edges(graph, spec, hits).filter("status <> 'found'")
    edge_kind = F.when(F.col("status") == "missing_edge", "missing_edge").otherwise("missing_node")
    out = [
        rows(required, 2, edge_kind, F.col("status")),
        rows(forbidden_edges(graph, spec, hits), 3, "forbidden_edge", F.concat_ws(" -> ", "src", "dst")),
        rows(required_nodes(graph, spec, hits), 4, "missing_node", F.col("pattern")),
        rows(forbidden_nodes(graph, spec, hits), 5, "type_mismatch", F.col("id")),
    ]
    if entry is not None:
        bad = entry_point(graph, entry, spec).withColumn("rule_ord", F.lit(0))
        out.insert(0, rows(bad, 1, F.col("kind"), F.col("id")))
    return reduce(DataFrame.unionByName, out)


def summary(graph: CallGraph, spec: Specification, entry: DataFrame | None = None) -> DataFrame:
    """One row a graph: rules found and broken, and whether it is valid (quirk Q15: real hits)."""
    hits = written(pattern_matches(graph.nodes, spec), "hits")
    found = required_edges(graph, spec, hits).groupBy("graph_id").agg(F.count_if(F.col("status") == "found").alias("required_found"), F.count("*").alias("required_total"))
    bad = violations(graph, spec, entry, hits).groupBy("graph_id").agg(
        F.count("*").alias("errors"), F.count_if(F.col("kind") == "forbidden_edge").alias("forbidden_found"), F.count_if(F.col("phase") == 4).alias("missing_nodes"), F.count_if(F.col("phase") == 5).alias("unexpected_nodes")
    )
    out = graph.nodes.select("graph_id").distinct().join(found, "graph_id", "left").join(bad, "graph_id", "left").na.fill(0)
    return out.withColumn("is_valid", F.col("errors") == 0)


def difference(graph: CallGraph, spec: Specification) -> DataFrame:
    """(graph_id, kind, item): required nodes present or missing, and nodes nothing requires."""
    hits = pattern_matches(graph.nodes, spec).join(F.broadcast(spec.node_rules(graph.nodes.sparkSession, "required")), "pattern")
    present = hits.select("graph_id", F.lit("found").alias("kind"), F.col("pattern").alias("item")).distinct()
    missing = required_nodes(graph, spec).select("graph_id", F.lit("missing").alias("kind"), F.col("pattern").alias("item"))
    extra = graph.nodes.select("graph_id", "id").join(hits.select("graph_id", "id"), ["graph_id", "id"], "left_anti").select("graph_id", F.lit("additional").alias("kind"), F.col("id").alias("item"))
    return present.unionByName(missing).unionByName(extra)


def report(graph: CallGraph, spec: Specification, graph_id: str, entry: DataFrame | None = None) -> str:
    """The text report of one graph: its summary, then every error in order."""
    one = summary(graph, spec, entry).filter(F.col("graph_id") == graph_id).first()
    rows = violations(graph, spec, entry).filter(F.col("graph_id") == graph_id).select("kind", "message", "phase", "rule_ord").orderBy("phase", "rule_ord", "message")
    lines = [f"Validation {'passed' if one.is_valid else 'failed'}: {one.errors} errors", f"Required edges: {one.required_found}/{one.required_total}"]
    lines += [f"- {r.kind}: {r.message}" for r in rows.toLocalIterator()]
    return "\n".join(lines)
