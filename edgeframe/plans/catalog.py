"""Registered queries over the test tables, each with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.functions import columns as C
from edgeframe.model import AnalysisOptions, CallGraph
from edgeframe.operators import build, circular, filters, metrics, traverse, validate
from edgeframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _node_sql(layer: int, table: str, key: str, label: str, kind: str) -> str:
    short = tables.SHORT.get(table, table)
    cls = f"'{short}'" if kind in ("method", "constructor") else "NULL"
    return (
        f"SELECT {layer}::BIGINT * 1000000000000 + {key} AS ord, '{short}#' || {key} AS id, {label or f'{chr(39)}{short}#{chr(39)} || {key}'} AS name, 'src/{table}/' || ({key} % 10) || '.ts' AS file_path, "
        f"{key} % 100 + 1 AS line, '{kind}' AS type, {key} % 3 = 0 AS is_async, {key} % 5 = 0 AS is_static, {cls} AS class_name FROM {table}"
    )


NODES = " UNION ALL ".join(_node_sql(i, *x) for i, x in enumerate(tables.LAYERS))
EDGES = """
SELECT 'region#' || n_regionkey AS src, 'nation#' || n_nationkey AS dst, 'sync' AS type FROM nation
UNION ALL SELECT 'nation#' || c_nationkey, 'customer#' || c_custkey, 'callback' FROM customer
UNION ALL SELECT 'customer#' || o_custkey, 'order#' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'async' WHEN 'F' THEN 'sync' ELSE 'constructor' END FROM orders
UNION ALL SELECT 'order#' || l_orderkey, 'part#' || l_partkey, 'sync' FROM lineitem
UNION ALL SELECT DISTINCT 'part#' || l_partkey, 'supplier#' || l_suppkey, 'async' FROM lineitem"""
G = f"WITH RECURSIVE n AS MATERIALIZED ({NODES}), e AS MATERIALIZED ({EDGES}), a AS MATERIALIZED (SELECT DISTINCT src, dst FROM e) "
FLOW = "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM (SELECT user_id::VARCHAR AS graph_id, event_id AS ord, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL), n AS (SELECT DISTINCT user_id::VARCHAR AS graph_id, event_type AS id FROM events), a AS MATERIALIZED (SELECT DISTINCT graph_id, src, dst FROM e) "
TALK = "WITH RECURSIVE n AS MATERIALIZED (SELECT conv_id::VARCHAR AS graph_id, turn::BIGINT AS ord, 't' || turn AS id, role AS name FROM conversations), e AS MATERIALIZED (SELECT * FROM (SELECT graph_id, ord, id AS src, lead(id) OVER (PARTITION BY graph_id ORDER BY ord) AS dst, CASE name WHEN 'user' THEN 'sync' WHEN 'assistant' THEN 'async' ELSE 'callback' END AS type FROM n) WHERE dst IS NOT NULL) "
WEB = """WITH n AS (SELECT url AS id FROM pages), e AS (SELECT url AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages) """
REACH = "q(id, depth) AS (SELECT '{start}', 0 UNION SELECT a.dst, q.depth + 1 FROM q JOIN a ON a.src = q.id WHERE q.depth < {bound}), r AS (SELECT id, min(depth) AS depth FROM q GROUP BY id) "


def _reach(start: str, bound: int) -> str:
    return G + ", " + REACH.format(start=start, bound=bound)


def _g(spark: SparkSession, d: str) -> CallGraph:
    return tables.entity_graph(spark, d)


def _start(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([("entity", i) for i in ids], "graph_id string, id string")


# --- construction ---------------------------------------------------------------------------------


@query("trv10_depth_distribution", _reach("region#0", 10) + "SELECT depth, count(*) AS nodes, count(*) FILTER (WHERE is_async) AS async_nodes FROM r JOIN n USING (id) GROUP BY depth")
def depth_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: nodes per shortest depth from one entry, with their async count."""
    g = _g(spark, d)
    reached = traverse.bfs(g.edges, _start(spark, "region#0"), 10)
    return reached.join(g.nodes.select("id", "is_async"), "id").groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if("is_async").alias("async_nodes"))


_OVERLAP = "p AS (SELECT 0 AS part, * FROM n WHERE ord % 3 <> 0 UNION ALL SELECT 1, * FROM n WHERE ord % 3 <> 1 UNION ALL SELECT 2, * FROM n WHERE ord % 3 <> 2) "


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    nodes = tables.entity_nodes(spark, d)
    return [nodes.filter(F.col("ord") % 3 != i).withColumn("line", F.col("line") + 1000 * i) for i in range(3)]


@query("gb1_node_dedup", G + ", " + _OVERLAP + "SELECT id, min(line + 1000 * part) AS line FROM p GROUP BY id")
def node_dedup(spark, d):
    a, b, c = _parts(spark, d)
    all_ = a.unionByName(b).unionByName(c).withColumn("ord", F.col("line").cast("long"))
    return build.dedup_nodes(all_).select("id", "line")


@query("gb2_edge_dedup", G + "SELECT src || '->' || dst AS id, min(type) AS type FROM e GROUP BY ALL")
def edge_dedup(spark, d):
    e = tables.entity_edges(spark, d).withColumn("id", F.concat_ws("->", "src", "dst")).withColumn("ord", F.col("type"))
    return build.dedup_edges(e).select("id", "type")


@query("gb3_placeholder_nodes", WEB + "SELECT DISTINCT dst AS id, 'placeholder' AS name, 'unknown' AS file_path, 0 AS line FROM e WHERE dst NOT IN (SELECT id FROM n)")
def placeholder_nodes(spark, d):
    g = tables.web_graph(spark, d)
    return build.placeholders(g.nodes, g.edges).select("id", "name", "file_path", "line")


@query("gb4_adjacency", G + "SELECT src, count(*) AS neighbours FROM a GROUP BY src")
def adjacency(spark, d):
    return build.adjacency(tables.entity_edges(spark, d)).groupBy("src").agg(F.count("*").alias("neighbours"))


@query("gb4_reverse_adjacency", G + "SELECT dst AS src, count(*) AS neighbours FROM a GROUP BY dst")
def reverse_adjacency(spark, d):
    return build.reverse_adjacency(tables.entity_edges(spark, d)).groupBy("src").agg(F.count("*").alias("neighbours"))


@query("gb6_file_count", G + "SELECT 'region#0' AS entry_point, 10 AS max_depth, count(DISTINCT file_path) AS total_files, count(*) AS total_nodes FROM n")
def file_count(spark, d):
    return build.summary(_g(spark, d), "region#0").drop("graph_id")


@query("gb7_lookup", G + "SELECT id, name, line FROM n WHERE id = 'customer#7'")
def lookup(spark, d):
    return _g(spark, d).nodes.filter("id = 'customer#7'").select("id", "name", "line")


@query(
    "gb8_merge_results",
    G + ", " + _OVERLAP + ", m AS (SELECT id, max(part) AS part FROM p GROUP BY id), l AS (SELECT name, arg_min(id, ord) AS id FROM n GROUP BY name), x AS (SELECT coalesce(l.id, r_name) AS dst FROM region LEFT JOIN l ON l.name = r_name) "
    "SELECT 'node' AS kind, id, part::BIGINT AS n FROM m UNION ALL SELECT 'edge', dst, count(*) FROM x WHERE dst IN (SELECT id FROM m) GROUP BY dst",
)
def merge_results(spark, d):
    parts = [CallGraph(p.withColumn("marker", F.lit(i)), e) for i, (p, e) in enumerate(zip(_parts(spark, d), [_name_edges(spark, d)] + [_name_edges(spark, d).limit(0)] * 2, strict=True))]
    merged = build.merge_results(parts)
    nodes = merged.nodes.select(F.lit("node").alias("kind"), "id", F.col("marker").cast("long").alias("n"))
    return nodes.unionByName(merged.edges.groupBy(F.lit("edge").alias("kind"), F.col("dst").alias("id")).agg(F.count("*").alias("n")))


def _name_edges(spark, d):
    return tables.table(spark, d, "region").select(F.lit("entity").alias("graph_id"), F.lit("customer#1").alias("src"), F.col("r_name").alias("dst"), F.lit("sync").alias("type"))


@query("gb9_concat", G + "SELECT type, 2 * count(*) AS n FROM e GROUP BY type")
def concat(spark, d):
    g = _g(spark, d)
    return build.concat_results([g, g]).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("gb10_file_results", G + "SELECT n.file_path, sum((n.type = 'function')::INT)::BIGINT AS function_count, count(DISTINCT class_name) AS class_count, count(*) AS node_count, coalesce(any_value(c.calls), 0) AS calls FROM n LEFT JOIN (SELECT file_path, count(*) AS calls FROM e JOIN n ON n.id = e.src GROUP BY file_path) c USING (file_path) GROUP BY n.file_path")
def file_results(spark, d):
    return build.file_results(_g(spark, d)).drop("graph_id")


@query("gb12_diagram_entry", TALK + "SELECT graph_id, arg_min(id, ord) AS entry_point_id FROM n GROUP BY graph_id")
def diagram_entry(spark, d):
    g = tables.dialogue_graph(spark, d)
    return build.diagram_entry(g.nodes, g.edges)


# --- filters --------------------------------------------------------------------------------------


@query("fil1_file_filter", G + "SELECT id FROM n WHERE NOT regexp_matches(file_path, 'orders') AND regexp_matches(file_path, '[0-4][.]ts$')")
def file_filter(spark, d):
    return filters.filter_files(_g(spark, d).nodes, AnalysisOptions(exclude_patterns=("orders",), include_patterns=("[0-4][.]ts$",))).select("id")


@query("fil2_test_files", "SELECT url, regexp_matches(url, '[.](test|spec)[.](ts|js)$') OR contains(url, '/__tests__/') OR contains(url, '/test/') OR contains(url, '/tests/') AS is_test FROM pages")
def test_files(spark, d):
    return tables.table(spark, d, "pages").select("url", C.is_test_file(F.col("url")).alias("is_test"))


@query("fil3_node_filter", G + "SELECT id FROM n WHERE type IN ('method', 'function') AND regexp_matches(file_path, 'src/(nation|part|orders)/') AND NOT regexp_matches(file_path, '/9[.]ts$')")
def node_filter(spark, d):
    return filters.filter_nodes(_g(spark, d).nodes, ["method", "function"], ("src/(nation|part|orders)/",), ("/9[.]ts$",)).select("id")


@query("fil4_edge_filter", G + "SELECT src, count(*) AS n FROM e WHERE type IN ('async', 'callback') GROUP BY src")
def edge_filter(spark, d):
    return filters.filter_edges(_g(spark, d).edges, ["async", "callback"]).groupBy("src").agg(F.count("*").alias("n"))


@query("fil5_wildcard_nodes", G + "SELECT id FROM n WHERE regexp_matches(name, '(?i)^customer#.*1$') OR regexp_matches(id, '(?i)^customer#.*1$')")
def wildcard_nodes(spark, d):
    return filters.match_nodes(_g(spark, d).nodes, "CUSTOMER#*1").select("id")


@query("fil6_glob_filter", G + "SELECT id FROM n WHERE file_path SIMILAR TO 'src/(part|region)/[0-9].ts' AND file_path NOT LIKE '%/3.ts'")
def glob_filter(spark, d):
    return filters.match_globs(_g(spark, d).nodes, ["src/part/*.ts", "**/region/?.ts"], ["**/3.ts"]).select("id")


@query("fil7_external", "SELECT count(*) AS kept FROM pages WHERE NOT (contains(url, 'node_modules') OR contains(url, '@types/') OR url LIKE '%.d.ts')")
def external(spark, d):
    return filters.drop_external(tables.table(spark, d, "pages").withColumnRenamed("url", "file_path")).agg(F.count("*").alias("kept"))


@query("fil8_search", "SELECT p_name, p_partkey FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 20")
def search(spark, d):
    return tables.table(spark, d, "part").select("p_name", "p_partkey").filter(F.lower("p_name").contains("a")).orderBy("p_partkey").limit(20)


# --- traversal ------------------------------------------------------------------------------------


@query("trv1_bounded_expansion", _reach("nation#3", 2) + "SELECT src, dst, type, count(*) AS n FROM e WHERE src IN (SELECT id FROM r) GROUP BY ALL")
def bounded_expansion(spark, d):
    _, edges = traverse.bounded_expansion(_g(spark, d).edges, _start(spark, "nation#3"), 3)
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


@query("trv3_bfs_depth", _reach("region#0", 10) + "SELECT id, depth FROM r")
def bfs_depth(spark, d):
    return traverse.bfs(_g(spark, d).edges, _start(spark, "region#0"), 10).select("id", "depth")


@query("trv4_subgraph_nodes", _reach("nation#5", 2) + "SELECT n.id, name, n.type FROM n JOIN r USING (id)")
def subgraph_nodes(spark, d):
    g = _g(spark, d)
    return traverse.subgraph(g.nodes, g.edges, _start(spark, "nation#5"), 2)[0].select("id", "name", "type")


@query("trv4_subgraph_edges", _reach("nation#5", 3) + "SELECT src, dst, type, count(*) AS n FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r) GROUP BY ALL")
def subgraph_edges(spark, d):
    g = _g(spark, d)
    return traverse.subgraph(g.nodes, g.edges, _start(spark, "nation#5"), 3)[1].groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


@query("trv5_cyclic_nodes", FLOW + ", q AS (SELECT graph_id, src, dst FROM a UNION SELECT q.graph_id, q.src, a.dst FROM q JOIN a ON a.graph_id = q.graph_id AND a.src = q.dst) SELECT graph_id, src AS id FROM q WHERE src = dst")
def cyclic_nodes(spark, d):
    return traverse.cyclic_nodes(tables.flow_graph(spark, d).edges)


@query("trv5_strong_components", FLOW + ", q AS (SELECT graph_id, src, dst FROM a UNION SELECT q.graph_id, q.src, a.dst FROM q JOIN a ON a.graph_id = q.graph_id AND a.src = q.dst) SELECT x.graph_id, x.src AS id, max(x.dst) AS component FROM q x JOIN q y ON x.graph_id = y.graph_id AND x.src = y.dst AND x.dst = y.src GROUP BY ALL")
def strong_components(spark, d):
    return traverse.strong_components(tables.flow_graph(spark, d).edges)


@query("trv6_two_cycles", FLOW + "SELECT a.graph_id, a.src AS a, a.dst AS b FROM a JOIN a z ON a.graph_id = z.graph_id AND a.src = z.dst AND a.dst = z.src WHERE a.src < a.dst")
def two_cycles(spark, d):
    return traverse.two_cycles(tables.flow_graph(spark, d).edges)


@query("trv7_self_loops", FLOW + "SELECT graph_id, src AS id FROM a WHERE src = dst")
def self_loops(spark, d):
    return traverse.self_loops(tables.flow_graph(spark, d).edges)


@query("trv11_roots", G + "SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)")
def roots(spark, d):
    g = _g(spark, d)
    return traverse.roots(g.nodes, g.edges).select("id")


@query("trv12_max_depth", TALK + "SELECT graph_id, (count(*) - 1)::INT AS max_depth FROM n GROUP BY graph_id")
def max_depth(spark, d):
    g = tables.dialogue_graph(spark, d)
    return traverse.max_depth(g.nodes, g.edges)


@query("trv13_longest_path", G + ", q(id, level) AS (SELECT id, 1 FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT a.dst, level + 1 FROM q JOIN a ON a.src = q.id) SELECT id, max(level) AS level FROM q GROUP BY id")
def longest_path(spark, d):
    g = _g(spark, d)
    return traverse.longest_paths(g.nodes, g.edges).select("id", "level")


@query("trv14_components", TALK + "SELECT graph_id, id, min(id) OVER (PARTITION BY graph_id) AS component FROM n")
def components(spark, d):
    g = tables.dialogue_graph(spark, d)
    return traverse.weak_components(g.nodes, g.edges)


@query("trv14_entity_components", G + ", u AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a), l AS MATERIALIZED (SELECT count(*) AS n, min(id) AS low FROM n), q(id) AS (SELECT low FROM l UNION SELECT u.dst FROM q JOIN u ON u.src = q.id) SELECT (SELECT low FROM l) AS component, count(*) AS n FROM q UNION ALL SELECT id, 1 FROM n WHERE id NOT IN (SELECT id FROM q)")
def entity_components(spark, d):
    g = _g(spark, d)
    return traverse.weak_components(g.nodes, g.edges).groupBy("component").agg(F.count("*").alias("n"))


@query("trv15_avg_in_degree", G + "SELECT round((SELECT count(*) FROM e) / count(*), 6) AS avg_in_degree FROM n")
def avg_in_degree(spark, d):
    g = _g(spark, d)
    return traverse.average_in_degree(g.nodes, g.edges).select(F.round("avg_in_degree", 6).alias("avg_in_degree"))


@query("trv16_call_tree", TALK + ", q AS (SELECT graph_id, id, id AS path, 0 AS depth FROM n WHERE ord = (SELECT min(ord) FROM n) UNION ALL SELECT q.graph_id, e.dst, path || '>' || e.dst, depth + 1 FROM q JOIN e ON e.graph_id = q.graph_id AND e.src = q.id) SELECT graph_id, path, id, depth, depth > 10 AS circular FROM q")
def call_tree(spark, d):
    g = tables.dialogue_graph(spark, d)
    first = g.nodes.agg(F.min("ord").alias("ord"))
    return traverse.call_tree(g.edges, g.nodes.join(F.broadcast(first), "ord").select("graph_id", "id"))


@query("trv2_dfs_order", TALK + "SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY ord) - 1 AS dfs_ord, row_number() OVER (PARTITION BY graph_id ORDER BY ord) - 1 AS depth FROM n")
def dfs_order(spark, d):
    g = tables.dialogue_graph(spark, d)
    return traverse.dfs_order(g.edges, traverse.roots(g.nodes, g.edges))


@query("trv5_back_edge_cycles")
def back_edge_cycles(spark, d):
    return traverse.back_edge_cycles(tables.flow_graph(spark, d).edges).select("graph_id", "cycle_no", F.array_join("path", ">").alias("path"))


@query("trv17_sequence_steps", TALK + "SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY ord) AS step, src, dst, type FROM e QUALIFY step <= 6")
def sequence_steps(spark, d):
    g = tables.dialogue_graph(spark, d)
    return traverse.sequence_steps(g.edges, traverse.roots(g.nodes, g.edges))


@query("ep13_multi_source", G + ", q(root, id, depth) AS (SELECT id, id, 0 FROM n WHERE id LIKE 'region#%' UNION SELECT q.root, a.dst, q.depth + 1 FROM q JOIN a ON a.src = q.id WHERE depth < 3) SELECT root, count(DISTINCT id) AS nodes, max(depth) AS depth FROM q GROUP BY root")
def multi_source(spark, d):
    g = _g(spark, d)
    starts = g.nodes.filter("id like 'region#%'").select("graph_id", F.col("id").alias("root"), "id")
    return traverse.bfs(g.edges, starts, 3, ("graph_id", "root")).groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


# --- aggregates -----------------------------------------------------------------------------------


@query("agg1_totals", G + "SELECT count(*) AS total_nodes, count(*) FILTER (WHERE is_async) AS async_nodes, count(*) FILTER (WHERE is_static AND type = 'method') AS static_methods, (SELECT count(*) FROM e) AS total_edges FROM n")
def totals(spark, d):
    g = _g(spark, d)
    return metrics.totals(g.nodes, g.edges).drop("graph_id")


@query("agg2_node_types", G + "SELECT type, count(*) AS n FROM n GROUP BY type")
def node_types(spark, d):
    return metrics.distribution(_g(spark, d).nodes).drop("graph_id")


@query("agg2_edge_types", G + "SELECT type, count(*) AS n FROM e GROUP BY type")
def edge_types(spark, d):
    return metrics.distribution(_g(spark, d).edges).drop("graph_id")


@query("agg3_file_distribution", G + "SELECT split_part(file_path, '/', 3) AS file, count(*) AS n FROM n GROUP BY ALL")
def file_distribution(spark, d):
    return metrics.file_distribution(_g(spark, d).nodes).drop("graph_id")


@query("agg3_top_files", G + "SELECT file_path AS file, count(*) AS n FROM n GROUP BY ALL ORDER BY n DESC, file LIMIT 10")
def top_files(spark, d):
    return metrics.file_distribution(_g(spark, d).nodes, relative=True, top=10).drop("graph_id")


for _end, _name in (("src", "out"), ("dst", "in")):
    query(f"agg5_fan_{_name}", G + f"SELECT {_end} AS id, count(*) AS n FROM e GROUP BY ALL")(lambda spark, d, end=_end: metrics.fan(_g(spark, d).edges, end).drop("graph_id"))
    query(f"agg6_distinct_{_name}", G + f"SELECT {_end} AS id, count(*) AS n FROM a GROUP BY ALL")(lambda spark, d, end=_end: metrics.fan(_g(spark, d).edges, end, distinct=True).drop("graph_id"))


@query("agg7_avg_fan_calls", G + "SELECT round(count(*) / count(DISTINCT src), 6) AS avg_fan_out, round(count(*) / count(DISTINCT dst), 6) AS avg_fan_in FROM e")
def avg_fan_calls(spark, d):
    return metrics.average_fan_of_callers(_g(spark, d).edges).select(F.round("avg_fan_out", 6).alias("avg_fan_out"), F.round("avg_fan_in", 6).alias("avg_fan_in"))


@query("agg8_avg_fan_nodes", G + "SELECT round((SELECT count(*) FROM a) / count(*), 6) AS avg_fan FROM n")
def avg_fan_nodes(spark, d):
    g = _g(spark, d)
    return metrics.average_fan_of_nodes(g.nodes, g.edges).select(F.round("avg_fan", 6).alias("avg_fan"))


@query("agg9_hotspots_distinct", G + "SELECT id, count(a.src) AS n, ord FROM n LEFT JOIN a ON a.dst = n.id GROUP BY id, ord ORDER BY n DESC, ord LIMIT 10")
def hotspots_distinct(spark, d):
    g = _g(spark, d)
    return metrics.hotspots_distinct(g.nodes, g.edges).select("id", "n", "ord")


@query("agg10_hotspots_calls", G + "SELECT dst AS id, any_value(name) AS name, any_value(file_path) AS file_path, count(*) AS n FROM e JOIN n ON n.id = dst GROUP BY dst ORDER BY n DESC, id LIMIT 10")
def hotspots_calls(spark, d):
    g = _g(spark, d)
    return metrics.hotspots_calls(g.nodes, g.edges).drop("graph_id")


@query("agg11_hotspots_short", G + "SELECT dst AS id, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, id LIMIT 5")
def hotspots_short(spark, d):
    g = _g(spark, d)
    return metrics.hotspots_calls(g.nodes, g.edges, 5).select("id", "n")


@query("agg12_high_fan_out", G + "SELECT src AS id, count(*) AS n FROM e GROUP BY src HAVING n > 5")
def high_fan_out(spark, d):
    return metrics.high_fan(_g(spark, d).edges).drop("graph_id")


@query("agg13_high_fan_in", G + "SELECT dst AS id, count(*) AS n FROM e GROUP BY dst HAVING n > 3")
def high_fan_in(spark, d):
    return metrics.high_fan(_g(spark, d).edges, "dst", 3).drop("graph_id")


@query("agg14_max_depth", _reach("region#1", 10) + "SELECT max(depth) AS max_depth FROM r")
def depth_of_entry(spark, d):
    return traverse.bfs(_g(spark, d).edges, _start(spark, "region#1"), 10).agg(F.max("depth").alias("max_depth"))


@query("agg15_cyclomatic", TALK + "SELECT n.graph_id, 1::BIGINT AS components, greatest(1, count(DISTINCT e.src) - count(DISTINCT n.id) + 2) AS cyclomatic FROM n LEFT JOIN e USING (graph_id) GROUP BY n.graph_id")
def cyclomatic(spark, d):
    g = tables.dialogue_graph(spark, d)
    return metrics.cyclomatic(g.nodes, g.edges)


@query("agg16_cognitive", FLOW + ", c AS (SELECT a.graph_id, count(*) AS k FROM a JOIN a z ON a.graph_id = z.graph_id AND a.src = z.dst AND a.dst = z.src WHERE a.src <= a.dst GROUP BY ALL) SELECT x.graph_id, (2 * coalesce(any_value(k), 0) + floor(count(DISTINCT (src, dst)) / any_value(nodes)))::BIGINT AS cognitive FROM (SELECT graph_id, count(*) AS nodes FROM n GROUP BY ALL) x LEFT JOIN a USING (graph_id) LEFT JOIN c USING (graph_id) GROUP BY x.graph_id")
def cognitive(spark, d):
    """With the short cycles (loops and pairs) as the cycle list."""
    g = tables.flow_graph(spark, d)
    short = traverse.self_loops(g.edges).select("graph_id").unionByName(traverse.two_cycles(g.edges).select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("n"))
    return metrics.cognitive(g.nodes, g.edges, short).withColumn("cognitive", F.col("cognitive").cast("long"))


@query("agg18_connectivity", G + "SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def connectivity(spark, d):
    return metrics.connectivity(_g(spark, d).edges).drop("graph_id")


@query("agg20_batch_summary", G + ", b AS (SELECT id, count(src) > 2 AS success, count(src) * 10 AS millis FROM n LEFT JOIN e ON src = id WHERE id LIKE 'region#%' GROUP BY id) SELECT count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, sum(millis)::BIGINT AS millis FROM b")
def batch_summary(spark, d):
    g = _g(spark, d)
    runs = g.nodes.filter("id like 'region#%'").join(g.edges.select(F.col("src").alias("id"), "dst"), "id", "left").groupBy("id").agg((F.count("dst") > 2).alias("success"), (F.count("dst") * 10).alias("millis"))
    return metrics.batch_summary(runs)


@query("agg23_comparison", TALK + "SELECT n.graph_id, count(DISTINCT name) AS unique_functions, any_value(c) AS calls, (count(DISTINCT id) - 1)::INT AS max_depth FROM n LEFT JOIN (SELECT graph_id, count(*) AS c FROM e GROUP BY ALL) USING (graph_id) GROUP BY n.graph_id")
def comparison(spark, d):
    g = tables.dialogue_graph(spark, d)
    reached = traverse.bfs(g.edges, traverse.roots(g.nodes, g.edges))
    return metrics.comparison(g.nodes.withColumn("file_path", F.lit("f")), g.edges, reached).drop("files")


# --- joins, sorts, sets ---------------------------------------------------------------------------


@query("jn1_edge_names", G + "SELECT coalesce(s.name, 'unknown') AS source_name, coalesce(t.name, 'unknown') AS target_name, e.type, count(*) AS n FROM e LEFT JOIN n s ON s.id = src LEFT JOIN n t ON t.id = dst GROUP BY ALL")
def edge_names(spark, d):
    g = _g(spark, d)
    return named_edges(g.nodes, g.edges).groupBy("source_name", "target_name", "type").agg(F.count("*").alias("n"))


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the names of both ends, 'unknown' for strangers."""
    side = lambda end, name: nodes.select("graph_id", F.col("id").alias(end), F.col("name").alias(name))
    out = edges.join(side("src", "source_name"), ["graph_id", "src"], "left").join(side("dst", "target_name"), ["graph_id", "dst"], "left")
    return out.fillna("unknown", ["source_name", "target_name"])


@query("jn7_dangling_edges", WEB + "SELECT src, dst, count(*) AS n FROM e WHERE dst NOT IN (SELECT id FROM n) GROUP BY ALL")
def dangling(spark, d):
    g = tables.web_graph(spark, d)
    return build.dangling_edges(g.nodes, g.edges).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("jn7_inner_edges", WEB + "SELECT count(*) AS n FROM e WHERE dst IN (SELECT id FROM n) AND src IN (SELECT id FROM n)")
def inner(spark, d):
    g = tables.web_graph(spark, d)
    return build.inner_edges(g.nodes, g.edges).agg(F.count("*").alias("n"))


@query("jn12_cache_hits", "WITH c AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) SELECT CASE WHEN c.h IS NULL THEN 'miss' WHEN c.h = md5(text) THEN 'hit' ELSE 'stale' END AS state, count(*) AS n FROM documents d LEFT JOIN c USING (doc_id) GROUP BY ALL")
def cache_hits(spark, d):
    """A cache made of three quarters of the texts, a third of them changed since."""
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").alias("content"))
    old = docs.filter("doc_id % 4 <> 0").withColumn("content", F.when(F.expr("doc_id % 3 = 0"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    both = docs.select("path", F.md5("content").alias("now")).join(old.select("path", F.md5("content").alias("then")), "path", "left")
    state = F.when(F.col("then").isNull(), "miss").when(F.col("then") == F.col("now"), "hit").otherwise("stale")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("srt1_top_callers", G + "SELECT src AS id, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, id LIMIT 10")
def top_callers(spark, d):
    return metrics.high_fan(_g(spark, d).edges, "src", 0, 10).drop("graph_id")


@query("srt3_node_limit", G + "SELECT id, coalesce(c.n, 0) AS n FROM n LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) c USING (id) ORDER BY id = 'region#0' DESC, n DESC, ord LIMIT 50")
def node_limit(spark, d):
    g = _g(spark, d)
    return metrics.most_connected(g.nodes, g.edges, _start(spark, "region#0"), 50).drop("graph_id")


@query("srt4_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent(spark, d):
    return tables.table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


@query("set2_distinct_files", G + "SELECT DISTINCT file_path FROM n")
def distinct_files(spark, d):
    return _g(spark, d).nodes.select("file_path").distinct()


@query("set3_uncalled", G + "SELECT id FROM n WHERE id NOT IN (SELECT src FROM e)")
def leaves(spark, d):
    g = _g(spark, d)
    return g.nodes.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti").select("id")


@query("set4_edges_among", G + "SELECT src, dst FROM a WHERE src IN (SELECT id FROM n WHERE is_async) AND dst IN (SELECT id FROM n WHERE is_async)")
def edges_among(spark, d):
    g = _g(spark, d)
    return build.inner_edges(g.nodes.filter("is_async"), build.adjacency(g.edges)).select("src", "dst")


# --- validation -----------------------------------------------------------------------------------

SPEC = validate.Specification(
    entry_point="AFRICA",
    required_edges=(("region#0", "nation#*", "sync"), ("region#0", "customer#1", "sync"), ("ghost", "region#0", "sync"), ("region#1", "ghost*", "sync")),
    forbidden_edges=(("nation#1", "customer#*", None), ("customer#*7", "order#*3", "async")),
    required_nodes=("region#*", "ghost", "supplier#1"),
    forbidden_nodes=("nation#2*", "part#1"),
    max_depth=3,
    max_complexity=5,
)


@query("val2_entry_point", G + "SELECT id, CASE WHEN name = 'AFRICA' THEN NULL ELSE 'type_mismatch' END AS kind FROM n WHERE id IN ('region#0', 'region#1') AND name <> 'AFRICA' UNION ALL SELECT 'nobody', 'missing_node'")
def val_entry(spark, d):
    return validate.entry_point(_g(spark, d), _start(spark, "region#0", "region#1", "nobody"), SPEC).select("id", "kind")


@query("val3_required_edges", G + "SELECT 0 AS rule_ord, CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = 'region#0' AND dst LIKE 'nation#%' AND type = 'sync') THEN 'found' ELSE 'missing_edge' END AS status UNION ALL SELECT 1, 'missing_edge' UNION ALL SELECT 2, 'missing_source' UNION ALL SELECT 3, 'missing_target'")
def val_required(spark, d):
    return validate.required_edges(_g(spark, d), SPEC).select("rule_ord", "status")


@query("val4_forbidden_edges", G + "SELECT 0 AS rule_ord, src, dst FROM e WHERE src = 'nation#1' AND dst LIKE 'customer#%' UNION ALL SELECT 1, src, dst FROM e WHERE src LIKE 'customer#%7' AND dst LIKE 'order#%3' AND type = 'async'")
def val_forbidden(spark, d):
    return validate.forbidden_edges(_g(spark, d), SPEC).select("rule_ord", "src", "dst")


@query("val5_required_nodes", "SELECT 1 AS rule_ord, 'ghost' AS pattern")
def val_required_nodes(spark, d):
    return validate.required_nodes(_g(spark, d), SPEC).select("rule_ord", "pattern")


@query("val6_forbidden_nodes", G + "SELECT 'nation#2*' AS pattern, id FROM n WHERE id LIKE 'nation#2%' UNION ALL SELECT 'part#1', id FROM n WHERE id = 'part#1'")
def val_forbidden_nodes(spark, d):
    return validate.forbidden_nodes(_g(spark, d), SPEC).select("pattern", "id")


@query("val7_limits", TALK + "SELECT graph_id, 'performance' AS kind, (count(*) - 1)::BIGINT AS actual, 3::BIGINT AS allowed FROM n GROUP BY graph_id HAVING count(*) > 4")
def val_limits(spark, d):
    g = tables.dialogue_graph(spark, d)
    return validate.limits(g, SPEC, traverse.max_depth(g.nodes, g.edges))


@query("val8_summary", G + ", f AS (SELECT (SELECT count(*) FROM e WHERE src = 'nation#1' AND dst LIKE 'customer#%') + (SELECT count(*) FROM e WHERE src LIKE 'customer#%7' AND dst LIKE 'order#%3' AND type = 'async') AS k), u AS (SELECT count(*) AS k FROM n WHERE id LIKE 'nation#2%' OR id = 'part#1') SELECT 1::BIGINT AS required_found, 4::BIGINT AS required_total, 3 + f.k + 1 + u.k AS errors, f.k AS forbidden_found, 1::BIGINT AS missing_nodes, u.k AS unexpected_nodes, false AS is_valid FROM f, u")
def val_summary(spark, d):
    return validate.summary(_g(spark, d), SPEC).drop("graph_id")


@query("val10_diff", G + "SELECT 'found' AS kind, 'region#*' AS item UNION ALL SELECT 'found', 'supplier#1' UNION ALL SELECT 'missing', 'ghost' UNION ALL SELECT 'additional', id FROM n WHERE id NOT LIKE 'region#%' AND id <> 'supplier#1'")
def val_diff(spark, d):
    return validate.difference(_g(spark, d), SPEC).select("kind", "item")


# --- circular references --------------------------------------------------------------------------

_CLOSED = FLOW + ", q AS (SELECT graph_id, src, dst FROM a UNION SELECT q.graph_id, q.src, a.dst FROM q JOIN a ON a.graph_id = q.graph_id AND a.src = q.dst), c AS (SELECT a.graph_id, a.src, a.dst FROM a JOIN q ON q.graph_id = a.graph_id AND q.src = a.dst AND q.dst = a.src UNION SELECT graph_id, src, dst FROM a WHERE src = dst) "


@query("cir1_omit", _CLOSED + "SELECT graph_id, src, dst, count(*) AS n FROM e WHERE (graph_id, src, dst) NOT IN (SELECT (graph_id, src, dst) FROM c) GROUP BY ALL")
def cir_omit(spark, d):
    return circular.omit(tables.flow_graph(spark, d).edges).groupBy("graph_id", "src", "dst").agg(F.count("*").alias("n"))


@query("cir3_mark", _CLOSED + "SELECT graph_id, src, dst, (graph_id, src, dst) IN (SELECT (graph_id, src, dst) FROM c) AS circular, count(*) AS n FROM e GROUP BY ALL")
def cir_mark(spark, d):
    return circular.reference(tables.flow_graph(spark, d).edges).groupBy("graph_id", "src", "dst", "circular").agg(F.count("*").alias("n"))


@query("cir2_omit_closing")
def cir_closing(spark, d):
    return circular.omit_closing(tables.flow_graph(spark, d).edges).select("graph_id", "src", "dst", "ord")


@query("cir4_inline_once")
def cir_inline(spark, d):
    return circular.inline_once(tables.flow_graph(spark, d).edges).select("graph_id", F.size("cycles").alias("cycles"))
