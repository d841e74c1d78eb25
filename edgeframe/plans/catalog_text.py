"""Registered queries of the text side: sources, diagrams, formats, caches and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeframe.operators import entrypoints, filters, metrics, resolve, traverse
from edgeframe.plans.catalog import TALK, G, query
from edgeframe.scratch import folder, written
from edgeframe.sinks import lines
from edgeframe.sources import mermaid, tables, typescript
from edgeframe.streaming import incremental

#: A small project of our own.
SOURCES = {
    "src/user.controller.ts": "import { UserService } from './user.service';\nexport class UserController {\n  constructor(private service: UserService) {}\n  async getUser(id: string) { return await this.service.find(id); }\n  listUsers() { return this.service.all().map(u => this.view(u)); }\n  private view(u) { return u; }\n}\n",
    "src/user.service.ts": "import { query } from './db';\nexport class UserService {\n  async find(id: string) { return query(id); }\n  all() { return query('*'); }\n}\n",
    "src/db.ts": "export async function query(q: string): Promise<any> { if (q) { return connect(q); } return null; }\nfunction connect(q) { return new Pool(q); }\nclass Pool { constructor(public q) {} }\n",
    "src/login.handler.ts": "export const loginHandler = async (req, res) => { check(req); };\nexport function routeIndex() {}\nfunction check(r) { check(r); }\n",
    "src/main.ts": "import { UserController } from './user.controller';\nimport { UserService } from './user.service';\nexport function main() { const c = new UserController(new UserService()); c.getUser('1'); }\nfunction helper() { main(); }\n",
}
DIAGRAMS = {
    "a.mmd": "flowchart TD\n  A[Start] --> B{Decision}\n  B -->|Yes| C[[Process 1]]\n  B -.->|No| D((End state))\n  subgraph Store\n    C ==> E[(Table)]\n  end\n  classDef hot fill:#f00,stroke:#000;\n  class A hot\n",
    "b.mmd": "graph LR\nendpoint --> graphql --- TDx\nA & B --> C --> D\n%% note\nclick A callback\n",
    "c.mmd": "flowchart TD\n A --> \n --> B\n",
}


def _sources(spark):
    return spark.createDataFrame(list(SOURCES.items()), "path string, content string")


def _facts(spark):
    return typescript.extract(_sources(spark))


@query("ext2_functions")
def ext_functions(spark, d):
    return resolve.function_nodes(_facts(spark)).select("id", "name", "type", "is_async", "is_static", "visibility", "return_type", "line")


@query("ext9_call_sites")
def ext_calls(spark, d):
    return _facts(spark).filter("kind in ('call', 'new')").select("path", "kind", "name", "receiver", "owner", "awaited", "argument", "conditional", "line")


@query("ext15_edges")
def ext_edges(spark, d):
    return resolve.call_edges(_facts(spark)).select("src", "dst", "type", "conditional")


@query("ext19_imports")
def ext_imports(spark, d):
    return resolve.imported_symbols(_facts(spark))


@query("src3_glob_scan", "SELECT url FROM pages WHERE url LIKE '%example%' AND NOT regexp_matches(url, '/en/')")
def glob_scan(spark, d):
    files = tables.table(spark, d, "pages").withColumnRenamed("url", "file_path")
    return filters.match_globs(files, ["**example**"], ["**/en/**"]).select(F.col("file_path").alias("url"))


@query("src5_file_lookup")
def file_lookup(spark, d):
    return entrypoints.find_files(_facts(spark), "user.service")


@query("ep2_find_function")
def find_function(spark, d):
    return entrypoints.find_entry(_facts(spark), "src/main.ts#main")


@query("ep3_find_member")
def find_member(spark, d):
    return entrypoints.find_entry(_facts(spark), "src/user.service.ts#UserService.find")


@query("ep5_discover")
def discover(spark, d):
    return entrypoints.discover(_facts(spark)).select("kind", "file_path", "function_name", "class_name")


@query("ep6_by_path")
def by_path(spark, d):
    return entrypoints.discover_by_path(_facts(spark), ("user[.]", "db")).select("kind", "id")


@query("ep11_common_patterns")
def common(spark, d):
    return entrypoints.common_patterns(_facts(spark)).select("kind", "id")


@query("trv0_analyze")
def analyze(spark, d):
    from edgeframe.plans import api

    return api.analyze(_sources(spark), "src/main.ts#main").edges.select("src", "dst", "type")


@query("prs1_tokens")
def tokens(spark, d):
    return mermaid.token_rows(spark.createDataFrame(list(DIAGRAMS.items()), "path string, content string"))


@query("prs4_diagram_nodes")
def diagram_nodes(spark, d):
    return mermaid.read_diagrams(spark.createDataFrame(list(DIAGRAMS.items()), "path string, content string")).nodes.select("graph_id", "id", "name", "type", "class_name")


@query("gb11_diagram_edges")
def diagram_edges(spark, d):
    return mermaid.read_diagrams(spark.createDataFrame(list(DIAGRAMS.items()), "path string, content string")).edges.select("graph_id", "id", "src", "dst", "type")


# --- formats --------------------------------------------------------------------------------------


_KEY = "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g')"


@query("snk11_sequence", TALK + "SELECT graph_id, 'steps' AS section, count(*) AS n FROM e WHERE ord <= (SELECT min(ord) FROM n) + 5 GROUP BY ALL UNION ALL SELECT graph_id, 'participants', least(count(*), 7) FROM n GROUP BY ALL HAVING count(*) > 1")
def sequence(spark, d):
    g = tables.dialogue_graph(spark, d)
    steps = traverse.sequence_steps(g.edges, traverse.roots(g.nodes, g.edges))
    return lines.sequence_lines(g.nodes, steps).groupBy("graph_id", "section").agg(F.count("*").alias("n"))


WHOLE = G + ", k AS (SELECT * FROM n), f AS (SELECT * FROM e) "
_ENDS = "FROM f LEFT JOIN k s ON s.id = src LEFT JOIN k t ON t.id = dst"
_KEYED = f""", u AS (SELECT *, {_KEY.format("name")} AS safe FROM k), v AS (SELECT *, safe || CASE row_number() OVER (PARTITION BY safe ORDER BY ord, id) WHEN 1 THEN '' ELSE '_' || row_number() OVER (PARTITION BY safe ORDER BY ord, id) END AS key FROM u), m AS (SELECT src, dst, type, count(*) AS c FROM f GROUP BY ALL) """
_SHAPE = """CASE type WHEN 'method' THEN '[["' || name || '"]]' WHEN 'constructor' THEN '{{"' || name || '"}}' WHEN 'arrow' THEN '("' || name || '")' ELSE '["' || name || '"]' END"""
_DRAWN = """CASE m.type WHEN 'async' THEN '-.->' WHEN 'callback' THEN '---' WHEN 'constructor' THEN '==>' ELSE '-->' END || CASE WHEN c > 1 THEN '|' || c || 'x|' WHEN m.type = 'async' THEN '|await|' WHEN m.type = 'callback' THEN '|callback|' ELSE '' END"""


@query("snk3_json_simple", WHOLE + """SELECT 'nodes' AS section, '{"id":"' || id || '","name":"' || name || '"}' AS line FROM k UNION ALL SELECT 'edges', '{"source":"' || src || '","target":"' || dst || '"}' FROM f""")
def json_simple(spark, d):
    return lines.json_lines(tables.entity_graph(spark, d), "simple").select("section", "line")


@query("snk3_json_compact", WHOLE + f""", i AS (SELECT id, row_number() OVER (ORDER BY ord, id) - 1 AS i FROM k) SELECT 'nodes' AS section, '["' || id || '","' || name || '","' || type || '"]' AS line FROM k UNION ALL SELECT 'edges', '[' || coalesce(s.i::VARCHAR, 'null') || ',' || coalesce(t.i::VARCHAR, 'null') || ',"' || f.type || '"]' {_ENDS.replace(" k ", " i ")}""")
def json_compact(spark, d):
    return lines.json_lines(tables.entity_graph(spark, d), "compact").select("section", "line")


@query("snk5_yaml_lines", WHOLE + f"""SELECT 'functions' AS section, '  - {{name: "' || name || '", file: "' || file_path || '", line: ' || line || ', type: ' || type || ', async: ' || is_async || '}}' AS line FROM k UNION ALL SELECT 'calls', '  - {{from: "' || coalesce(s.name, 'unknown') || '", to: "' || coalesce(t.name, 'unknown') || '", type: ' || f.type || '}}' {_ENDS}""")
def yaml_lines(spark, d):
    return lines.yaml_lines(tables.entity_graph(spark, d)).select("section", "line")


@query("snk9_mermaid_lines", WHOLE + _KEYED + f"""SELECT 'nodes' AS section, '  ' || key || {_SHAPE} AS line FROM v UNION ALL SELECT 'edges', '  ' || s.key || ' ' || {_DRAWN} || ' ' || t.key FROM m JOIN v s ON s.id = src JOIN v t ON t.id = dst""")
def mermaid_lines(spark, d):
    return lines.mermaid_lines(tables.entity_graph(spark, d)).select("section", "line")


@query("snk10_mermaid_clusters", WHOLE + "SELECT 'nodes:' || file_path AS section, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src, dst, type FROM f WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))")
def mermaid_clusters(spark, d):
    return lines.mermaid_lines(tables.entity_graph(spark, d), clusters=True).groupBy("section").agg(F.count("*").alias("n"))


@query("snk14_dot_lines", WHOLE + """SELECT 'nodes' AS section, '  "' || id || '" [label="' || name || '", shape=' || CASE type WHEN 'method' THEN 'ellipse' WHEN 'constructor' THEN 'diamond' WHEN 'arrow' THEN 'oval' ELSE 'box' END || ', tooltip="' || split_part(file_path, '/', 3) || ':' || line || '"' || CASE WHEN is_async THEN ', style=filled' ELSE '' END || '];' AS line FROM k UNION ALL SELECT 'edges', '  "' || src || '" -> "' || dst || '" [style=' || CASE type WHEN 'async' THEN 'dashed' WHEN 'callback' THEN 'dotted' WHEN 'constructor' THEN 'bold' ELSE 'solid' END || '];' FROM f""")
def dot_lines(spark, d):
    return lines.dot_lines(tables.entity_graph(spark, d)).select("section", "line")


@query("snk17_saved_lines", WHOLE + "SELECT 'nodes' AS section, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM f")
def saved(spark, d):
    path = f"{folder(spark)}/saved-{uuid.uuid4().hex}"
    lines.save(tables.entity_graph(spark, d), path, "dot")
    return spark.read.text(path).groupBy("section").agg(F.count("*").alias("n"))


def _bundle(spark, d):
    g = tables.entity_graph(spark, d)
    loops = traverse.self_loops(g.edges).groupBy("graph_id").agg(F.count("*").alias("n"))
    return metrics.bundle(g.nodes, g.edges, loops)


# as in agg15, the entity graph is one component
_BUNDLE = WHOLE + """, h AS (SELECT dst AS id, count(*) AS n FROM f GROUP BY dst ORDER BY n DESC, id LIMIT 10),
b AS (SELECT (SELECT count(*) FROM k) AS functions, (SELECT count(*) FROM f) AS calls, (SELECT count(DISTINCT file_path) FROM k) AS files,
  greatest(1, (SELECT count(*) FROM f) - (SELECT count(*) FROM k) + 2) AS cyclomatic,
  2 * (SELECT count(DISTINCT src) FROM f WHERE src = dst) + floor((SELECT count(*) FROM (SELECT DISTINCT src, dst FROM f)) / (SELECT count(*) FROM k))::BIGINT AS cognitive) """
_NUMBERS = ("functions", "calls", "files", "cyclomatic", "cognitive")


@query("agg17_metrics_bundle", _BUNDLE + "SELECT *, (SELECT string_agg(id || '=' || n, ',' ORDER BY n DESC, id) FROM h) AS hotspots FROM b")
def metrics_bundle(spark, d):
    b = _bundle(spark, d)
    return b.select("functions", "calls", "files", "cyclomatic", "cognitive", F.array_join(F.transform("hotspots", lambda h: F.concat_ws("=", h["id"], h["n"].cast("string"))), ",").alias("hotspots"))


_JSON = ",".join(f"""\"{n}\":' || {n} || '""" for n in _NUMBERS)


@query("snk2_json_statistics", _BUNDLE + f"""SELECT 'statistics' AS section, '"statistics":{{{_JSON},"hotspots":[' || (SELECT string_agg('{{"id":"' || id || '","n":' || n || '}}', ',' ORDER BY n DESC, id) FROM h) || ']}}' AS line FROM b""")
def json_statistics(spark, d):
    return lines.statistics_lines(_bundle(spark, d), "json").select("section", "line")


_YAML = " UNION ALL ".join(f"SELECT {i + 1}, '  {n}: ' || {n} FROM b" for i, n in enumerate(_NUMBERS))


@query("snk21_yaml_statistics", _BUNDLE + f"""SELECT 0::INT AS line_no, 'statistics:' AS line UNION ALL {_YAML} UNION ALL SELECT 6, '  hotspots:' UNION ALL SELECT (6 + row_number() OVER (ORDER BY n DESC, id))::INT, '    - {{id: "' || id || '", calls: ' || n || '}}' FROM h""")
def yaml_statistics(spark, d):
    return lines.statistics_lines(_bundle(spark, d), "yaml").select("line_no", "line")


# --- caches and streams -----------------------------------------------------------------------------


def _snapshots(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").alias("content"))
    before = docs.filter("doc_id % 5 <> 0")
    after = docs.filter("doc_id % 7 <> 0").withColumn("content", F.when(F.expr("doc_id % 3 = 0"), F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    return before, after


@query("str4_hash_diff", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0")
def hash_diff(spark, d):
    return incremental.snapshot_diff(*_snapshots(spark, d))


@query("src13_fingerprints", "SELECT doc_id::VARCHAR AS path, md5(doc_id::VARCHAR) AS path_key, md5(coalesce(text, '')) AS file_hash FROM documents")
def hashes(spark, d):
    docs = tables.table(spark, d, "documents")
    return incremental.fingerprints(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query("str2_last_change", "SELECT event_type || '.ts' AS path, arg_max(CASE WHEN value > 50 THEN 'change' ELSE 'unlink' END, event_id) AS kind FROM events GROUP BY ALL")
def last_change(spark, d):
    events = tables.table(spark, d, "events")
    changes = events.select(F.concat("event_type", F.lit(".ts")).alias("path"), F.when(F.col("value") > 50, "change").otherwise("unlink").alias("kind"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("content"))
    return incremental.last_changes(changes).select("path", "kind")


@query("str3_stream_changes")
def stream_changes(spark, d):
    """Three batches of changes through the stream into a cache: add all, change one, remove one."""
    base = f"{folder(spark)}/watch-{uuid.uuid4().hex}"
    first = [(p, "add", i, c) for i, (p, c) in enumerate(SOURCES.items())]
    for rows in (first, [("src/db.ts", "change", 10, "export function only() {}")], [("src/main.ts", "unlink", 11, None)]):
        spark.createDataFrame(rows, incremental.CHANGES).coalesce(1).write.mode("append").parquet(f"{base}/in")
    cache = incremental.Cache(spark, f"{base}/cache")
    stream = spark.readStream.schema(incremental.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    incremental.watch(stream, cache, f"{base}/checkpoint", available_now=True).awaitTermination()
    return written(cache.read().groupBy("path").agg(F.count("*").alias("facts")), "watch")


@query("snk20_prune")
def prune(spark, d):
    cache = incremental.Cache(spark, f"{folder(spark)}/cache-{uuid.uuid4().hex}")
    files = _sources(spark)
    incremental.analyze_incrementally(files, cache)
    cache.invalidate(files.filter("path like '%user%'").select("path"))
    cache.prune()
    return cache.stats().select("entries")
