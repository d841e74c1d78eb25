"""Text formats as DataFrames of lines.

Each writer gives (graph_id, section, ord, line), one row a line, made by
column expressions; :func:`text` joins the lines of one graph on the driver,
:func:`save` writes all graphs, a folder each.  The former is for graphs that
are meant to be read, the latter for any size.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeframe.functions.columns import base_name, escape_label, safe_id, short_path
from edgeframe.model import CallGraph

_ARROWS = {"sync": "-->", "async": "-.->", "callback": "---", "constructor": "==>"}


def _case(column: Column, values: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _order(df: DataFrame) -> Column:
    return F.col("ord") if "ord" in df.columns else F.xxhash64("src", "dst")


# --- JSON ------------------------------------------------------------------------------------------

_RENAMED = {"file_path": "filePath", "is_async": "async", "is_static": "static", "return_type": "returnType", "class_name": "className", "argument_types": "argumentTypes", "src": "source", "dst": "target"}


def _json(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(c).alias(_RENAMED.get(c, c)) for c in columns)))


def json_lines(graph: CallGraph, schema: str = "detailed") -> DataFrame:
    """A JSON object a node and an edge.  ``simple`` has names only, ``compact`` arrays over node numbers."""
    nodes, edges = graph.nodes, graph.edges
    if schema == "compact":
        numbered = nodes.withColumn("n", F.row_number().over(W.partitionBy("graph_id").orderBy("ord", "id")) - 1)
        at = lambda end: numbered.select("graph_id", F.col("id").alias(end), F.col("n").alias(f"{end}_n"))
        a = numbered.select("graph_id", F.lit("nodes").alias("section"), F.col("n").cast("long").alias("ord"), F.to_json(F.array("id", "name", "type")).alias("line"))
        joined = edges.join(at("src"), ["graph_id", "src"], "left").join(at("dst"), ["graph_id", "dst"], "left")
        b = joined.select("graph_id", F.lit("edges").alias("section"), _order(edges).cast("long").alias("ord"), F.concat(F.lit("["), F.coalesce(F.col("src_n").cast("string"), F.lit("null")), F.lit(","), F.coalesce(F.col("dst_n").cast("string"), F.lit("null")), F.lit(',"'), "type", F.lit('"]')).alias("line"))
        return a.unionByName(b)
    pick = {"simple": (["id", "name"], ["src", "dst"]), "detailed": ([c for c in nodes.columns if c not in ("graph_id", "ord")], [c for c in edges.columns if c not in ("graph_id", "ord")])}[schema]
    a = nodes.select("graph_id", F.lit("nodes").alias("section"), F.col("ord").cast("long").alias("ord"), _json(nodes, pick[0]).alias("line"))
    return a.unionByName(edges.select("graph_id", F.lit("edges").alias("section"), _order(edges).cast("long").alias("ord"), _json(edges, pick[1]).alias("line")))


def json_text(graph: CallGraph, graph_id: str, entry_point_id: str | None = None, metadata: dict | None = None, pretty: bool = False) -> str:
    """One graph as a document."""
    parts: dict[str, list] = {"nodes": [], "edges": []}
    for r in json_lines(graph).filter(F.col("graph_id") == graph_id).orderBy("section", "ord").toLocalIterator():
        parts[r.section].append(json.loads(r.line))
    return json.dumps({**({"metadata": metadata} if metadata else {}), **parts, "entryPointId": entry_point_id}, indent=2 if pretty else None, ensure_ascii=False)


# --- YAML ------------------------------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    """A double-quoted YAML scalar; JSON strings are ones."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def yaml_lines(graph: CallGraph) -> DataFrame:
    """``functions`` and ``calls`` of each graph; calls by the names of their ends."""
    nodes = graph.nodes
    line = F.concat(F.lit("  - {name: "), _quoted(F.col("name")), F.lit(", file: "), _quoted(short_path(F.col("file_path"))), F.lit(", line: "), F.col("line").cast("string"), F.lit(", type: "), F.col("type"), F.lit(", async: "), F.coalesce(F.col("is_async").cast("string"), F.lit("false")), F.lit("}"))
    a = nodes.select("graph_id", F.lit("functions").alias("section"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
    side = lambda end, name: nodes.select("graph_id", F.col("id").alias(end), F.col("name").alias(name))
    calls = graph.edges.join(side("src", "s"), ["graph_id", "src"], "left").join(side("dst", "t"), ["graph_id", "dst"], "left").fillna("unknown", ["s", "t"])
    line = F.concat(F.lit("  - {from: "), _quoted(F.col("s")), F.lit(", to: "), _quoted(F.col("t")), F.lit(", type: "), F.col("type"), F.lit("}"))
    return a.unionByName(calls.select("graph_id", F.lit("calls").alias("section"), _order(graph.edges).cast("long").alias("ord"), line.alias("line")))


def yaml_text(graph: CallGraph, graph_id: str, entry_point: str | None = None) -> str:
    out, section = [f"entry_point: {json.dumps(entry_point)}"], None
    rows = yaml_lines(graph).filter(F.col("graph_id") == graph_id).orderBy(F.col("section") == "calls", "ord")
    for r in rows.toLocalIterator():
        if r.section != section:
            section = r.section
            out.append(f"{section}:")
        out.append(r.line)
    return "\n".join(out) + "\n"


def specification_text(graph: CallGraph, graph_id: str, entry_point: str, max_depth: int = 10, max_complexity: int = 20) -> str:
    """A specification that the graph fulfils, in YAML."""
    names = {r.id: r.name for r in graph.nodes.filter(F.col("graph_id") == graph_id).select("id", "name").toLocalIterator()}
    calls = sorted({(names.get(r.src, "unknown"), names.get(r.dst, "unknown"), r.type) for r in graph.edges.filter(F.col("graph_id") == graph_id).select("src", "dst", "type").toLocalIterator()})
    out = [f"entry_point: {json.dumps(entry_point)}", "required_functions:", *(f"  - {{name: {json.dumps(n)}}}" for n in sorted(set(names.values())))]
    out += ["required_calls:", *(f"  - {{from: {json.dumps(a)}, to: {json.dumps(b)}, type: {t}}}" for a, b, t in calls), f"maxDepth: {max_depth}", f"maxComplexity: {max_complexity}"]
    return "\n".join(out) + "\n"


def tree_text(tree: DataFrame, graph_id: str) -> str:
    """A call tree as nested YAML lists."""
    rows = sorted(tree.filter(F.col("graph_id") == graph_id).toLocalIterator(), key=lambda r: r.path.split(">"))
    return "".join(f"{'  ' * r.depth}- {json.dumps(r.id)}{' # circular' if r.circular else ''}\n" for r in rows)


# --- Mermaid ---------------------------------------------------------------------------------------


def diagram_ids(nodes: DataFrame) -> DataFrame:
    """Nodes with ``key``, a diagram identifier; equal names are numbered (quirks Q22, Q28)."""
    named = nodes.withColumn("safe", safe_id(F.col("name")))
    n = F.row_number().over(W.partitionBy("graph_id", "safe").orderBy("ord", "id"))
    return named.withColumn("key", F.when(n == 1, F.col("safe")).otherwise(F.concat("safe", F.lit("_"), n.cast("string")))).drop("safe")


def mermaid_lines(graph: CallGraph, clusters: bool = False) -> DataFrame:
    """Node and edge lines of a flowchart; parallel edges become one with their number."""
    keyed = diagram_ids(graph.nodes)
    label = F.concat(F.lit('"'), F.replace(F.col("name"), F.lit('"'), F.lit("#quot;")), F.lit('"'))
    drawn = F.concat(F.lit("  "), F.col("key"), F.when(F.col("type") == "method", F.concat(F.lit("[["), label, F.lit("]]"))).when(F.col("type") == "constructor", F.concat(F.lit("{{"), label, F.lit("}}"))).when(F.col("type") == "arrow", F.concat(F.lit("("), label, F.lit(")"))).otherwise(F.concat(F.lit("["), label, F.lit("]"))))
    section = short_path(F.col("file_path")) if clusters else F.lit("")
    nodes = keyed.select("graph_id", F.concat(F.lit("nodes"), F.when(section != "", F.concat(F.lit(":"), section)).otherwise("")).alias("section"), F.col("ord").cast("long").alias("ord"), drawn.alias("line"))
    side = lambda end, k: keyed.select("graph_id", F.col("id").alias(end), F.col("key").alias(k))
    merged = graph.edges.groupBy("graph_id", "src", "dst", "type").agg(F.count("*").alias("n"), F.min(_order(graph.edges)).alias("ord"))
    both = merged.join(side("src", "s"), ["graph_id", "src"]).join(side("dst", "t"), ["graph_id", "dst"])
    note = F.when(F.col("n") > 1, F.concat(F.lit("|"), F.col("n").cast("string"), F.lit("x|"))).when(F.col("type") == "async", "|await|").when(F.col("type") == "callback", "|callback|").otherwise("")
    line = F.concat(F.lit("  "), "s", F.lit(" "), _case(F.col("type"), _ARROWS, "-->"), note, F.lit(" "), "t")
    return nodes.unionByName(both.select("graph_id", F.lit("edges").alias("section"), F.col("ord").cast("long").alias("ord"), line.alias("line")))


def mermaid_text(graph: CallGraph, graph_id: str, direction: str = "TD", clusters: bool = False) -> str:
    out, section = [f"flowchart {direction}"], None
    rows = mermaid_lines(graph, clusters).filter(F.col("graph_id") == graph_id).orderBy(F.col("section") == "edges", "section", "ord", "line")
    for r in rows.toLocalIterator():
        if r.section != section:
            if section and section.startswith("nodes:"):
                out.append("  end")
            section = r.section
            if section.startswith("nodes:"):
                out.append(f'  subgraph "{section[6:]}"')
        out.append(r.line)
    return "\n".join(out) + "\n"


def sequence_lines(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Participants and calls of a sequence diagram, from the steps of a depth-first walk."""
    keyed = diagram_ids(nodes)
    used = steps.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().join(keyed, ["graph_id", "id"])
    people = used.select("graph_id", F.lit("participants").alias("section"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("  participant "), "key", F.lit(" as "), "name").alias("line"))
    side = lambda end, k: keyed.select("graph_id", F.col("id").alias(end), F.col("key").alias(k))
    calls = steps.join(side("src", "s"), ["graph_id", "src"]).join(side("dst", "t"), ["graph_id", "dst"])
    line = F.concat(F.lit("  "), "s", F.when(F.col("type") == "async", "-->>").otherwise("->>"), "t", F.lit(": "), F.col("step").cast("string"), F.lit(". "), "type")
    return people.unionByName(calls.select("graph_id", F.lit("steps").alias("section"), F.col("step").alias("ord"), line.alias("line")))


# --- DOT -------------------------------------------------------------------------------------------


def dot_lines(graph: CallGraph) -> DataFrame:
    """Node and edge statements of a DOT digraph."""
    quote = lambda c: F.concat(F.lit('"'), escape_label(c), F.lit('"'))
    shape = _case(F.col("type"), {"method": "ellipse", "constructor": "diamond", "arrow": "oval", "accessor": "note"}, "box")
    tip = F.concat_ws(":", base_name(F.col("file_path")), F.col("line").cast("string"))
    node = F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.col("name")), F.lit(", shape="), shape, F.lit(", tooltip="), quote(tip), F.when(F.coalesce("is_async", F.lit(False)), ", style=filled").otherwise(""), F.lit("];"))
    style = _case(F.col("type"), {"async": "dashed", "callback": "dotted", "constructor": "bold"}, "solid")
    edge = F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [style="), style, F.lit("];"))
    a = graph.nodes.select("graph_id", F.lit("nodes").alias("section"), F.col("ord").cast("long").alias("ord"), node.alias("line"))
    return a.unionByName(graph.edges.select("graph_id", F.lit("edges").alias("section"), _order(graph.edges).cast("long").alias("ord"), edge.alias("line")))


def dot_text(graph: CallGraph, graph_id: str) -> str:
    rows = dot_lines(graph).filter(F.col("graph_id") == graph_id).orderBy(F.col("section") == "edges", "ord", "line")
    return "\n".join(["digraph calls {", *(r.line for r in rows.toLocalIterator()), "}"]) + "\n"


# --- all -------------------------------------------------------------------------------------------

LINES = {"json": json_lines, "yaml": yaml_lines, "mermaid": mermaid_lines, "dot": dot_lines}
TEXT = {"json": json_text, "yaml": yaml_text, "mermaid": mermaid_text, "dot": dot_text}


def save(graph: CallGraph, path: str, fmt: str = "json") -> None:
    """All graphs as line files, one folder a graph and section, written by the executors."""
    rows = LINES[fmt](graph).repartitionByRange("graph_id", "section", "ord").sortWithinPartitions("graph_id", "section", "ord")
    rows.select("graph_id", "section", F.col("line").alias("value")).write.mode("overwrite").partitionBy("graph_id", "section").text(path)


def problems(text: str, fmt: str) -> list[str]:
    """What is syntactically wrong with a written text."""
    if fmt == "json":
        try:
            data = json.loads(text)
        except ValueError as e:
            return [str(e)]
        return [f"no {k}" for k in ("nodes", "edges") if not isinstance(data.get(k), list)]
    if fmt == "yaml":
        try:
            import yaml
        except ImportError:
            return []
        try:
            return [] if isinstance(yaml.safe_load(text), dict) else ["not a mapping"]
        except yaml.YAMLError as e:
            return [str(e)]
    if fmt == "mermaid":
        from edgeframe.sources.mermaid import parse

        return [] if text.startswith("sequenceDiagram") else parse(text).errors
    bare = re.sub(r'"(?:\\.|[^"\\])*"', "", text)
    found = [] if re.match(r"\s*(?:strict\s+)?(?:di)?graph\b", bare) else ["no graph"]
    return found + (["unbalanced braces"] if bare.count("{") != bare.count("}") else []) + (["open quote"] if '"' in bare else [])


def statistics_lines(bundle: DataFrame, style: str = "json") -> DataFrame:
    """(graph_id, section, line_no, line): the statistics part of a JSON or YAML document, out of ``metrics.bundle``."""
    numbers = ("functions", "calls", "files", "cyclomatic", "cognitive")
    if style == "json":
        parts = F.struct(*numbers, "hotspots")
        return bundle.select("graph_id", F.lit("statistics").alias("section"), F.lit(0).alias("line_no"), F.concat(F.lit('"statistics":'), F.to_json(parts)).alias("line"))
    if style != "yaml":
        raise ValueError(f"unknown style {style}")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    spots = F.transform("hotspots", lambda h: F.concat(F.lit("    - {id: "), quoted(h["id"]), F.lit(", calls: "), h["n"].cast("string"), F.lit("}")))
    head = F.array(F.lit("statistics:"), *(F.concat(F.lit(f"  {n}: "), F.col(n).cast("string")) for n in numbers), F.when(F.size("hotspots") == 0, F.lit("  hotspots: []")).otherwise(F.lit("  hotspots:")))
    return bundle.select("graph_id", F.lit("statistics").alias("section"), F.posexplode(F.concat(head, spots)).alias("line_no", "line"))
