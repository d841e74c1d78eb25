"""Diagrams, specifications, formats, caches, streams and the public API."""

from __future__ import annotations

import json
from collections import Counter

import pytest

from edgeframe.model import AnalysisError, AnalysisOptions, CallGraph
from edgeframe.operators import entrypoints, resolve
from edgeframe.plans import api, catalog, catalog_text
from edgeframe.sinks import lines
from edgeframe.sources import mermaid, specs, typescript
from edgeframe.streaming import incremental


def shown(text):
    d = mermaid.parse(text)
    return list(d.nodes), [(e["src"], e["dst"], e["type"]) for e in d.edges], d.errors


def test_arrows_and_chains():
    assert shown("flowchart TD\nA --> B\nB -.-> C\nC ==> D\nD --- E") == (list("ABCDE"), [("A", "B", "sync"), ("B", "C", "async"), ("C", "D", "constructor"), ("D", "E", "callback")], [])
    assert shown("flowchart LR; A --> B --> C") == (list("ABC"), [("A", "B", "sync"), ("B", "C", "sync")], [])
    assert shown("graph TD\nA & B --> C") == (list("ABC"), [("A", "C", "sync"), ("B", "C", "sync")], [])
    assert shown("graph TD\nendpoint --> graphql --- TDx")[0] == ["endpoint", "graphql", "TDx"]
    assert mermaid.parse("graph TD\nA -- yes please --> B").edges[0]["label"] == "yes please"


def test_shapes_subgraphs_and_errors():
    d = mermaid.parse('flowchart TD\nA[Start] --> B{Decision}\nB -->|Yes| C["Process 1"]\nsubgraph one [Title]\nD((x))\nend\nclassDef hot fill:#f00,stroke:#000;\nclass A hot\nclick A cb\n')
    assert d.errors == [] and d.nodes["B"]["type"] == "method" and d.nodes["C"]["label"] == "Process 1"
    assert d.nodes["D"]["class_name"] == "Title" and len(d.edges) == 2
    assert mermaid.parse("A --> B").errors and mermaid.parse("flowchart TD\nA -->").errors and mermaid.parse("flowchart TD\nend").errors
    assert mermaid.is_diagram("%% note\nflowchart TD") and not mermaid.is_diagram("text") and not mermaid.is_diagram("")


def test_specifications(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"entryPoint": {"file": "src/simple.ts", "function": "main"}, "requiredEdges": [{"from": "main", "to": "helper", "type": "sync"}], "requiredNodes": ["main"], "maxDepth": 5}))
    spec = specs.read_specification(str(tmp_path / "s.json"))
    assert spec.entry_point == "main" and spec.required_edges == (("main", "helper", "sync"),) and spec.max_depth == 5
    (tmp_path / "s.mmd").write_text('%% test-spec: {"name": "n", "entryPoint": "src/a.ts#main"} %%\nflowchart TD\nmain --> helper\nmain -.-> logger\n')
    spec = specs.read_specification(str(tmp_path / "s.mmd"))
    assert spec.required_edges == (("main", "helper", "sync"), ("main", "logger", "async")) and spec.required_nodes == ("main", "helper", "logger")
    for bad in ({}, {"entryPoint": {"file": "x"}}):
        with pytest.raises(AnalysisError):
            specs.specification(bad)
    with pytest.raises(AnalysisError):
        specs.read_specification("x.txt")
    (tmp_path / "c.json").write_text(json.dumps({"maxDepth": 4, "excludePatterns": ["a"]}))
    assert specs.read_config(str(tmp_path / "c.json"), max_depth=7) == AnalysisOptions(max_depth=7, exclude_patterns=("a",))
    (tmp_path / "tsconfig.json").write_text('{"include": ["./app"]}')
    assert specs.project_globs(specs.find_tsconfig(str(tmp_path)))[0] == ["app/**"]


@pytest.fixture(scope="module")
def project(spark):
    return spark.createDataFrame(list(catalog_text.SOURCES.items()), "path string, content string").persist()


def test_analysis(spark, project):
    g = api.analyze(project, "src/main.ts#main", AnalysisOptions(max_depth=4, collect_metrics=True))
    names = {r.id.split("#")[1] for r in g.nodes.collect()}
    assert {"main", "UserController.getUser", "UserService.find", "query", "UserController.constructor"} <= names and "helper" not in names
    info = g.graphs.first()
    assert info.entry_point_id == "src/main.ts#main" and info.total_nodes == len(names) == g.nodes.count()
    assert all(not lines.problems(api.format_graph(g, "src/main.ts#main", f, "reference"), f) for f in ("json", "yaml", "mermaid", "dot"))
    back = mermaid.parse(lines.mermaid_text(g, "src/main.ts#main"))
    assert not back.errors and len(back.nodes) == len(names)
    assert "subgraph" in lines.mermaid_text(g, "src/main.ts#main", clusters=True)
    for entry, code in (("src/none.ts#x", "SOURCE_FILE_NOT_FOUND"), ("src/main.ts#nobody", "ENTRY_POINT_NOT_FOUND"), ("src/main.ts", "INVALID_ENTRY_POINT_FORMAT")):
        with pytest.raises(AnalysisError) as e:
            api.analyze(project, entry)
        assert e.value.code == code


def test_discovery(project):
    names = lambda kind: {r.function_name for r in api.discover(project, kind).collect()}
    assert names("controllers") == {"getUser", "listUsers"} and names("handlers") == {"loginHandler", "routeIndex"} and names("mains") == {"main"}
    assert names("exported") == {"query", "routeIndex", "main"}
    assert api.validate_entry_point(project, "src/db.ts#query")["is_valid"] and not api.validate_entry_point(project, "src/db.ts#no")["is_valid"]
    facts = typescript.extract(project)
    assert entrypoints.discover(facts, compat=True).count() > entrypoints.discover(facts).count()
    assert entrypoints.find_files(facts, "user.service").first().path == "src/user.service.ts"


def test_check_and_batch(spark, project, tmp_path):
    spec = specs.specification({"entryPoint": "main", "requiredEdges": [{"from": "main", "to": "UserController.getUser", "type": "async"}], "forbiddenNodes": ["*legacy*"]})
    assert api.check_spec(project, spec, "src/main.ts#main")[0]
    (tmp_path / "b.json").write_text(json.dumps({"entry_points": [{"file": "src/main.ts", "function": "main", "output": "m.json"}, {"file": "src/x.ts", "function": "y", "output": "y.json"}], "common_options": {"max_depth": 3}}))
    written = {}
    out = {r.entry: r for r in api.analyze_batch(spark, project, str(tmp_path / "b.json"), written.__setitem__).collect()}
    assert out["src/main.ts#main"].success and "SOURCE_FILE_NOT_FOUND" in out["src/x.ts#y"].error and json.loads(written["m.json"])["nodes"]


def test_text_formats(spark):
    g = CallGraph.of(spark, [{"id": "a", "name": 'say "hi"', "file_path": "/p/src/x/a.ts", "line": 3, "type": "function", "is_async": True}, {"id": "b", "name": "end", "file_path": "b.ts", "line": 1, "type": "method"}, {"id": "c", "name": "end", "file_path": "b.ts", "line": 2, "type": "arrow"}], [{"src": "a", "dst": "b", "type": "async"}, {"src": "a", "dst": "b", "type": "async"}, {"src": "b", "dst": "c", "type": "callback"}])
    assert json.loads(lines.json_text(g, "g", "a", {"x": 1}))["nodes"][0]["filePath"] == "/p/src/x/a.ts"
    assert lines.mermaid_text(g, "g") == 'flowchart TD\n  say_hi["say #quot;hi#quot;"]\n  n_end[["end"]]\n  n_end_2("end")\n  say_hi -.->|2x| n_end\n  n_end ---|callback| n_end_2\n'
    assert '"a" [label="say \\"hi\\"", shape=box, tooltip="a.ts:3", style=filled];' in lines.dot_text(g, "g")
    assert 'name: "say \\"hi\\"", file: "src/x/a.ts"' in lines.yaml_text(g, "g", "a")
    assert "required_calls" in lines.specification_text(g, "g", "x#a")
    assert lines.problems("digraph { ", "dot") and lines.problems("{", "json") and not lines.problems("{\"nodes\": [], \"edges\": []}", "json")


def test_cache_and_changes(spark, project, tmp_path):
    cache = incremental.Cache(spark, f"file://{tmp_path}/cache")
    facts = incremental.analyze_incrementally(project, cache)
    assert facts.count() == typescript.extract(project).count()
    hits, todo = cache.lookup(project.selectExpr("path", "case when path like '%db%' then content || ' ' else content end as content"))
    assert todo.count() == 1 and hits.select("path").distinct().count() == len(catalog_text.SOURCES) - 1
    assert cache.stats().first().entries == len(catalog_text.SOURCES)
    (tmp_path / "p").mkdir()
    folder = incremental.FolderChanges(str(tmp_path / "p"))
    (tmp_path / "p" / "a.ts").write_text("function a() {}")
    assert [c[:2] for c in folder.poll()] == [("a.ts", "add")]
    (tmp_path / "p" / "a.ts").write_text("function b() {}")
    (tmp_path / "p" / "n.txt").write_text("no")
    assert [c[:2] for c in folder.poll()] == [("a.ts", "change")] and folder.poll() == []
    (tmp_path / "p" / "a.ts").unlink()
    change = folder.poll()
    assert [c[:2] for c in change] == [("a.ts", "unlink")]
    incremental.apply_changes(spark.createDataFrame([("src/main.ts", "unlink", 1, None), ("src/new.ts", "add", 2, "function n() {}")], incremental.CHANGES), cache)
    assert {"src/new.ts"} <= {r.path for r in cache.read().select("path").distinct().collect()} and not cache.read().filter("path = 'src/main.ts'").count()
    cache.clear()
    assert cache.read().count() == 0


def test_stream(spark):
    assert {r.path: r.facts for r in catalog_text.stream_changes(spark, "").collect()}.keys() == {"src/user.controller.ts", "src/user.service.ts", "src/login.handler.ts", "src/db.ts"}


def test_scanner_extension(spark, project):
    class Marks(typescript.Scanner):
        def visit(self, i):
            if self.word(i) == "return":
                self._emit(i, kind="return")

    assert typescript.Scanner("p", "return 1").scan() == []
    assert [f["kind"] for f in Marks("p", "return 1").scan()] == ["return"]
    assert resolve.exported_symbols(typescript.extract(project)).filter("exported = 'query'").count() == 1


def test_read_sources(spark, tmp_path):
    for p, c in catalog_text.SOURCES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.ts").write_text("x")
    found = {r.path: r.content for r in typescript.read_sources(spark, str(tmp_path), ["src/**"]).collect()}
    assert found == catalog_text.SOURCES


@pytest.mark.parametrize("name", ["jn1_edge_names", "snk3_json_simple", "snk3_json_compact", "snk5_yaml_lines", "snk9_mermaid_lines", "snk10_mermaid_clusters", "snk14_dot_lines", "snk17_saved_lines"])
def test_writers_see_the_whole_graph(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, base)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
    calls = con.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert sum(r[-1] if isinstance(r[-1], int) else 1 for r in want) > calls
