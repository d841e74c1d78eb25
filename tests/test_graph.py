"""Graph operators on literal and random graphs."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from edgeframe.functions import columns as C
from edgeframe.model import AnalysisError, AnalysisOptions, CallGraph
from edgeframe.operators import build, circular, filters, metrics, resolve, traverse, validate
from edgeframe.sinks import lines
from edgeframe.sources import typescript


def graph(spark, pairs, graph_id="g", **node_values):
    ids = list(dict.fromkeys(x for a, b, *_ in pairs for x in (a, b)))
    nodes = [{"id": i, "name": i, "file_path": f"/src/{i}.ts", "line": 1, "type": "function", "is_async": False, "is_static": False, **node_values.get(i, {})} for i in ids]
    return CallGraph.of(spark, nodes, [{"src": a, "dst": b, "type": t[0] if t else "sync"} for a, b, *t in pairs], graph_id)


def start(spark, node, graph_id="g"):
    return spark.createDataFrame([(graph_id, node)], "graph_id string, id string")


def rows(df, *columns):
    return {tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()}


DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]


@pytest.fixture(scope="module")
def diamond(spark):
    return graph(spark, DIAMOND, A={"is_async": True}, C={"is_async": True}, E={"is_async": True})


def test_diamond(spark, diamond):
    depth = {r.id: r.depth for r in traverse.bfs(diamond.edges, start(spark, "A")).collect()}
    assert depth == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 3}
    assert rows(traverse.roots(diamond.nodes, diamond.edges), "id") == {"A"}
    assert traverse.max_depth(diamond.nodes, diamond.edges).first().max_depth == 3
    assert metrics.cyclomatic(diamond.nodes, diamond.edges).first().cyclomatic == 2
    assert metrics.average_fan_of_nodes(diamond.nodes, diamond.edges).first().avg_fan == 1.0
    assert metrics.hotspots_distinct(diamond.nodes, diamond.edges).first().id == "D"
    assert metrics.totals(diamond.nodes, diamond.edges).first().async_nodes == 3
    assert {r.id: r.level for r in traverse.longest_paths(diamond.nodes, diamond.edges).collect()} == {"A": 1, "B": 2, "C": 2, "D": 3, "E": 4}
    assert traverse.trimmed(diamond.edges).count() == 0


def test_traversal_orders_and_bounds(spark):
    g = graph(spark, [("A", "B"), ("B", "C"), ("A", "D")])
    assert [r.id for r in traverse.dfs_order(g.edges, start(spark, "A")).orderBy("dfs_ord").collect()] == ["A", "B", "C", "D"]
    several = start(spark, "B").unionByName(start(spark, "A")).unionByName(start(spark, "Z")).unionByName(start(spark, "alone", "h"))
    assert rows(traverse.dfs_order(g.edges, several), "graph_id", "id", "dfs_ord", "depth") == {("g", "A", 0, 0), ("g", "B", 1, 1), ("g", "C", 2, 2), ("g", "D", 3, 1), ("g", "Z", 4, 0), ("h", "alone", 0, 0)}
    assert rows(traverse.bfs(g.edges, start(spark, "A"), 1), "id") == {"A", "B", "D"}
    reached, edges = traverse.bounded_expansion(g.edges, start(spark, "A"), 2)
    assert rows(reached, "id") == {"A", "B", "D"} and edges.count() == 3  # the edge to C dangles
    assert traverse.bounded_expansion(g.edges, start(spark, "A"), 0)[0].count() == 0
    nodes, inside = traverse.subgraph(g.nodes, g.edges, start(spark, "A"), 1)
    assert rows(nodes, "id") == {"A", "B", "D"} and rows(inside, "src", "dst") == {("A", "B"), ("A", "D")}
    assert rows(traverse.bfs(g.edges, start(spark, "nobody")), "id") == {"nobody"}


def test_long_chain_is_followed(spark):
    g = graph(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)])
    assert traverse.bfs(g.edges, start(spark, "n00")).count() == 21


def test_cycles(spark):
    ring = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert rows(traverse.cyclic_nodes(ring.edges), "id") == {"a", "b", "c"}
    assert [r.path for r in traverse.back_edge_cycles(ring.edges).collect()] == [["a", "b", "c", "a"]]
    assert circular.omit(ring.edges).count() == 0 and circular.omit_closing(ring.edges).count() == 2
    assert circular.reference(ring.edges).filter("circular").count() == 3
    assert circular.inline_once(ring.edges).first().cycles == [["a", "b", "c", "a"]]
    assert traverse.roots(ring.nodes, ring.edges).count() == 3
    two = graph(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "z")])
    assert rows(traverse.two_cycles(two.edges), "a", "b") == {("a", "b"), ("x", "y")} and rows(traverse.self_loops(two.edges), "id") == {"z"}
    with pytest.raises(ValueError):
        circular.rewrite(ring.edges, "other")


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(rng.randint(10, 24))]
    g, near = graph(spark, pairs), defaultdict(set)
    for a, b in pairs:
        near[a].add(b)

    def reach(x):
        seen, todo = set(), list(near[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += near[y]
        return seen

    ids = {x for p in pairs for x in p}
    closed = {x: reach(x) for x in ids}
    strong = {(x, max(y for y in ids if x in closed[y] and y in closed[x])) for x in ids if x in closed[x]}
    assert rows(traverse.cyclic_nodes(g.edges), "id") == {x for x, _ in strong}
    found = rows(traverse.strong_components(g.edges), "id", "component")
    assert {f for f in found if f[0] in {x for x, _ in strong}} == strong
    low = {x: x for x in ids}
    for _ in ids:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert rows(traverse.weak_components(g.nodes, g.edges), "id", "component") == set(low.items())
    first = min(ids)
    depth, todo = {first: 0}, [first]
    for x in todo:
        for y in near[x] - depth.keys():
            depth[y] = depth[x] + 1
            todo.append(y)
    assert rows(traverse.bfs(g.edges, start(spark, first)), "id", "depth") == set(depth.items())


def test_call_tree_and_sequence(spark):
    g = graph(spark, [("m", "a"), ("a", "m"), ("m", "b")])
    assert rows(traverse.call_tree(g.edges, start(spark, "m")), "path", "circular") == {("m", False), ("m>a", False), ("m>a>m", True), ("m>b", False)}
    assert [(r.src, r.dst) for r in traverse.sequence_steps(g.edges, start(spark, "m")).orderBy("step").collect()] == [("m", "a"), ("a", "m"), ("m", "b")]


def test_build(spark, diamond):
    doubled = CallGraph(diamond.nodes.unionByName(diamond.nodes), diamond.edges.unionByName(diamond.edges))
    assert build.dedup_nodes(doubled.nodes).count() == 5 and build.dedup_edges(doubled.edges).count() == 5
    with pytest.raises(AnalysisError):
        build.checked(CallGraph(diamond.nodes.selectExpr("graph_id", "id", "null as name", "file_path", "line"), diamond.edges))
    strange = CallGraph(diamond.nodes.filter("id <> 'E'"), diamond.edges)
    assert rows(build.placeholders(strange.nodes, strange.edges), "id", "name") == {("E", "placeholder")}
    assert build.with_placeholders(strange).nodes.count() == 5
    assert build.inner_edges(strange.nodes, strange.edges).count() == 4
    merged = build.merge_results([diamond, graph(spark, [("E", "B")])])
    assert merged.nodes.count() == 5 and merged.edges.count() == 6
    assert build.with_metadata(build.summary(diamond), entry_point="A", max_depth=None).first().entry_point == "A"


def test_filters(spark, diamond):
    assert C.glob_regex("src/**/*.ts") == r"^src/(?:.*/)?[^/]*\.ts$"
    paths = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x/b.ts", "src/b.test.ts", "node_modules/m.ts", "a/test/c.ts", "lib/a.d.ts")], "file_path string")
    assert rows(filters.match_globs(paths, ["src/**/*.ts"], ["**/*.test.ts"]), "file_path") == {"src/a.ts", "src/x/b.ts"}
    assert rows(filters.filter_files(paths, AnalysisOptions()), "file_path") == {"src/a.ts", "src/x/b.ts", "lib/a.d.ts"}
    assert rows(filters.drop_external(paths), "file_path") == {"src/a.ts", "src/x/b.ts", "src/b.test.ts", "a/test/c.ts"}
    assert filters.search(diamond.nodes, "name", "a").count() == 1
    assert rows(paths.select(C.short_path(paths.file_path).alias("p")), "p") == {"src/a.ts", "src/x/b.ts", "src/b.test.ts", "node_modules/m.ts", "test/c.ts", "lib/a.d.ts"}


def sample(spark):
    nodes = [{"id": f"s.ts#{n}", "name": n, "file_path": "s.ts", "line": 1, "type": "function", **x} for n, x in (("main", {}), ("processData", {}), ("validateInput", {"type": "method", "class_name": "ValidationService"}))]
    return CallGraph.of(spark, nodes, [{"src": "s.ts#main", "dst": "s.ts#processData", "type": "sync"}, {"src": "s.ts#processData", "dst": "s.ts#validateInput", "type": "async"}])


SPEC = validate.Specification("main", (("main", "processData", "sync"), ("process*", "ValidationService.*", "async")), (("validateInput", "main", "sync"),), ("main", "processData", "validateInput"), ("deprecated*",), 5, 10)


def test_validation(spark):
    g, entry = sample(spark), start(spark, "s.ts#main")
    assert validate.summary(g, SPEC, entry).first().is_valid
    less = CallGraph(g.nodes, g.edges.filter("type = 'sync'"))
    assert rows(validate.violations(less, SPEC, entry), "kind") == {"missing_edge"}
    worse = CallGraph(g.nodes, g.edges.unionByName(g.edges.filter("type = 'sync'").selectExpr("graph_id", "9L as ord", "'x' as id", "'s.ts#validateInput' as src", "'s.ts#main' as dst", "type", "line", "column", "argument_types", "conditional")))
    assert rows(validate.violations(worse, SPEC, entry), "kind", "phase") == {("forbidden_edge", 3)}
    assert "failed" in validate.report(worse, SPEC, "g", entry)
    assert rows(validate.entry_point(g, start(spark, "nobody"), SPEC), "kind") == {"missing_node"}
    assert validate.violations(g, validate.Specification()).count() == 0
    wide = validate.Specification(forbidden_nodes=("*Input", "s.ts#v*", "main"))
    assert rows(validate.violations(g, wide), "rule_ord", "message") == {(0, "s.ts#validateInput"), (1, "s.ts#validateInput"), (2, "s.ts#main")}
    assert "NestedLoop" not in validate.violations(g, SPEC)._jdf.queryExecution().executedPlan().toString()
    basic = validate.Specification.basic("main")
    assert validate.summary(g, basic).first().is_valid
    assert rows(validate.difference(g, basic), "kind", "item") == {("found", "main"), ("additional", "s.ts#processData"), ("additional", "s.ts#validateInput")}
    assert validate.limits(g, validate.Specification("main", max_depth=1, max_complexity=0), traverse.max_depth(g.nodes, g.edges)).count() == 2
    assert validate.limits(g, validate.Specification("main"), traverse.max_depth(g.nodes, g.edges)).count() == 0


def test_metrics_bundle(spark):
    g = graph(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "E")])
    out = metrics.bundle(g.nodes, g.edges, spark.createDataFrame([("g", 1)], "graph_id string, n long"), top=2)
    row = out.first()
    assert (row.functions, row.calls, row.cyclomatic, row.cognitive) == (5, 6, 3, 3)
    assert [(h.id, h.n) for h in row.hotspots] == [("D", 2), ("E", 2)]
    line = lines.statistics_lines(out, "json").first().line
    assert json.loads("{" + line + "}")["statistics"]["hotspots"] == [{"id": "D", "n": 2}, {"id": "E", "n": 2}]
    text = [r.line for r in lines.statistics_lines(out, "yaml").orderBy("line_no").collect()]
    assert text[:2] == ["statistics:", "  functions: 5"] and text[-1] == '    - {id: "E", calls: 2}'


def test_long_re_exports(spark):
    """A name passed on by more files than any fixed number of rounds."""
    files = [("f0.ts", "export function deep() { return 1; }\n")] + [(f"f{k}.ts", f"export {{ deep }} from './f{k - 1}';\n") for k in range(1, 14)]
    facts = typescript.extract(spark.createDataFrame(files, "path string, content string"))
    assert resolve.exported_symbols(facts).filter("path = 'f13.ts'").select("def_path", "def_name").collect() == [("f0.ts", "deep")]
