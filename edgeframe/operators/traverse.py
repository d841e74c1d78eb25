"""Traversal, reachability, components and cycles.

Two engines.  Set-based operators loop over joins, keyed by ``graph_id`` so
that many graphs and many starts take one run; a round joins only the frontier.
Operators whose result depends on visiting order run per graph in
``applyInPandas``; they are for batches of graphs that each fit a task.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.operators.build import adjacency
from edgeframe.scratch import written


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(*keys, id, depth): shortest depth of everything reachable from ``starts`` (*keys, id).

    ``max_depth`` is inclusive.  Extra keys (a root, an entry) make it
    multi-source.  Each round joins the last frontier with the distinct
    adjacency and drops what was reached; rounds are written out, so the plan
    of round n does not hold those before it.
    """
    keys = list(keys)
    # dealt by what every round joins on, so that only the frontier moves
    adj = adjacency(edges).select("graph_id", F.col("src").alias("id"), "dst").repartition("graph_id", "id").persist()
    frontier = written(starts.select(*keys, "id").distinct().withColumn("depth", F.lit(0)), "bfs")
    rounds, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = rounds[0]
        for r in rounds[1:]:
            reached = reached.unionByName(r)
        step = frontier.join(adj, ["graph_id", "id"]).select(*keys, F.col("dst").alias("id")).distinct()
        frontier = written(step.join(reached.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        if len(rounds) == 16:  # long chains: keep the union short
            rounds = [written(reached.unionByName(frontier), "bfs")]
    adj.unpersist()
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def bounded_expansion(edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """(reached, edges): nodes at depth < ``max_depth`` and the edges out of them.

    The bound is exclusive; edges of the last layer may end outside (quirk
    Q4).  Depth is the shortest one, not the order of visits (quirk Q5).
    """
    if max_depth <= 0:  # quirk Q31: nothing, not even the start
        none = starts.select("graph_id", "id").withColumn("depth", F.lit(0)).limit(0)
        return none, edges.limit(0)
    reached = bfs(edges, starts, max_depth - 1)
    own = reached.select("graph_id", F.col("id").alias("src"))
    return reached, edges.join(own, ["graph_id", "src"], "left_semi").select(*edges.columns)


def subgraph(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph of what is reachable within the (inclusive) depth (quirk Q6)."""
    ids = bfs(edges, starts, max_depth).select("graph_id", "id")
    kept = nodes.join(ids, ["graph_id", "id"], "left_semi").select(*nodes.columns)
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(kept.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_semi").select(*edges.columns)
    return kept, inside


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id) of nodes without incoming edges; all nodes of a graph that has none."""
    called = edges.select("graph_id", F.col("dst").alias("id"), F.lit(1).alias("hit")).distinct()
    marked = nodes.select("graph_id", "id").join(called, ["graph_id", "id"], "left")
    rootless = marked.groupBy("graph_id").agg(F.count_if(F.col("hit").isNull()).alias("n")).filter("n = 0").select("graph_id", F.lit(True).alias("all"))
    return marked.join(rootless, "graph_id", "left").filter("hit is null or `all`").select("graph_id", "id")


def depth_distribution(reached: DataFrame) -> DataFrame:
    return reached.groupBy("graph_id", "depth").agg(F.count("*").alias("nodes"))


def max_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, max_depth): the greatest shortest depth from any root (quirk Q7)."""
    start = roots(nodes, edges).select("graph_id", F.col("id").alias("root"), "id")
    return bfs(edges, start, keys=("graph_id", "root")).groupBy("graph_id").agg(F.max("depth").alias("max_depth"))


def average_in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, avg_in_degree); the reference quantity is misnamed a depth (quirk Q11)."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", (F.coalesce("e", F.lit(0)) / F.col("n")).alias("avg_in_degree"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, component): the smallest id of each weakly connected component.

    Alternating large-star and small-star steps: rounds grow with the logarithm
    of the diameter, not with it.
    """
    key = ["graph_id", "a"]
    now = adjacency(edges).filter("src <> dst").select("graph_id", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    now = written(now, "cc")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("graph_id", "a", "b").cast("decimal(38,0)"))).first())

    before, seen = None, mark(now)
    while seen != before and seen[0]:
        both = now.unionByName(now.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(key).agg(F.min("b").alias("m")).select(*key, F.least("a", "m").alias("m"))
        large = both.join(low, key).filter("b > a").select("graph_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(key).agg(F.min("b").alias("m"))
        small = large.join(down, key).filter("b <> m").select("graph_id", F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(down.withColumnRenamed("m", "b")).distinct(), "cc")
        before, seen = seen, mark(now)
    return nodes.select("graph_id", "id").join(now.select("graph_id", F.col("a").alias("id"), "b"), ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("b", "id").alias("component"))


def self_loops(edges: DataFrame) -> DataFrame:
    return adjacency(edges).filter("src = dst").select("graph_id", F.col("src").alias("id"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b), a < b, with edges both ways."""
    adj = adjacency(edges)
    back = adj.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return adj.filter("src < dst").join(back, ["graph_id", "src", "dst"], "left_semi").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Adjacency without nodes that have no way in or no way out, again and again.

    Every cycle stays; a layered acyclic graph becomes empty in as many rounds as it has layers.
    """
    now = written(adjacency(edges), "trim")
    count = now.count()
    while count:
        kept = now.join(now.select("graph_id", F.col("dst").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
        kept = kept.join(now.select("graph_id", F.col("src").alias("dst")).distinct(), ["graph_id", "dst"], "left_semi")
        now = written(kept.select("graph_id", "src", "dst"), "trim")
        before, count = count, now.count()
        if count == before:
            break
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(graph_id, id, component) of nodes on cycles: the greatest id of each strong component.

    Trim; colour every node with the greatest id that reaches it; what reaches
    a colour's own node inside the colour is one component; repeat on the rest.
    """
    rest = trimmed(edges)
    found = None
    while not rest.isEmpty():
        colour = written(rest.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")), "scc")
        moved = True
        while moved:
            sent = rest.join(colour.select("graph_id", F.col("id").alias("src"), "c"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id"), "c")
            after = written(colour.unionByName(sent).groupBy("graph_id", "id").agg(F.max("c").alias("c")), "scc")
            moved = not after.join(colour, ["graph_id", "id", "c"], "left_anti").isEmpty()
            colour = after
        same = rest.join(colour.select("graph_id", F.col("id").alias("src"), F.col("c").alias("cs")), ["graph_id", "src"]).join(colour.select("graph_id", F.col("id").alias("dst"), F.col("c").alias("cd")), ["graph_id", "dst"]).filter("cs = cd")
        back = written(same.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        own = bfs(back, colour.filter("id = c").select("graph_id", "id")).select("graph_id", "id").join(colour, ["graph_id", "id"])
        own = written(own.select("graph_id", "id", F.col("c").alias("component")), "scc")
        found = own if found is None else found.unionByName(own)
        for end in ("src", "dst"):
            rest = rest.join(own.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_anti")
        rest = trimmed(rest)
    return found if found is not None else rest.select("graph_id", F.col("src").alias("id"), F.col("src").alias("component"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges inside a strong component (with self-loops)."""
    c = strong_components(edges)
    side = lambda end: c.select("graph_id", F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    return adjacency(edges).join(side("src"), ["graph_id", "src"]).join(side("dst"), ["graph_id", "dst"]).filter("c_src = c_dst").select("graph_id", "src", "dst")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(graph_id, id) of nodes on some cycle: in a component with an edge inside."""
    inside = cyclic_edges(edges)
    return inside.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


def longest_paths(nodes: DataFrame, edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(graph_id, id, level): nodes on the longest way from a root, counted from 1.

    For acyclic graphs, whose ways have as many nodes as the largest graph at
    most; on a cycle that number, or ``bound``, ends it.  A round is a layer.
    """
    if bound is None:
        bound = nodes.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    adj = adjacency(edges).persist()
    level = written(roots(nodes, edges).withColumn("level", F.lit(1)), "longest")
    best = level
    for n in range(2, bound + 1):
        level = written(level.join(adj.withColumnRenamed("src", "id"), ["graph_id", "id"]).select("graph_id", F.col("dst").alias("id")).distinct().withColumn("level", F.lit(n)), "longest")
        if level.isEmpty():
            break
        best = best.unionByName(level) if n % 16 else written(best.unionByName(level).groupBy("graph_id", "id").agg(F.max("level").alias("level")), "longest")
    adj.unpersist()
    return best.groupBy("graph_id", "id").agg(F.max("level").alias("level"))


def call_tree(edges: DataFrame, starts: DataFrame, bound: int = 10) -> DataFrame:
    """(graph_id, path, id, depth, circular): every way from the start, as rows.

    A node already on its path, or deeper than ``bound``, is a leaf marked
    circular.  Ways are enumerated, so this is for graphs that are meant to be
    printed.
    """
    adj = adjacency(edges).withColumnRenamed("src", "id").persist()
    level = written(starts.select("graph_id", "id", F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("circular")), "tree")
    out = level
    for depth in range(1, bound + 2):
        step = level.filter("not circular").join(adj, ["graph_id", "id"])
        again = F.array_contains("path", F.col("dst")) | F.lit(depth > bound)
        level = written(step.select("graph_id", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.lit(depth).alias("depth"), again.alias("circular")), "tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    adj.unpersist()
    return out.select("graph_id", F.array_join("path", ">").alias("path"), "id", "depth", "circular")


# --- order-dependent operators: one task a graph -------------------------------------------------


def _ordered(pdf: pd.DataFrame) -> dict[str, list[str]]:
    """Distinct successors in the order of first appearance."""
    out: dict[str, dict[str, None]] = defaultdict(dict)
    for src, dst in pdf.sort_values("ord", kind="stable")[["src", "dst"]].itertuples(index=False):
        out[src].setdefault(dst)
    return {k: list(v) for k, v in out.items()}


def dfs_order(edges: DataFrame, starts: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """(graph_id, id, dfs_ord, depth): preorder from the starts, neighbours in order of appearance.

    Several starts of a graph are walked one after the other by id, each over
    what is left; a start without edges is a row of its own.
    """

    def walk(key: tuple, calls: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        near, seen, out = _ordered(calls), set(), []
        stack = [(node, 0) for node in sorted(set(begin["id"]), reverse=True)]
        while stack:
            node, depth = stack.pop()
            if node in seen or depth > bound:
                continue
            seen.add(node)
            out.append((key[0], node, len(out), depth))
            stack.extend((n, depth + 1) for n in reversed(near.get(node, [])))
        return pd.DataFrame(out, columns=["graph_id", "id", "dfs_ord", "depth"])

    calls, begin = edges.select("graph_id", "ord", "src", "dst").groupBy("graph_id"), starts.select(F.col("graph_id").alias("graph"), "id").groupBy("graph")
    return calls.cogroup(begin).applyInPandas(walk, "graph_id string, id string, dfs_ord long, depth long")


def back_edge_cycles(edges: DataFrame) -> DataFrame:
    """(graph_id, cycle_no, path): for each edge back to the current way, the way it closes."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near, seen, out = _ordered(pdf), set(), []
        for start in dict.fromkeys(pdf.sort_values("ord", kind="stable")[["src", "dst"]].to_numpy().ravel()):
            if start in seen:
                continue
            way, at, stack = [start], {start: 0}, [iter(near.get(start, []))]
            seen.add(start)
            while stack:
                for node in stack[-1]:
                    if node in at:
                        out.append((pdf["graph_id"].iloc[0], len(out), [*way[at[node] :], node]))
                    elif node not in seen:
                        seen.add(node)
                        at[node] = len(way)
                        way.append(node)
                        stack.append(iter(near.get(node, [])))
                        break
                else:
                    stack.pop()
                    at.pop(way.pop())
        return pd.DataFrame(out, columns=["graph_id", "cycle_no", "path"])

    schema = T.StructType.fromDDL("graph_id string, cycle_no long, path array<string>")
    return edges.select("graph_id", "ord", "src", "dst").groupBy("graph_id").applyInPandas(walk, schema)


def sequence_steps(edges: DataFrame, starts: DataFrame, bound: int = 5) -> DataFrame:
    """(graph_id, step, src, dst, type): calls in depth-first order, each edge once, to a depth."""
    rows = edges.join(starts.select("graph_id", F.col("id").alias("start")), "graph_id").select("graph_id", "ord", "src", "dst", "type", "start")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used, calls = [], set(), defaultdict(list)
        for k, (src, dst, kind) in enumerate(pdf.sort_values("ord", kind="stable")[["src", "dst", "type"]].itertuples(index=False)):
            calls[src].append((k, dst, kind))
        stack = [(iter(calls[pdf["start"].iloc[0]]), pdf["start"].iloc[0], 0)]
        while stack:
            for k, dst, kind in stack[-1][0]:
                if k in used:
                    continue
                used.add(k)
                out.append((pdf["graph_id"].iloc[0], len(out) + 1, stack[-1][1], dst, kind))
                if stack[-1][2] < bound:
                    stack.append((iter(calls[dst]), dst, stack[-1][2] + 1))
                    break
            else:
                stack.pop()
        return pd.DataFrame(out, columns=["graph_id", "step", "src", "dst", "type"])

    return rows.groupBy("graph_id").applyInPandas(walk, "graph_id string, step long, src string, dst string, type string")
