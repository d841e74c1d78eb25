"""From scanned facts to a call graph: names are resolved by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeframe.model import CallGraph
from edgeframe.scratch import written

FUNCTIONS = ("function", "arrow", "method", "constructor", "getter", "setter")


def function_nodes(facts: DataFrame, graph_id: str = "project") -> DataFrame:
    """The nodes of all functions, accessors included (quirk Q32)."""
    kind = F.when(F.col("kind").isin("getter", "setter"), "accessor").otherwise(F.col("kind"))
    return facts.filter(F.col("kind").isin(*FUNCTIONS)).select(
        F.lit(graph_id).alias("graph_id"), "ord", "id", "name", F.col("path").alias("file_path"), "line", "column", kind.alias("type"), F.coalesce("is_async", F.lit(False)).alias("is_async"),
        F.coalesce("is_static", F.lit(False)).alias("is_static"), "visibility", "parameters", F.coalesce("return_type", F.lit("unknown")).alias("return_type"), "class_name",
    )


def exported_symbols(facts: DataFrame) -> DataFrame:
    """(path, exported, def_path, def_name): where each exported name is declared.

    Re-exports are followed until nothing new is found, a hop a round.
    """
    declared = facts.filter(F.col("kind").isin("function", "arrow", "class") & (F.col("exported") | F.col("is_default"))).select("path", F.when(F.col("is_default"), "default").otherwise(F.col("name")).alias("exported"), F.col("path").alias("def_path"), F.col("name").alias("def_name"))
    listed = facts.filter((F.col("kind") == "export") & F.col("target").isNull()).select("path", F.col("name").alias("exported"), F.col("path").alias("def_path"), F.col("member").alias("def_name"))
    known = declared.unionByName(listed).distinct()
    again = _to_files(facts.filter((F.col("kind") == "export") & F.col("target").isNotNull()), facts).select(F.col("path").alias("from_path"), F.col("name").alias("as_name"), "member", "target_path")
    count = known.count()
    while True:
        hop = again.join(known, (F.col("target_path") == F.col("path")) & ((F.col("member") == F.col("exported")) | ((F.col("member") == "*") & (F.col("exported") != "default"))))
        more = hop.select(F.col("from_path").alias("path"), F.when(F.col("as_name") == "*", F.col("exported")).otherwise(F.col("as_name")).alias("exported"), "def_path", "def_name")
        # written, as the plan would grow by each hop
        known = written(known.unionByName(more).distinct(), "exports")
        before, count = count, known.count()
        if count == before:
            break
    return known


def _to_files(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with ``target_path``, the first existing file of a module's candidates."""
    files = facts.select(F.col("path").alias("target_path")).distinct()
    ends = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("target", F.lit(e)).alias("target_path")) for i, e in enumerate((".ts", ".tsx", "/index.ts", "/index.tsx", ""))))
    tried = rows.withColumn("c", F.explode(ends)).select("*", "c.rank", "c.target_path").drop("c").join(files, "target_path", "left_semi")
    best = tried.groupBy("path", "target").agg(F.min_by("target_path", "rank").alias("target_path"))
    return rows.join(best, ["path", "target"])


def imported_symbols(facts: DataFrame) -> DataFrame:
    """(path, local, def_path, def_name) of named and default imports, through re-exports."""
    found = _to_files(facts.filter((F.col("kind") == "import") & F.col("target").isNotNull()), facts).select("path", F.col("name").alias("local"), "member", "target_path")
    exports = exported_symbols(facts).select(F.col("path").alias("target_path"), F.col("exported").alias("member"), "def_path", "def_name")
    return found.join(exports, ["target_path", "member"]).select("path", "local", "def_path", "def_name")


def call_edges(facts: DataFrame, follow_imports: bool = True, attribution: str = "all", callbacks: bool = True, graph_id: str = "project") -> DataFrame:
    """Edges between functions.

    ``attribution``: ``all`` gives a call to every function around it, as
    nested callbacks count for their outer functions too (quirk Q2),
    ``innermost`` to the nearest.  Calls whose target cannot be told are left
    out.  ``new`` makes constructor edges (quirk Q3).  Without
    ``follow_imports`` imported names stay unresolved (quirk Q1).
    """
    functions = facts.filter(F.col("kind").isin(*FUNCTIONS))
    classes = facts.filter("kind = 'class'").select(F.col("path").alias("def_path"), F.col("name").alias("def_name"))
    local = functions.filter("class_name is null and (top_level or name <> 'anonymous')").groupBy("path", F.col("name").alias("local")).agg(F.min_by(F.struct(F.col("path").alias("def_path"), F.col("name").alias("def_name")), "ord").alias("d")).select("path", "local", "d.*")
    local = local.unionByName(classes.select(F.col("def_path").alias("path"), F.col("def_name").alias("local"), "def_path", "def_name"))
    names = local.withColumn("rank", F.lit(0))
    if follow_imports:
        names = names.unionByName(imported_symbols(facts).withColumn("rank", F.lit(1)))
    names = names.groupBy("path", "local").agg(F.min_by(F.struct("def_path", "def_name"), F.struct("rank", "def_path", "def_name")).alias("d")).select("path", "local", "d.*")

    calls = facts.filter(F.col("kind").isin("call", "new"))
    bindings = facts.filter("kind = 'binding'").groupBy("path", F.col("name").alias("receiver"), F.coalesce("class_name", F.lit("")).alias("within")).agg(F.min_by("target", "ord").alias("bound"))
    in_class = F.when(F.col("receiver").startswith("this."), F.coalesce("class_name", F.lit(""))).otherwise("")
    calls = calls.withColumn("within", in_class).join(bindings, ["path", "receiver", "within"], "left")
    # what a call's type or function is called in its own file
    local_name = F.when(F.col("callee") == "identifier", F.col("member")).when(F.col("receiver") == "this", F.col("class_name")).otherwise(F.coalesce("bound", F.col("receiver")))
    named = calls.withColumn("local", local_name).join(names, ["path", "local"], "left")
    member_of = F.when(F.col("kind") == "new", F.concat("def_path", F.lit("#"), "def_name", F.lit(".constructor"))).when(F.col("callee") == "identifier", F.concat("def_path", F.lit("#"), "def_name")).otherwise(F.concat("def_path", F.lit("#"), "def_name", F.lit("."), "member"))
    known = functions.select(F.col("id").alias("dst"), F.col("is_async").alias("target_async"), F.col("return_type").alias("target_type")).dropDuplicates(["dst"])
    # local functions that are not at the top level go by their place
    placed = functions.filter("class_name is null and not top_level").select("path", F.col("name").alias("member"), F.col("id").alias("place")).groupBy("path", "member").agg(F.min("place").alias("place"))
    solved = named.withColumn("wanted", member_of).join(placed, ["path", "member"], "left")
    direct = solved.withColumn("dst", F.col("wanted")).join(known, "dst", "left")
    inner = (F.col("callee") == "identifier") & F.col("target_async").isNull() & F.col("place").isNotNull()
    new_class = (F.col("kind") == "new") & F.col("def_name").isNotNull()
    direct = direct.withColumn("dst", F.when(inner, F.col("place")).when(F.col("target_async").isNotNull() | new_class, F.col("dst"))).filter("dst is not null")

    around = F.col("owners") if attribution == "all" else F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(F.array().cast("array<string>"))
    kind = (
        F.when(F.col("kind") == "new", "constructor")
        .when(F.col("awaited") | F.coalesce("target_async", F.lit(False)) | F.coalesce(F.col("target_type").contains("Promise"), F.lit(False)), "async")
        .when(F.col("argument"), "callback")
        .otherwise("sync")
    )
    out = direct.withColumn("src", F.explode(around)).select("src", "dst", kind.alias("type"), "line", "column", "argument_types", "conditional", "path", "ord")
    if callbacks:
        nested = functions.filter("name = 'anonymous'").withColumn("src", F.explode(around)).select("src", F.col("id").alias("dst"), F.lit("callback").alias("type"), "line", "column", F.lit(None).cast("array<string>").alias("argument_types"), F.lit(False).alias("conditional"), "path", "ord")
        out = out.unionByName(nested)
    return out.select(F.lit(graph_id).alias("graph_id"), "ord", F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit("-"), F.col("ord").cast("string")).alias("id"), "src", "dst", "type", "line", "column", "argument_types", "conditional")


def source_graph(facts: DataFrame, **options) -> CallGraph:
    """The call graph of scanned files."""
    return CallGraph(function_nodes(facts), call_edges(facts, **options))
