"""The public operations: analyse, discover, validate, check, batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.model import AnalysisError, AnalysisOptions, CallGraph
from edgeframe.operators import build, circular, entrypoints, filters, metrics, resolve, traverse, validate
from edgeframe.sinks import lines
from edgeframe.sources.specs import BatchEntry, read_batch, read_specification
from edgeframe.sources.typescript import Scanner, extract


def analyze(files: DataFrame, entry: str, options: AnalysisOptions | None = None, scanner: type[Scanner] = Scanner) -> CallGraph:
    """The call graph from one entry point of sources (path, content).

    Raises an :class:`AnalysisError` with the code SOURCE_FILE_NOT_FOUND,
    ENTRY_POINT_NOT_FOUND or INVALID_ENTRY_POINT_FORMAT.
    """
    return _expand(extract(_included(files, options or AnalysisOptions()), scanner).persist(), entry, options or AnalysisOptions(), entry)


def _included(files: DataFrame, options: AnalysisOptions) -> DataFrame:
    return files.filter(filters.file_predicate(F.col("path"), options))


def _expand(facts: DataFrame, entry: str, options: AnalysisOptions, graph_id: str) -> CallGraph:
    began = time.time()
    file, _, _ = entrypoints.parse_entry(entry)
    if entrypoints.find_files(facts, file).isEmpty():
        raise AnalysisError(f"no source file {file}", "SOURCE_FILE_NOT_FOUND", file)
    start = entrypoints.find_entry(facts, entry).first()
    if start is None:
        raise AnalysisError(f"no entry point {entry}", "ENTRY_POINT_NOT_FOUND", file)
    spark = facts.sparkSession
    whole = CallGraph(resolve.function_nodes(facts, graph_id), resolve.call_edges(facts, options.follow_imports, callbacks=options.analyze_callbacks, graph_id=graph_id))
    seed = spark.createDataFrame([(graph_id, start.id)], "graph_id string, id string")
    reached, edges = traverse.bounded_expansion(whole.edges, seed, options.max_depth)
    nodes = whole.nodes.join(reached.select("graph_id", "id"), ["graph_id", "id"], "left_semi").select(*whole.nodes.columns)
    graph = CallGraph(nodes, edges)
    if not options.collect_metrics:
        return CallGraph(nodes, edges, build.summary(graph, entry, options.max_depth).withColumn("entry_point_id", F.lit(start.id)))
    counted = metrics.totals(nodes, edges).drop("total_nodes").join(traverse.average_in_degree(nodes, edges), "graph_id")
    info = build.summary(graph, entry, options.max_depth).join(counted, "graph_id").withColumn("entry_point_id", F.lit(start.id)).withColumn("analysis_time_ms", F.lit(int((time.time() - began) * 1000)))
    return CallGraph(nodes, edges, info)


def discover(files: DataFrame, kind: str = "all", pattern: str | None = None) -> DataFrame:
    """Entry points by path pattern, by kind (controllers, handlers, mains, exported) or all."""
    facts = extract(files)
    if pattern:
        return entrypoints.discover_by_path(facts, (pattern,))
    return {"all": entrypoints.discover, "controllers": entrypoints.controllers, "handlers": entrypoints.handlers, "mains": entrypoints.mains, "exported": entrypoints.exported, "common": entrypoints.common_patterns}[kind](facts)


def validate_entry_point(files: DataFrame, entry: str) -> dict:
    return entrypoints.validate_entry(extract(files), entry)


def check_spec(files: DataFrame, spec: validate.Specification | str, entry: str, options: AnalysisOptions | None = None) -> tuple[bool, str]:
    """(valid, report) of the graph from an entry point against a specification or its file."""
    spec = read_specification(spec) if isinstance(spec, str) else spec
    graph = analyze(files, entry, options)
    start = graph.graphs.select("graph_id", F.col("entry_point_id").alias("id"))
    valid = validate.summary(graph, spec, start).first()
    return bool(valid and valid.is_valid), validate.report(graph, spec, entry, start)


def format_graph(graph: CallGraph, graph_id: str, fmt: str = "json", circular_strategy: str | None = None, **options) -> str:
    """One graph as text, after the rewrite of circular references."""
    if circular_strategy:
        graph = CallGraph(graph.nodes, circular.rewrite(graph.edges, circular_strategy, closing_only=fmt == "mermaid"), graph.graphs)
    if fmt not in lines.TEXT:
        raise AnalysisError(f"unknown format {fmt}", "UNSUPPORTED_FORMAT")
    return lines.TEXT[fmt](graph, graph_id, **options)


def analyze_batch(spark: SparkSession, files: DataFrame, batch: str | list[BatchEntry], write: Callable[[str, str], None] | None = None, continue_on_error: bool = True) -> DataFrame:
    """All entries of a batch over one extraction; (entry, success, millis, nodes, edges, error) a row.

    ``write(path, text)`` gets each formatted graph; by default nothing is written.
    """
    entries, rows = read_batch(batch) if isinstance(batch, str) else batch, []
    facts = extract(files).persist()
    for e in entries:
        began = time.time()
        try:
            included = facts.filter(filters.file_predicate(F.col("path"), e.options))
            graph = _expand(included, e.entry, e.options, e.entry)
            if write:
                write(e.output, format_graph(graph, e.entry, e.format))
            rows.append((e.entry, True, int((time.time() - began) * 1000), graph.nodes.count(), graph.edges.count(), None))
        except AnalysisError as error:
            if not continue_on_error:
                raise
            rows.append((e.entry, False, int((time.time() - began) * 1000), 0, 0, f"{error.code}: {error}"))
    facts.unpersist()
    return spark.createDataFrame(rows, "entry string, success boolean, millis long, nodes long, edges long, error string")
