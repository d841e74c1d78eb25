"""The data model: a graph is two DataFrames keyed by ``graph_id``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PARAMETER = "struct<name:string,type:string,optional:boolean,default_value:string>"

#: Schemas in DDL: a schema object would need a session as soon as the module loads.
NODES = (
    "graph_id string, ord long, id string, name string, file_path string, line int, column int, type string, is_async boolean, "
    f"is_static boolean, visibility string, parameters array<{PARAMETER}>, return_type string, class_name string"
)
EDGES = (
    "graph_id string, ord long, id string, src string, dst string, type string, line int, column int, argument_types array<string>, conditional boolean"
)
GRAPHS = (
    "graph_id string, entry_point string, entry_point_id string, max_depth int, project_root string, tsconfig_path string, total_files long, analysis_time_ms long, generated_at timestamp, "
    "performance struct<analysis_time:double,total_nodes:long,total_edges:long,memory_usage:double,files_analyzed:long,nodes_per_second:long,average_depth:double>"
)

NODE_TYPES = ("function", "method", "arrow", "constructor", "accessor")
EDGE_TYPES = ("sync", "async", "callback", "constructor")


class AnalysisError(Exception):
    """An error with a code, and where it belongs to a place in a source, that place."""

    def __init__(self, message: str, code: str, file: str | None = None, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.code, self.file, self.line, self.column = code, file, line, column


@dataclass(frozen=True)
class AnalysisOptions:
    """What an analysis includes; every option is honoured (quirk Q19)."""

    max_depth: int = 10
    include_node_modules: bool = False
    include_test_files: bool = False
    exclude_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    follow_imports: bool = True
    analyze_callbacks: bool = True
    collect_metrics: bool = False


@dataclass(frozen=True)
class CallGraph:
    """Nodes, edges and one metadata row for each graph."""

    nodes: DataFrame
    edges: DataFrame
    graphs: DataFrame | None = field(default=None)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[dict], edges: list[dict], graph_id: str = "g") -> CallGraph:
        """A small literal graph; missing fields are null, ``ord`` is the place in the list."""

        def frame(rows: list[dict], ddl: str) -> DataFrame:
            schema = T.StructType.fromDDL(ddl)
            full = [{**dict.fromkeys(schema.fieldNames()), "graph_id": graph_id, "ord": i, **r} for i, r in enumerate(rows)]
            return spark.createDataFrame(full, schema)

        for i, e in enumerate(edges):
            e.setdefault("id", f"{e['src']}->{e['dst']}-{i}")
        return cls(frame(nodes, NODES), frame(edges, EDGES))
