"""Filters on nodes, edges and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.columns import any_match, glob_regex, is_external, is_test_file, matches
from edgeframe.model import AnalysisOptions


def file_predicate(path: Column, options: AnalysisOptions) -> Column:
    """Whether an analysis includes a file."""
    keep = F.lit(True)
    if not options.include_node_modules:
        keep = keep & ~path.contains("node_modules")
    if not options.include_test_files:
        keep = keep & ~is_test_file(path)
    if options.exclude_patterns:
        keep = keep & ~any_match(path, options.exclude_patterns)
    if options.include_patterns:
        keep = keep & any_match(path, options.include_patterns)
    return keep


def options_from_globs(include: list[str] | None = None, exclude: list[str] | None = None, no_external: bool = False, **rest) -> AnalysisOptions:
    """Options whose patterns come from globs."""
    away = [glob_regex(g) for g in exclude or []] + (["node_modules", "@types/", r"\.d\.ts$"] if no_external else [])
    return AnalysisOptions(exclude_patterns=tuple(away), include_patterns=tuple(glob_regex(g) for g in include or []), **rest)


def filter_files(nodes: DataFrame, options: AnalysisOptions) -> DataFrame:
    return nodes.filter(file_predicate(F.col("file_path"), options))


def filter_nodes(nodes: DataFrame, types: list[str] | None = None, files: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of the types, in some of the files and none of the excluded ones."""
    keep = F.lit(True)
    if types:
        keep = keep & F.col("type").isin(types)
    if files:
        keep = keep & any_match(F.col("file_path"), files)
    if exclude:
        keep = keep & ~any_match(F.col("file_path"), exclude)
    return nodes.filter(keep)


def filter_edges(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    return edges.filter(F.col("type").isin(types)) if types else edges


def match_nodes(nodes: DataFrame, pattern: str, compat: bool = False) -> DataFrame:
    """Nodes that a specification's pattern names, by name, id or class (and ``Class.name``, quirk Q18)."""
    columns = [F.col("name"), F.col("id"), F.col("class_name")]
    return nodes.filter(matches(pattern, *columns, *([] if compat else [F.concat_ws(".", "class_name", "name")]), compat=compat))


def match_globs(nodes: DataFrame, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    keep = any_match(F.col("file_path"), tuple(glob_regex(g) for g in include))
    return nodes.filter(keep & ~any_match(F.col("file_path"), tuple(glob_regex(g) for g in exclude or [])))


def drop_external(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~is_external(F.col("file_path")))


def search(df: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Rows whose column contains the text, whatever the case; a short list for a prompt."""
    return df.filter(F.lower(column).contains(text.lower())).orderBy(column).limit(limit)
