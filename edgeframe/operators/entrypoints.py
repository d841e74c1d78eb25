"""Entry points: parsing, finding, discovering and validating."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.columns import any_match, base_name
from edgeframe.model import AnalysisError

# Words that make a function an entry point.
CONTROLLER_WORDS = ("get", "post", "put", "delete", "patch", "head", "options", "handle", "create", "update", "remove", "list")
HANDLER_WORDS = ("handler", "handle", "route", "middleware")
MAIN_NAMES = ("main", "start", "init", "bootstrap", "run", "execute")


def parse_entry(entry: str) -> tuple[str, str, str | None]:
    """(file, function, class or None) of ``file#fn`` and ``file#Class.method``."""
    file, _, name = entry.partition("#")
    parts = name.split("#")[0].split(".")
    if not file or not parts[0] or len(parts) > 2 or not parts[-1]:
        raise AnalysisError(f"expected file#function or file#Class.method, not {entry!r}", "INVALID_ENTRY_POINT_FORMAT")
    return (file, parts[1], parts[0]) if len(parts) == 2 else (file, parts[0], None)


def find_files(facts: DataFrame, file: str) -> DataFrame:
    """(path): the best match of a file name: exact, with an extension, then as a path's end."""
    rank = F.when(F.col("path") == file, 0).when(F.col("path").isin(f"{file}.ts", f"{file}.tsx"), 1).when(F.col("path").rlike("(^|/)" + re.escape(file.lstrip("./")) + r"(\.tsx?)?$"), 2).when(base_name(F.col("path")) == file.rsplit("/", 1)[-1], 3)
    return facts.select("path").distinct().withColumn("rank", rank).filter("rank is not null").agg(F.min_by("path", F.struct("rank", "path")).alias("path")).filter("path is not null")


def find_entry(facts: DataFrame, entry: str) -> DataFrame:
    """One row: id, name, file, kind, is_static, class_name; of several candidates the first in priority."""
    file, function, cls = parse_entry(entry)
    mine = facts.join(F.broadcast(find_files(facts, file)), "path")  # one row
    if cls:
        order = {"constructor": 0, "method": 1, "getter": 3, "setter": 5}
        found = mine.filter((F.col("class_name") == cls) & ((F.col("name") == function) | ((F.lit(function) == "constructor") & (F.col("kind") == "constructor"))))
        rank = reduce(lambda acc, k: F.when(F.col("kind") == k, order[k] + F.col("is_static").cast("int")).otherwise(acc), order, F.lit(9))
        found = found.filter(F.col("kind").isin(*order))
    else:
        found = mine.filter((F.col("name") == function) & F.col("top_level") & F.col("kind").isin("function", "arrow"))
        rank = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "arrow", 1).otherwise(2)
    best = found.withColumn("rank", rank).orderBy("rank", "ord").limit(1)
    return best.select("id", "name", F.col("path").alias("file_path"), "kind", F.coalesce("is_static", F.lit(False)).alias("is_static"), "class_name")


def _listed(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col("path").alias("file_path"), F.col("name").alias("function_name"), "class_name", F.when(F.col("exported"), F.col("name")).alias("export_name"), "id")


def discover(facts: DataFrame, compat: bool = False) -> DataFrame:
    """Exported and top-level functions, class methods and constructors, each once (quirk Q10; twice with ``compat``)."""
    top = facts.filter("top_level and kind in ('function', 'arrow')")
    parts = [_listed(top.filter("exported"), "exported"), _listed(top if compat else top.filter("not exported"), "function"), _listed(facts.filter("kind = 'method'"), "method"), _listed(facts.filter("kind = 'constructor'"), "constructor")]
    return reduce(DataFrame.unionByName, parts)


def discover_by_path(facts: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return discover(facts).filter(any_match(F.col("file_path"), patterns))


def _has(column, words: tuple[str, ...]):
    return F.lower(column).rlike("|".join(words))


def controllers(facts: DataFrame) -> DataFrame:
    own = facts.filter("kind = 'method'")
    return _listed(own.filter(_has(base_name(F.col("path")), ("controller",)) & _has(F.col("class_name"), ("controller",)) & _has(F.col("name"), CONTROLLER_WORDS)), "controller")


def handlers(facts: DataFrame) -> DataFrame:
    own = facts.filter("top_level and exported and kind in ('function', 'arrow')")
    return _listed(own.filter(_has(base_name(F.col("path")), ("handler", "route")) & _has(F.col("name"), HANDLER_WORDS)), "handler")


def mains(facts: DataFrame) -> DataFrame:
    return _listed(facts.filter(F.expr("top_level and kind in ('function', 'arrow')") & F.lower("name").isin(*MAIN_NAMES)), "main")


def exported(facts: DataFrame) -> DataFrame:
    return _listed(facts.filter("top_level and exported and kind = 'function'"), "exported")


def common_patterns(facts: DataFrame) -> DataFrame:
    """Controllers, handlers, main functions and exported functions, by ``kind``."""
    return reduce(DataFrame.unionByName, (controllers(facts), handlers(facts), mains(facts), exported(facts)))


def validate_entry(facts: DataFrame, entry: str) -> dict:
    """is_valid, error and location of one entry point."""
    try:
        row = find_entry(facts, entry).first()
    except AnalysisError as e:
        return {"is_valid": False, "error": str(e), "location": None}
    return {"is_valid": bool(row), "error": None if row else f"not found: {entry}", "location": row.asDict() if row else None}
