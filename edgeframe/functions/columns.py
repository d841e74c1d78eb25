"""Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(file_path: Column, name: Column, class_name: Column | None = None) -> Column:
    """Canonical id: ``file#fn`` or ``file#Class.method``."""
    if class_name is None:
        return F.concat_ws("#", file_path, name)
    return F.concat(file_path, F.lit("#"), F.when(class_name.isNotNull(), F.concat(class_name, F.lit("."), name)).otherwise(name))


def local_id(file_path: Column, name: Column, line: Column, exported: Column) -> Column:
    """Scheme of exported and local functions: ``file#fn`` or ``file#fn:line``."""
    return F.when(exported, F.concat_ws("#", file_path, name)).otherwise(F.concat(file_path, F.lit("#"), name, F.lit(":"), line.cast("string")))


def qualified_name(file_path: Column, kind: Column, name: Column, class_name: Column, is_static: Column, line: Column) -> Column:
    """Fully qualified name: ``C.m`` static, ``C::m`` instance, ``C::get:x`` accessors, ``anonymous:line``."""
    member = F.when(kind.isin("get", "set"), F.concat(class_name, F.lit("::"), kind, F.lit(":"), name)).when(is_static, F.concat_ws(".", class_name, name)).otherwise(F.concat(class_name, F.lit("::"), name))
    plain = F.when(name.isNull(), F.concat(F.lit("anonymous:"), line.cast("string"))).otherwise(name)
    return F.concat(file_path, F.lit("#"), F.when(class_name.isNotNull(), member).otherwise(plain))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_path(path: Column) -> Column:
    """From the first ``src`` segment on, or the last two segments."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src")
    return F.array_join(F.when(at > 0, F.slice(parts, at, F.size(parts))).otherwise(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)), "/")


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ``**`` any path, ``*`` inside a segment, ``?`` one character (quirk Q8)."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return rf"^{out}$"


def wildcard_regex(pattern: str, compat: bool = False) -> str:
    """``*`` matches anything; other characters are literal unless ``compat`` (quirk Q17)."""
    return "(?i)^" + (pattern.replace("*", ".*") if compat else ".*".join(map(re.escape, pattern.split("*")))) + "$"


def matches(pattern: str, *columns: Column, compat: bool = False) -> Column:
    """Whether any column matches: without ``*`` exactly, with it regardless of case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.rlike(wildcard_regex(pattern, compat)) if "*" in pattern else c == pattern, F.lit(False))
    return found


def any_match(column: Column, patterns: tuple[str, ...]) -> Column:
    return column.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.(ts|js)$") | path.contains("/__tests__/") | path.contains("/test/") | path.contains("/tests/")


def is_external(path: Column) -> Column:
    return path.contains("node_modules") | path.contains("@types/") | path.endswith(".d.ts")


def safe_id(name: Column) -> Column:
    """An identifier for diagrams: other characters become ``_``, a leading digit or keyword is prefixed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    plain = F.when(plain == "", "node").otherwise(plain)
    return F.when(plain.rlike("^[0-9]") | F.lower(plain).isin("end", "graph", "subgraph", "class", "click", "style", "flowchart", "direction"), F.concat(F.lit("n_"), plain)).otherwise(plain)


def escape_label(text: Column) -> Column:
    """For quoted strings of DOT: backslash first, then quotes and line ends."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
