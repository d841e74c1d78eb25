"""Specification, batch and configuration files; read on the driver, they are a page long."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from edgeframe.model import AnalysisError, AnalysisOptions
from edgeframe.operators.validate import Specification
from edgeframe.sources import mermaid

_HEADER = re.compile(r"%%\s*test-spec:\s*(\{.*?\})\s*%%", re.DOTALL)


def _load(text: str, suffix: str) -> dict:
    if suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:  # YAML is optional; JSON always works
        raise AnalysisError("YAML files need PyYAML", "YAML_UNAVAILABLE") from e
    return yaml.safe_load(text) or {}


def _entry(value) -> str:
    if isinstance(value, dict):
        if not value.get("file") or not value.get("function"):
            raise AnalysisError("entryPoint needs file and function", "INVALID_SPEC")
        return entry_id(value["file"], value["function"], value.get("className") or value.get("class_name"))
    if not value:
        raise AnalysisError("entryPoint is missing", "INVALID_SPEC")
    return str(value)


def entry_id(file: str, function: str, class_name: str | None = None) -> str:
    """``file#fn`` or ``file#Class.fn``."""
    return f"{file}#{class_name}.{function}" if class_name else f"{file}#{function}"


def _edges(rows) -> tuple:
    return tuple((r["from"], r["to"], r.get("type")) for r in rows or [])


def specification(data: dict) -> Specification:
    """From the content of a specification file; missing lists are empty."""
    nodes = lambda key: tuple(n if isinstance(n, str) else n["name"] for n in data.get(key) or [])
    return Specification(
        entry_point=_entry(data.get("entryPoint") or data.get("entry_point")).split("#")[-1],
        required_edges=_edges(data.get("requiredEdges") or data.get("required_calls")),
        forbidden_edges=_edges(data.get("forbiddenEdges")),
        required_nodes=nodes("requiredNodes") or nodes("required_functions"),
        forbidden_nodes=nodes("forbiddenNodes"),
        max_depth=data.get("maxDepth"),
        max_complexity=data.get("maxComplexity"),
        name=data.get("name", ""),
        description=data.get("description", ""),
    )


def diagram_specification(text: str) -> Specification:
    """A diagram whose header comment has the entry point: its edges and nodes are required."""
    header = _HEADER.search(text)
    data = _load(header[1], ".yaml") if header else {}
    diagram = mermaid.parse(text)
    if diagram.errors:
        raise AnalysisError("; ".join(diagram.errors), "INVALID_DIAGRAM")
    label = lambda n: diagram.nodes[n]["label"] or n
    first = next((n for n in diagram.nodes if n not in {e["dst"] for e in diagram.edges}), next(iter(diagram.nodes), ""))
    data.setdefault("entryPoint", label(first) if first else "")
    data["requiredEdges"] = [*data.get("requiredEdges", []), *({"from": label(e["src"]), "to": label(e["dst"]), "type": e["type"]} for e in diagram.edges)]
    data["requiredNodes"] = [*data.get("requiredNodes", []), *map(label, diagram.nodes)]
    return specification(data)


def read_specification(path: str) -> Specification:
    """By extension: YAML, JSON or a Mermaid diagram."""
    file = Path(path)
    if file.suffix in (".yaml", ".yml", ".json"):
        return specification(_load(file.read_text(), file.suffix))
    if file.suffix in (".mermaid", ".mmd"):
        return diagram_specification(file.read_text())
    raise AnalysisError(f"unsupported specification {path}", "UNSUPPORTED_SPEC_FORMAT")


@dataclass(frozen=True)
class BatchEntry:
    entry: str
    output: str
    format: str
    options: AnalysisOptions


def read_batch(path: str) -> list[BatchEntry]:
    """The entries of a batch file, options cascading from entry to common to default (quirk Q20: both spellings)."""
    data = _load(Path(path).read_text(), Path(path).suffix)
    rows = data.get("entry_points") or data.get("entryPoints")
    if not isinstance(rows, list) or not rows:
        raise AnalysisError("entry_points must be a list", "INVALID_BATCH_CONFIG")
    common, out = data.get("common_options") or data.get("commonOptions") or {}, []
    for row in rows:
        if not row.get("file") or not row.get("function") or not row.get("output"):
            raise AnalysisError("an entry needs file, function and output", "INVALID_BATCH_CONFIG")
        mine = row.get("options") or {}
        pick = lambda key, default, mine=mine: mine.get(key, common.get(key, default))
        options = AnalysisOptions(max_depth=pick("max_depth", 10), exclude_patterns=tuple(pick("exclude_patterns", ())), include_patterns=tuple(pick("include_patterns", ())), collect_metrics=pick("include_metrics", False))
        out.append(BatchEntry(entry_id(row["file"], row["function"], row.get("className") or row.get("class_name")), row["output"], pick("format", "json"), options))
    return out


def read_config(path: str, **overrides) -> AnalysisOptions:
    """Analysis options of a configuration file; given values win."""
    data = _load(Path(path).read_text(), Path(path).suffix)
    snake = {re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), k): tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    known = {k: v for k, v in {**snake, **{k: v for k, v in overrides.items() if v is not None}}.items() if k in AnalysisOptions.__dataclass_fields__}
    return AnalysisOptions(**known)


def find_tsconfig(start: str) -> str | None:
    """The configuration file of a project: the file itself, one in the folder, or in a folder above."""
    path = Path(start)
    if path.is_file() and path.suffix == ".json":
        return str(path)
    for folder in (path, *path.resolve().parents):
        if (folder / "tsconfig.json").is_file():
            return str(folder / "tsconfig.json")
    return None


def project_globs(tsconfig: str | None) -> tuple[list[str], list[str]]:
    """Include and exclude globs of a project file, or the defaults."""
    data = json.loads(Path(tsconfig).read_text()) if tsconfig else {}
    glob = lambda g: g if "*" in g or "." in g.rsplit("/", 1)[-1] else g.rstrip("/") + "/**"
    return [glob(g.removeprefix("./")) for g in data.get("include") or ["src/**", "lib/**"]], [glob(g.removeprefix("./")) for g in data.get("exclude") or ["**/node_modules/**", "**/dist/**"]]
