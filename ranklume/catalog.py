"""The catalog of node operators, as data, as a DataFrame, and of module files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .keys import KeyRegistry
from .operators.base import NodeSpec, Operators, default_operators
from .operators.python_module import Module, load_module


def _key_names(ids, registry: KeyRegistry) -> list[str]:
    return [k.name if (k := registry.by_id(i)) else str(i) for i in ids]


def entry(spec: NodeSpec, registry: KeyRegistry) -> dict:
    writes = {"kind": "param_derived", "param": spec.writes_from} if spec.writes_from else {"kind": "static", "keys": _key_names(spec.writes, registry)}
    out = {"op": spec.op, "namespace": spec.namespace, "stability": spec.stability, "doc": spec.doc, "params": dict(spec.params), "reads": _key_names(spec.reads, registry), "writes": writes}
    return out | ({"budget": spec.budget} if spec.budget else {}) | ({"capabilities": spec.capabilities} if spec.capabilities else {})


def module_entry(module: Module, raw: dict, registry: KeyRegistry) -> dict:
    meta = module.meta
    namespace, stability = raw.get("namespace", f"py.{meta.name}"), raw.get("stability", "stable")
    if (stability == "experimental") != namespace.startswith("experimental."):
        raise ValueError(f"{module.path}: experimental modules, and only those, are in the namespace experimental.*")
    per_row = {x: getattr(meta, x) for x in ("max_write_bytes_per_row", "max_write_cells_per_row") if getattr(meta, x) is not None}
    return {"op": module.op, "namespace": namespace, "stability": stability, "doc": raw.get("doc", ""), "params": meta.params, "reads": _key_names(meta.reads, registry), "writes": {"kind": "static", "keys": _key_names(meta.writes, registry)}, "budget": {"max_write_bytes": meta.max_write_bytes, "max_write_cells": meta.max_write_cells, "max_io_read_bytes": meta.max_io_read_bytes, "max_io_read_rows": meta.max_io_read_rows} | per_row, "capabilities": {"io": {"csv_read": meta.csv_read}}}


def scan_modules(folder: str | Path, registry: KeyRegistry) -> tuple[list[dict], list[str]]:
    """Entries of the module files in a folder, and warnings about files that don't load."""
    entries, warnings = [], []
    for path in sorted(Path(folder).rglob("*.py")):
        try:
            module = load_module(path)
            named = Module(module.meta, module.run_batch, path.relative_to(folder).as_posix(), module.digest)
            space: dict = {}
            import runpy

            space = runpy.run_path(str(path))
            entries.append(module_entry(named, space["META"], registry))
        except Exception as e:  # a broken module must not hide the others
            warnings.append(f"{path}: {e}")
    return entries, warnings


def export(operators: Operators | None = None, registry: KeyRegistry | None = None, modules: str | Path | None = None) -> dict:
    """The catalog, sorted by namespace."""
    operators, registry = operators or default_operators(), registry or KeyRegistry.default()
    nodes = [entry(s, registry) for s in operators.all()]
    warnings: list[str] = []
    if modules is not None:
        found, warnings = scan_modules(modules, registry)
        nodes += found
    return {"version": 1, "nodes": sorted(nodes, key=lambda n: (n["namespace"], n["op"])), "warnings": warnings}


def to_frame(spark: SparkSession, operators: Operators | None = None, registry: KeyRegistry | None = None) -> DataFrame:
    rows = [(n["op"], n["namespace"], n["stability"], json.dumps(n["params"], sort_keys=True), ",".join(n["reads"]), n["writes"]["kind"], ",".join(n["writes"].get("keys", [])) or n["writes"].get("param", "")) for n in export(operators, registry)["nodes"]]
    return spark.createDataFrame(rows, "op string, namespace string, stability string, params string, reads string, writes_kind string, writes string")


def to_yaml(document: dict) -> str:
    """The catalog as YAML; scalars are JSON, which YAML holds."""

    def lines(value, indent: int):
        pad = "  " * indent
        if isinstance(value, dict) and value:
            for k, v in value.items():
                if isinstance(v, (dict, list)) and v:
                    yield f"{pad}{k}:"
                    yield from lines(v, indent + 1)
                else:
                    yield f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"
        elif isinstance(value, list):
            for v in value:
                if isinstance(v, dict) and v:
                    first, *rest = lines(v, indent + 1)
                    yield f"{pad}- {first.lstrip()}"
                    yield from rest
                else:
                    yield f"{pad}- {json.dumps(v, ensure_ascii=False)}"

    return "\n".join(lines(document, 0)) + "\n"
