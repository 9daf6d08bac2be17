"""Plans as data, parsed from JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

# Fixed values.
ENVIRONMENTS = ("prod", "dev", "test")
TRACE_KEY = re.compile(r"[A-Za-z0-9._/-]+")
TRACE_KEY_LENGTH = 64


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class PlanNode:
    id: str
    op: str
    inputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    trace_key: str = ""


@dataclass(frozen=True)
class Plan:
    nodes: tuple[PlanNode, ...]
    name: str = "unnamed"
    version: int = 1
    env: str = "dev"
    sample_rate: float = 0.0
    dump_keys: tuple[int, ...] = ()

    def to_json(self) -> dict:
        nodes = [{"id": n.id, "op": n.op, "inputs": list(n.inputs), "params": n.params} | ({"trace_key": n.trace_key} if n.trace_key else {}) for n in self.nodes]
        return {"name": self.name, "version": self.version, "meta": {"env": self.env}, "nodes": nodes, "logging": {"sample_rate": self.sample_rate, "dump_keys": list(self.dump_keys)}}


def trace_key_problem(key: str) -> str | None:
    if key == "":
        return None
    if len(key) > TRACE_KEY_LENGTH:
        return f"trace_key exceeds maximum length of {TRACE_KEY_LENGTH} characters"
    return None if TRACE_KEY.fullmatch(key) else f"trace_key holds characters outside [A-Za-z0-9._/-]: {key}"


def _typed(value, kind, what: str):
    if not isinstance(value, kind) or isinstance(value, bool):
        raise PlanError(f"Plan parse error: {what} must be {getattr(kind, '__name__', 'a number')}, not {type(value).__name__}")
    return value


def parse_plan(document: dict | str) -> Plan:
    """A plan from JSON text or its parsed form, with the checks that need no other node."""
    if isinstance(document, str):
        try:
            document = json.loads(document)
        except ValueError as e:
            raise PlanError(f"Plan parse error: {e}") from e
    _typed(document, dict, "plan")
    meta = _typed(document.get("meta", {}), dict, "meta")
    env = _typed(meta.get("env", "dev"), str, "meta.env")
    if env not in ENVIRONMENTS:
        raise PlanError(f'Invalid plan.meta.env value: "{env}". Must be one of: ' + ", ".join(f'"{e}"' for e in ENVIRONMENTS))
    nodes = []
    for i, n in enumerate(_typed(document.get("nodes", []), list, "nodes")):
        _typed(n, dict, f"nodes[{i}]")
        for needed in ("id", "op"):
            if needed not in n:
                raise PlanError(f"Plan parse error: nodes[{i}] has no '{needed}'")
        node_id = _typed(n["id"], str, f"nodes[{i}].id")
        inputs = tuple(_typed(x, str, f"nodes[{i}].inputs") for x in _typed(n.get("inputs", []), list, f"nodes[{i}].inputs"))
        key = _typed(n.get("trace_key", ""), str, f"nodes[{i}].trace_key")
        if problem := trace_key_problem(key):
            raise PlanError(f"Node '{node_id}': {problem}")
        nodes.append(PlanNode(node_id, _typed(n["op"], str, f"nodes[{i}].op"), inputs, _typed(n.get("params", {}), dict, f"nodes[{i}].params"), key))
    logging = _typed(document.get("logging", {}), dict, "logging")
    return Plan(
        tuple(nodes),
        _typed(document.get("name", "unnamed"), str, "name"),
        _typed(document.get("version", 1), int, "version"),
        env,
        float(_typed(logging.get("sample_rate", 0.0), (int, float), "logging.sample_rate")),
        tuple(_typed(k, int, "logging.dump_keys") for k in logging.get("dump_keys", [])),
    )


def load_plan(path: str | Path) -> Plan:
    path = Path(path)
    if not path.is_file():
        raise PlanError(f"Failed to open plan file: {path}")
    return parse_plan(path.read_text(encoding="utf-8"))
