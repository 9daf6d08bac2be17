"""Generated code: key constants and typed bindings of node operators.

Outputs are compared byte by byte to tell whether they are fresh.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from .catalog import export
from .keys import Key, KeyRegistry
from .operators.base import Operators

HEAD = "Generated from the key registry. Do not edit."


def _sorted(registry: KeyRegistry) -> list[Key]:
    return sorted(registry.keys, key=lambda k: k.id)


def keys_python(registry: KeyRegistry) -> str:
    rows = [f"{k.constant} = {k.id}  # {k.type}, {k.scope}: {k.doc}" for k in _sorted(registry)]
    info = [f"    {k.id}: {(k.name, k.type, k.scope, k.owner, k.column)!r}," for k in _sorted(registry)]
    return "\n".join([f'"""{HEAD}"""', "", *rows, "", "#: name, type, scope, owner, column", "INFO = {", *info, "}", "BY_NAME = {info[0]: key for key, info in INFO.items()}", ""])


def keys_typescript(registry: KeyRegistry) -> str:
    body = []
    for k in _sorted(registry):
        body += [f"  /** {k.doc} ({k.owner}) */", f"  {k.constant}: {{ id: {k.id}, name: {json.dumps(k.name)}, type: {json.dumps(k.type)}, scope: {json.dumps(k.scope)} }},"]
    return "\n".join([f"// {HEAD}", "", "export const Keys = {", *body, "} as const;", "", "export const KeyById = Object.fromEntries(Object.values(Keys).map((k) => [k.id, k]));", "export const KeyByName = Object.fromEntries(Object.values(Keys).map((k) => [k.name, k]));", ""])


def keys_header(registry: KeyRegistry) -> str:
    ids = [f"inline constexpr int {k.constant} = {k.id};  // {k.name}: {k.type}" for k in _sorted(registry)]
    return "\n".join([f"// {HEAD}", "#pragma once", "", "namespace keys {", *ids, f"inline constexpr int kCount = {len(ids)};", "}  // namespace keys", ""])


def keys_json(registry: KeyRegistry) -> str:
    return json.dumps({"version": registry.version, "keys": [asdict(k) for k in _sorted(registry)]}, indent=2, ensure_ascii=False) + "\n"


def keys_commonjs(registry: KeyRegistry) -> str:
    body = [f"  {k.constant}: {k.id}," for k in _sorted(registry)]
    return "\n".join([f"// {HEAD}", "module.exports = {", *body, "};", ""])


KEY_FILES = {"keys.py": keys_python, "keys.ts": keys_typescript, "keys.h": keys_header, "keys.json": keys_json, "keys.cjs": keys_commonjs}


def bindings_python(operators: Operators | None = None, registry: KeyRegistry | None = None) -> str:
    """Stub classes of the pipeline namespaces, with the catalog in the docstrings."""
    nodes = export(operators, registry)["nodes"]
    out = ['"""Generated from the node catalog. Do not edit."""', "", "from ranklume.plans.pipeline import Step", ""]
    kinds = {"int": "int", "float": "float", "string": "str", "path": "str", "sql": "str"}
    for prefix in sorted({n["op"].partition(":")[0] for n in nodes}):
        out += ["", f"class {prefix.capitalize()}:"]
        for n in (n for n in nodes if n["op"].partition(":")[0] == prefix):
            params = "".join(f", {p}: {kinds.get(t, 'object')} = ..." for p, t in n["params"].items())
            writes = n["writes"].get("keys") or [f"from {n['writes'].get('param')}"]
            out += [f"    def {n['op'].partition(':')[2]}(self, *inputs: Step{params}) -> Step:", f'        """{n["doc"]}', "", f"        @reads {', '.join(n['reads']) or '-'}", f"        @writes {', '.join(writes) or '-'}", f"        @stability {n['stability']}", '        """', "        ...", ""]
    out += ["", "NODE_REGISTRY = {", *(f"    {n['op']!r}: {n['namespace']!r}," for n in nodes), "}", ""]
    return "\n".join(out)


def generate(registry: KeyRegistry, folder: str | Path, check: bool = False) -> list[str]:
    """Writes all files, or with ``check`` names those that are missing or stale and writes nothing."""
    folder, off = Path(folder), []
    contents = {name: make(registry) for name, make in KEY_FILES.items()} | {"nodes.pyi": bindings_python(None, registry)}
    for name, text in contents.items():
        path = folder / name
        if check:
            if not path.is_file():
                off.append(f"missing: {name}")
            elif path.read_bytes() != text.encode():
                off.append(f"stale: {name}")
        else:
            folder.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8", newline="\n")
    return off
