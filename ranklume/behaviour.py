"""Queries that show behaviour as a table: one row for each case, with what comes of it.

They cover what has no rows of its own: plans and their checks, budgets, the gate,
the key registry, generated files, the catalog, policies and user modules.
"""

from __future__ import annotations

import ast
import json
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import catalog, codegen
from .functions.tree import collect_key_ids, parse
from .keys import Key, KeyRegistry, check_entries, parse_yaml
from .operators.base import NodeSpec, Operators, default_operators
from .operators.python_module import load_module, make_module, run_on
from .plans import Budget, Pipeline, check_budget, compile_plan, load_plan, measure, parse_plan, score
from .plans.gate import check_source
from .plans.plan import trace_key_problem
from .plans.trace import module_prefix, prefixed_key, span_name
from .sources import IoBudget, Policy, check_resource, read_csv
from .sources.sinks import format_value

REGISTRY = KeyRegistry.default()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def outcome(f) -> str:
    """What a call returns, or the error that it raises (its first line)."""
    try:
        return str(f())
    except Exception as e:  # noqa: BLE001
        return f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"


def table(expected: dict[str, str]):
    """Registers a function that returns calls by case; the SQL lists what is expected of them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with tempfile.TemporaryDirectory() as folder:  # read on the driver only
                return spark.createDataFrame([(case, outcome(call)) for case, call in f(Path(folder)).items()], "item string, outcome string")

        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        QUERIES[f.__name__] = run
        SQL[f.__name__] = "select * from (values " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in expected.items()) + ") as t(item, outcome)"
        return f

    return add


def nodes(*items, **more) -> dict:
    return {"nodes": [{"id": i, "op": op, "inputs": list(inputs)} for i, op, *inputs in items], **more}


def chain(n: int) -> dict:
    return nodes(("n0", "core:sourcer"), *((f"n{i}", "core:features", f"n{i - 1}") for i in range(1, n)))


# -- plans ---------------------------------------------------------------------


@table(
    {
        'defaults': "('unnamed', 1, 'dev', 0.0, (), 0)",
        'all fields': "('x', 2, 'prod', 0.5, (3001,), 1)",
        'round trip': 'True',
        'file': 'f',
        'no file': 'True',
        'env prod': 'prod',
        'env dev': 'dev',
        'env test': 'test',
        "bad env 'Prod'": 'True',
        "bad env 'staging'": 'True',
        "bad env ''": 'True',
        'bad text': 'PlanError',
        'bad list': 'PlanError',
        'bad version': 'PlanError',
        'bad nodes': 'PlanError',
        'bad no id': 'PlanError',
        'bad no op': 'PlanError',
        'bad inputs': 'PlanError',
    }
)
def plan_parsing(folder):
    (folder / "p.json").write_text('{"name": "f", "nodes": []}')
    fields = lambda p: (p.name, p.version, p.env, p.sample_rate, p.dump_keys, len(p.nodes))
    env = lambda e: lambda: parse_plan({"meta": {"env": e}}).env
    full = {"name": "x", "version": 2, "meta": {"env": "prod"}, "nodes": [{"id": "a", "op": "core:sourcer", "params": {"k": 3}, "trace_key": "t/1"}], "logging": {"sample_rate": 0.5, "dump_keys": [3001]}}
    bad = {"text": "{", "list": "[]", "version": {"version": "2"}, "nodes": {"nodes": {}}, "no id": {"nodes": [{"op": "x"}]}, "no op": {"nodes": [{"id": "a"}]}, "inputs": {"nodes": [{"id": "a", "op": "x", "inputs": "b"}]}}
    kind = lambda doc: lambda: outcome(lambda: parse_plan(doc)).split(":")[0]
    return {
        "defaults": lambda: fields(parse_plan({"nodes": []})),
        "all fields": lambda: fields(parse_plan(json.dumps(full))),
        "round trip": lambda: parse_plan(parse_plan(full).to_json()) == parse_plan(full),
        "file": lambda: load_plan(folder / "p.json").name,
        "no file": lambda: outcome(lambda: load_plan(folder / "none.json")).startswith("PlanError: Failed to open"),
        **{f"env {e}": env(e) for e in ("prod", "dev", "test")},
        **{f"bad env {e!r}": lambda e=e: "Must be one of" in outcome(env(e)) for e in ("Prod", "staging", "")},
        **{f"bad {k}": kind(v) for k, v in bad.items()},
    }


@table(
    {
        '0: ': 'fine',
        '64: aaaaaaaaaaaa': 'fine',
        '9: A-z_0.9/x': 'fine',
        '65: aaaaaaaaaaaa': 'refused',
        '3: a b': 'refused',
        '3: a@b': 'refused',
        '3: a:b': 'refused',
    }
)
def plan_trace_keys(folder):
    return {f"{len(k)}: {k[:12]}": lambda k=k: "fine" if trace_key_problem(k) is None else "refused" for k in ("", "a" * 64, "A-z_0.9/x", "a" * 65, "a b", "a@b", "a:b")}


@table(
    {
        'order': "('a', 'b', 'z', 'y')",
        'duplicate': 'CompileError: Duplicate node ID: a',
        'duplicate before order': 'CompileError: Duplicate node ID: a',
        'cycle': 'CompileError: Plan contains a cycle',
        'cycle before operator': 'CompileError: Plan contains a cycle',
        'unknown input': "CompileError: Node 'a' has an unknown input: zzz",
        'unknown operator': 'CompileError: Unknown op type: what:ever',
        'two inputs': "CompileError: Node 'c': core:model takes one input",
        'too deep': 'CompileError: PLAN_TOO_COMPLEX:',
        'loose prefix': "('a',)",
        'loose any core': "('a',)",
        'loose dangling': 'CompileError: Plan contains a cycle',
        'result': 'y',
        'no budget': '121',
        'experimental in dev': "('a', 'b')",
        'experimental in prod': "CompileError: Production plans cannot use experimental nodes. Node 'b' (op: 'ext:new', namespace: 'experimental.new') has stability=experimental.",
    }
)
def plan_compile_errors(folder):
    ops = default_operators()
    ops.register(NodeSpec("ext:new", "experimental.new", lambda c, i, p: i[0], stability="experimental"))
    docs = {
        "order": nodes(("z", "core:model", "a"), ("a", "core:sourcer"), ("b", "core:sourcer"), ("y", "core:model", "b")),
        "duplicate": nodes(("a", "core:sourcer"), ("a", "core:model", "a")),
        "duplicate before order": nodes(("a", "what:ever", "a"), ("a", "core:model")),
        "cycle": nodes(("a", "core:model", "b"), ("b", "core:model", "a")),
        "cycle before operator": nodes(("a", "what:ever", "a")),
        "unknown input": nodes(("a", "core:model", "zzz")),
        "unknown operator": nodes(("a", "what:ever")),
        "two inputs": nodes(("a", "core:sourcer"), ("b", "core:sourcer"), ("c", "core:model", "a", "b")),
        "too deep": chain(121),
    }
    loose = {"prefix": nodes(("a", "js:mod")), "any core": nodes(("a", "core:anything")), "dangling": nodes(("a", "core:model", "zzz"))}
    new = nodes(("a", "core:sourcer"), ("b", "ext:new", "a"))
    return {
        **{k: lambda d=d: compile_plan(parse_plan(d)).order for k, d in docs.items()},
        **{f"loose {k}": lambda d=d: compile_plan(parse_plan(d), strict=False).order for k, d in loose.items()},
        "result": lambda: compile_plan(parse_plan(docs["order"])).result,
        "no budget": lambda: len(compile_plan(parse_plan(chain(121)), budget=None).order),
        **{f"experimental in {e}": lambda e=e: outcome(lambda: compile_plan(parse_plan(new | {"meta": {"env": e}}), ops).order) for e in ("dev", "prod")},
    }


@table(
    {
        'empty': '(0, 0, 0, 0, 0, 0)',
        'chain of 10': '(10, 9, 10, 1, 1, 68)',
        'fan-out of 10': '(11, 10, 2, 10, 1, 48)',
        'fan-in of 8': '(9, 8, 2, 1, 8, 41)',
        'used before declared': '(2, 1, 2, 1, 1, 16)',
        'longest path': "('n0', 'n1', 'n2', 'n3')",
    }
)
def plan_metrics(folder):
    of = lambda d: lambda: (lambda m: (m.node_count, m.edge_count, m.max_depth, m.fanout_peak, m.fanin_peak, score(m)))(measure(parse_plan(d)))
    return {
        "empty": of({"nodes": []}),
        "chain of 10": of(chain(10)),
        "fan-out of 10": of(nodes(("s", "core:sourcer"), *((f"x{i}", "core:model", "s") for i in range(10)))),
        "fan-in of 8": of(nodes(*((f"x{i}", "core:sourcer") for i in range(8)), ("m", "core:merge", *(f"x{i}" for i in range(8))))),
        "used before declared": of(nodes(("b", "core:model", "a"), ("a", "core:sourcer"))),
        "longest path": lambda: measure(parse_plan(chain(4))).longest_path,
    }


@table(
    {
        'defaults': '(2000, 120, 10000, 8000)',
        'at the limit': 'True',
        '0 is no limit': 'True',
        'violations': "('node_count=10 (hard_limit=9)', 'max_depth=10 (hard_limit=3)')",
        'code': "(False, 'PLAN_TOO_COMPLEX')",
        'diagnostics': '[True, True, True, True, True]',
        'soft limits warn': "(True, ('edge_count=9 (soft_limit=3)', 'complexity_score=68 (soft_limit=67)'))",
        'file': '(7, 120, 2.0, 5.0)',
    }
)
def plan_budgets(folder):
    m = measure(parse_plan(chain(10)))
    (folder / "b.json").write_text('{"hard": {"node_count": 7}, "score_weights": {"edge_count": 2.0}}')
    tight = lambda: check_budget(m, Budget(node_count=9, max_depth=3))
    loaded = lambda: Budget.load(folder / "b.json")
    return {
        "defaults": lambda: (Budget().node_count, Budget().max_depth, Budget().edge_count, Budget().complexity_score),
        "at the limit": lambda: check_budget(m, Budget(node_count=10)).passed,
        "0 is no limit": lambda: check_budget(m, Budget(node_count=0)).passed,
        "violations": lambda: tight().violations,
        "code": lambda: (tight().passed, tight().error_code),
        "diagnostics": lambda: [t in tight().diagnostics for t in ("PLAN_TOO_COMPLEX:", "Top fanout nodes:", "n0 core:sourcer fanout=1", "Longest path (len=10):", "Hint:")],
        "soft limits warn": lambda: (lambda v: (v.passed, v.warnings))(check_budget(m, Budget(edge_count=3, complexity_score=67))),
        "file": lambda: (loaded().node_count, loaded().max_depth, loaded().weights.edge_count, loaded().weights.max_depth),
    }


@table(
    {
        'import': 'E_IMPORT_STATEMENT',
        'from': 'E_IMPORT_STATEMENT',
        'all': 'E_EXPORT_STATEMENT',
        'dunder import': 'E_DYNAMIC_IMPORT',
        'eval': 'E_EVAL_CALL',
        'compile': 'E_FUNCTION_CONSTRUCTOR',
        'for': 'E_LOOP_STATEMENT',
        'while': 'E_LOOP_STATEMENT',
        'comprehension': 'E_LOOP_STATEMENT',
        'class': 'E_CLASS_DECLARATION',
        'generator': 'E_GENERATOR_FUNCTION',
        'async': 'E_ASYNC_FUNCTION',
        'with': 'E_WITH_STATEMENT',
        'lambda': 'E_ARROW_OUTSIDE_EXPR',
        'lambda in expr': '',
        'global': 'E_DISALLOWED_GLOBAL',
        'open': 'E_DISALLOWED_GLOBAL',
        'syntax': 'E_PARSE_ERROR',
        'statements': 'E_TOO_MANY_STATEMENTS',
        'branches': 'E_TOO_MANY_BRANCHES',
        'bytes': 'E_FILE_TOO_LARGE',
        'fine': '',
        'two': 'E_DISALLOWED_GLOBAL,E_REQUIRE_CALL',
    }
)
def plan_gate(folder):
    sources = {
        "import": "import os", "from": "from x import y", "all": "__all__ = ['x']", "dunder import": "__import__('os')", "eval": "eval('1')", "compile": "compile('1', '', 'eval')",
        "for": "for i in []: pass", "while": "while True: pass", "comprehension": "x = [i for i in y]", "class": "class A: pass", "generator": "def f():\n  yield 1", "async": "async def f(): pass", "with": "with x: pass",
        "lambda": "f = lambda: 1", "lambda in expr": "x = dsl.expr(lambda: E.signal(3001))", "global": "a.process", "open": "open('x')", "syntax": "x = (", "statements": "x = 1\n" * 201, "branches": "if a:\n  b = 1\n" * 51,
        "bytes": "#" * 50_001, "fine": "p = Pipeline('x')\nplan = p.core.sourcer(k=4)", "two": "require('x')",
    }
    return {k: lambda s=s: ",".join(sorted(check_source(s).codes)) for k, s in sources.items()}


@table(
    {
        'ids': "['src', 'sourcer_2', 'merge_3']",
        'inputs': "('src', 'sourcer_2')",
        'params': "[{'k': 1}, {'k': 2}, {'dedup': 'first'}]",
        'trace key': 'two',
        'unknown node': 'AttributeError: no operator core:nothing',
        'env': 'test',
    }
)
def plan_builder(folder):
    p = Pipeline("b", env="test")
    a, c = p.core.sourcer(k=1, id="src"), p.core.sourcer(k=2, trace_key="two")
    plan = a.core.merge(c, dedup="first").plan()
    return {
        "ids": lambda: [n.id for n in plan.nodes],
        "inputs": lambda: plan.nodes[2].inputs,
        "params": lambda: [n.params for n in plan.nodes],
        "trace key": lambda: plan.nodes[1].trace_key,
        "unknown node": lambda: p.core.nothing,
        "env": lambda: plan.env,
    }


@table(
    {
        'span': "('core:merge', 'core:merge(k)')",
        'prefix': "('c', 'p', 'p::c')",
        'module': "['', 'rank', 'rank.v2', 'noext', '.hidden']",
        'values': '[\'null\', \'true\', \'0.1\', \'3\', \'"x"\', \'<bytes len=2>\', \'<f32vec len=1>\']',
    }
)
def trace_names(folder):
    return {
        "span": lambda: (span_name("core:merge"), span_name("core:merge", "k")),
        "prefix": lambda: (prefixed_key("", "c"), prefixed_key("p", ""), prefixed_key("p", "c")),
        "module": lambda: [module_prefix(x) for x in ("", "a/b/rank.py", "a\\b\\rank.v2.py", "noext", ".hidden")],
        "values": lambda: [format_value(v) for v in (None, True, 0.1, 3, "x", b"ab", [1.0])],
    }


# -- expressions, keys, files ------------------------------------------------------------


@table(
    {
        'const': 'parsed',
        'signal': 'parsed',
        'nested': 'parsed',
        'no op': 'ExprError',
        'unknown op': 'ExprError',
        'const without value': 'ExprError',
        'signal without key': 'ExprError',
        'cos of one': 'ExprError',
        'not a tree': 'ExprError',
        'key ids': '[3001, 3002]',
    }
)
def expression_parsing(folder):
    of = lambda tree: lambda: outcome(lambda: parse(tree)).split(":")[0] if outcome(lambda: parse(tree)).split(":")[0].endswith("Error") else "parsed"
    trees = {
        "const": {"op": "const", "value": 1}, "signal": {"op": "signal", "key_id": 3001}, "nested": {"op": "add", "args": [{"op": "const", "value": 1}, {"op": "signal", "key_id": 3001}]},
        "no op": {"value": 1}, "unknown op": {"op": "div", "args": []}, "const without value": {"op": "const"}, "signal without key": {"op": "signal"}, "cos of one": {"op": "cos", "args": [{"op": "signal", "key_id": 2002}]}, "not a tree": 3,
    }
    keys = {"op": "add", "args": [{"op": "signal", "key_id": 3002}, {"op": "mul", "args": [{"op": "signal", "key_id": 3001}, {"op": "const", "value": 2}]}, {"op": "signal", "key_id": 3002}]}
    return {**{k: of(t) for k, t in trees.items()}, "key ids": lambda: sorted(set(collect_key_ids(parse(keys))))}


GOOD = {"id": 1, "name": "a.b_c", "type": "f32", "scope": "score", "owner": "o", "doc": "d"}


@table(
    {
        'valid': '[]',
        'id=0': "['- keys.0.id']",
        "id='1'": "['- keys.0.id']",
        "name='A.b'": "['- keys.0.name']",
        "name='a..b'": "['- keys.0.name']",
        "type='f64'": "['- keys.0.type']",
        "scope='other'": "['- keys.0.scope']",
        "owner=''": "['- keys.0.owner']",
        'doc=None': "['- keys.0.doc']",
        'version': "['- version']",
        'twice': "['- keys.1.id', '- keys.2.name']",
        'registry': 'RegistryError',
    }
)
def key_validation(folder):
    told = lambda *entries, version=1: lambda: [m.split(": ")[0] for m in check_entries({"version": version, "keys": list(entries)})]
    bad = [("id", 0), ("id", "1"), ("name", "A.b"), ("name", "a..b"), ("type", "f64"), ("scope", "other"), ("owner", ""), ("doc", None)]
    return {
        "valid": told(GOOD),
        **{f"{k}={v!r}": told({**GOOD, k: v}) for k, v in bad},
        "version": told(version=0),
        "twice": told(GOOD, {**GOOD, "name": "z"}, {**GOOD, "id": 5}),
        "registry": lambda: outcome(lambda: KeyRegistry([Key(1, "a", "f32", "score"), Key(1, "b", "f32", "score")])).split(":")[0],
    }


@table(
    {
        'yaml': "(3, 'with: colon')",
        'same from json': 'True',
        'names': "('a_b', 'A_B', None)",
        'unknown': 'KeyError',
        'struct': 'struct<score_base:float,feat_embedding:array<float>>',
        'wrong value': 'TypeError',
        'null value': 'None',
    }
)
def key_files(folder):
    text = "version: 3\nkeys:\n  - id: 1\n    name: a.b\n    type: f32   # a float\n    scope: score\n    owner: \"core\"\n    doc: 'with: colon'\n"
    (folder / "r.yaml").write_text(text)
    loaded = KeyRegistry.load(folder / "r.yaml")
    (folder / "r.json").write_text(codegen.keys_json(loaded))
    return {
        "yaml": lambda: (parse_yaml(text)["version"], parse_yaml(text)["keys"][0]["doc"]),
        "same from json": lambda: KeyRegistry.load(folder / "r.json").keys == loaded.keys,
        "names": lambda: (loaded.by_id(1).column, loaded.by_id(1).constant, loaded.by_id(9)),
        "unknown": lambda: outcome(lambda: loaded.resolve(77)).split(":")[0],
        "struct": lambda: REGISTRY.struct(3001, "feat.embedding").simpleString(),
        "wrong value": lambda: outcome(lambda: REGISTRY.check(REGISTRY.by_id(3001), "x")).split(":")[0],
        "null value": lambda: REGISTRY.check(REGISTRY.by_id(3001), None),
    }


@table(
    {
        'made': '[]',
        'unchanged': '[]',
        'python': '(3999, 3002)',
        'bindings parse': 'Module',
        'typescript': 'True',
        'header': 'True',
        'spoilt': "['missing: keys.ts', 'stale: keys.h']",
    }
)
def generated_files(folder):
    made = lambda: codegen.generate(REGISTRY, folder / "g")
    check = lambda: codegen.generate(REGISTRY, folder / "g", check=True)

    def python_keys():
        space: dict = {}
        exec((folder / "g/keys.py").read_text(), space)  # a file that this package has just made
        return space["SCORE_FINAL"], space["BY_NAME"]["score.ml"]

    def spoil():
        (folder / "g/keys.h").write_text("x")
        (folder / "g/keys.ts").unlink()
        return sorted(check())

    return {
        "made": made,
        "unchanged": check,
        "python": python_keys,
        "bindings parse": lambda: type(ast.parse((folder / "g/nodes.pyi").read_text())).__name__,
        "typescript": lambda: "CAND_CANDIDATE_ID: { id: 1001" in (folder / "g/keys.ts").read_text(),
        "header": lambda: "kCount = 11" in (folder / "g/keys.h").read_text(),
        "spoilt": spoil,
    }


@table(
    {
        'static writes': "{'kind': 'static', 'keys': ['cand.candidate_id', 'score.base']}",
        'derived writes': "{'kind': 'param_derived', 'param': 'output_key_id'}",
        'module': "[('py:m.py@1', ['score.ml'])]",
        'warnings': '1',
        'sorted': 'True',
        'yaml': 'a:\n  - b: 1\n    c:\n      d: []\ne: "x"\n',
        'twice': 'NodeError: Operator registered twice: core:model',
        'namespace': 'NodeError',
    }
)
def catalog_of_modules(folder):
    (folder / "m.py").write_text("META = {'name': 'm', 'version': '1', 'writes': [3002]}\ndef run_batch(b, c, p): pass\n")
    (folder / "broken.py").write_text("META = 1")
    doc = catalog.export(modules=folder)
    by = {n["op"]: n for n in doc["nodes"]}
    return {
        "static writes": lambda: by["core:sourcer"]["writes"],
        "derived writes": lambda: by["core:score_formula"]["writes"],
        "module": lambda: [(n["op"].split("#")[0], n["writes"]["keys"]) for n in doc["nodes"] if n["namespace"] == "py.m"],
        "warnings": lambda: len(doc["warnings"]),
        "sorted": lambda: [n["namespace"] for n in doc["nodes"]] == sorted(n["namespace"] for n in doc["nodes"]),
        "yaml": lambda: catalog.to_yaml({"a": [{"b": 1, "c": {"d": []}}], "e": "x"}),
        "twice": lambda: Operators([by_ := default_operators().get("core:model"), by_]),
        "namespace": lambda: outcome(lambda: NodeSpec("ext:x", "ext.x", None, stability="experimental")).split(":")[0],
    }


# -- policies, CSV, user modules -----------------------------------------------------------


@table(
    {
        'folder': "('d', 'njs/assets/csv')",
        'a 2': 'True',
        'a 1': 'False',
        'b 1': 'True',
        'c ': 'False',
        'z ': 'False',
        'none': 'False',
        'not json': 'JSONDecodeError',
        'path a/b.csv': 'a/b.csv',
        'path ../x': 'IoError: Path traversal not allowed: ../x',
        'path /etc/passwd': 'IoError: Absolute paths not allowed: /etc/passwd',
        'path \\x': 'IoError: Absolute paths not allowed: \\x',
        'path a\\b': 'IoError: Backslash not allowed in path: a\\b',
    }
)
def policies(folder):
    p = Policy.from_json(json.dumps({"csv_assets_dir": "d", "modules": [{"name": "a", "version": "2", "allow_io_csv_read": True}, {"name": "b", "allow_io_csv_read": True}, {"name": "b", "version": "1"}, {"name": "c"}]}))
    return {
        "folder": lambda: (p.assets_dir, Policy().assets_dir),
        **{f"{n} {v}": lambda n=n, v=v: p.allows_csv(n, v) for n, v in (("a", "2"), ("a", "1"), ("b", "1"), ("c", ""), ("z", ""))},
        "none": lambda: Policy().allows_csv("a"),
        "not json": lambda: outcome(lambda: Policy.from_json("{")).split(":")[0],
        **{f"path {r}": lambda r=r: check_resource(r) for r in ("a/b.csv", "../x", "/etc/passwd", "\\x", "a\\b")},
    }


@table(
    {
        'sample': "{'columns': {'id': ['1', '2', '3'], 'name': ['apple', 'banana', 'cherry'], 'score': ['0.9', '0.8', '0.7']}, 'rowCount': 3}",
        'odd': '{\'columns\': {\'a\': [\'3\', \'\', \'\', \'7"\'], \'b\': [\'2\', \'\', \'\', \'"6\']}, \'rowCount\': 4}',
        'bytes': 'IoError: IO budget exceeded: max_io_read_bytes',
        'rows': 'IoError: IO budget exceeded: max_io_read_rows',
        'no budget': 'IoError: IO budget not configured (max_io_read_bytes/rows = 0)',
        'missing': 'FileNotFoundError',
    }
)
def csv_assets(folder):
    (folder / "sample.csv").write_text("id,name,score\n1,apple,0.9\n2,banana,0.8\n3,cherry,0.7\n")
    (folder / "odd.csv").write_text('a, b ,a\n1,2,3\n\n4\n5,"6,7",8,9\n')
    read = lambda name, *budget: lambda: read_csv(str(folder), name, IoBudget(*budget))
    return {
        "sample": read("sample.csv", 1000, 10),
        "odd": read("odd.csv", 1000, 10),
        "bytes": read("sample.csv", 20, 10),
        "rows": read("sample.csv", 1000, 2),
        "no budget": read("sample.csv"),
        "missing": lambda: outcome(read("none.csv", 1, 1)).split(":")[0],
    }


@table(
    {
        'read': '(100, 4950.0, 99)',
        'read of another type': 'None',
        'read of an absent column': 'None',
        'undeclared read': 'ModuleError: Read of key 3002 (score.ml) not allowed - not in meta.reads',
        'undeclared read of an absent column': 'ModuleError: Read of key 3003 (score.adjusted) not allowed - not in meta.reads',
        'undeclared write': 'ModuleError: Write to key 3003 (score.adjusted) not allowed - not in meta.writes',
        'unknown key': 'ModuleError: Unknown key: 7777',
        'write of another type': 'ModuleError: Type mismatch for key 3002 (score.ml): expected i64, got f32',
        'zeros at first': '0.0',
        'integers': 'int64',
        'vectors': '(100, 4)',
        'cells': 'ModuleError: Budget exceeded: max_write_cells (250)',
        'bytes': 'ModuleError: Budget exceeded: max_write_bytes (2000)',
        'keys': "(3002, 'f32')",
        'no IO without a capability': 'False',
        'file': 'py:/m.py@2',
        'no file': 'FileNotFoundError',
        'no META': 'ModuleError: Module must export META',
        'no run_batch': 'ModuleError: Module must export run_batch',
        'scope': "ModuleError: scope must be 'row' or 'batch', not 'all'",
        'endless': 'ModuleError: module execution exceeded 0.2 s',
    }
)
def module_rules(folder):
    budget = {"max_write_cells": 250, "max_write_bytes": 2000}
    rows = pd.DataFrame({"score_base": np.arange(100, dtype="f4"), "score_ml": np.zeros(100, "f4"), "cand_candidate_id": np.arange(100)})

    def of(do, **more):
        def call():
            seen = []
            run_on(make_module({"name": "m", "reads": [3001, 1001, 2002], "writes": [3002, 7777, 2002, 1001], "budget": budget, **more}, lambda b, c, p: seen.append(do(b, c))), rows, REGISTRY, None, {})
            return seen[0]

        return call

    (folder / "m.py").write_text("META = {'name': 'm', 'version': '2', 'reads': [3001], 'writes': [3002]}\ndef run_batch(b, c, p): pass\n")
    return {
        "read": of(lambda b, c: (b.row_count(), float(b.f32(3001).sum()), int(b.i64(1001)[-1]))),
        "read of another type": of(lambda b, c: b.i64(3001)),
        "read of an absent column": of(lambda b, c: b.f32vec(2002)),
        "undeclared read": of(lambda b, c: b.f32(3002)),
        "undeclared read of an absent column": of(lambda b, c: b.f32(3003)),
        "undeclared write": of(lambda b, c: b.write_f32(3003)),
        "unknown key": of(lambda b, c: b.write_f32(7777)),
        "write of another type": of(lambda b, c: b.write_i64(3002)),
        "zeros at first": of(lambda b, c: float(b.write_f32(3002).sum())),
        "integers": of(lambda b, c: b.write_i64(1001).dtype),
        "vectors": of(lambda b, c: b.write_f32vec(2002, 4).shape),
        "cells": of(lambda b, c: [b.write_f32(3002) for _ in range(3)]),
        "bytes": of(lambda b, c: b.write_f32vec(2002, 100)),
        "keys": of(lambda b, c: (c.keys.SCORE_ML, c.key_info.SCORE_ML["type"])),
        "no IO without a capability": of(lambda b, c: hasattr(c, "io")),
        "file": lambda: load_module(folder / "m.py").op.partition("#")[0].replace(str(folder), ""),
        "no file": lambda: outcome(lambda: load_module(folder / "none.py")).split(":")[0],
        "no META": lambda: make_module(None, print),
        "no run_batch": lambda: make_module({"name": "x"}, None),
        "scope": lambda: make_module({"name": "x", "scope": "all"}, print),
        "endless": of(lambda b, c: [None for _ in iter(int, 1)], time_limit_s=0.2),
    }
