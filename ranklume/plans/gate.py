"""A static gate for plan files written in Python.

A plan file builds a pipeline from straight-line code.  The gate walks its
syntax tree and reports what such a file may not hold, and measures its size.
Lambdas are allowed only as the argument of ``dsl.expr``; their bodies, and the
bodies of loops and classes, which are errors already, aren't looked at.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field


# Limits, and the codes of errors.
@dataclass(frozen=True)
class Limits:
    file_size: int = 50_000
    nesting: int = 10
    branches: int = 50
    statements: int = 200


CODES = (
    "E_PARSE_ERROR", "E_IMPORT_STATEMENT", "E_EXPORT_STATEMENT", "E_REQUIRE_CALL", "E_DYNAMIC_IMPORT", "E_EVAL_CALL", "E_FUNCTION_CONSTRUCTOR", "E_LOOP_STATEMENT", "E_CLASS_DECLARATION",
    "E_GENERATOR_FUNCTION", "E_ASYNC_FUNCTION", "E_WITH_STATEMENT", "E_ARROW_OUTSIDE_EXPR", "E_DISALLOWED_GLOBAL", "E_FILE_TOO_LARGE", "E_NESTING_TOO_DEEP", "E_TOO_MANY_BRANCHES", "E_TOO_MANY_STATEMENTS",
)
GLOBALS = frozenset("require process fs fetch open input os sys subprocess socket shutil pathlib builtins globals locals vars breakpoint __file__ __builtins__ __loader__ module exports importlib".split())
CALLS = {"eval": "E_EVAL_CALL", "exec": "E_EVAL_CALL", "__import__": "E_DYNAMIC_IMPORT", "import_module": "E_DYNAMIC_IMPORT", "compile": "E_FUNCTION_CONSTRUCTOR", "FunctionType": "E_FUNCTION_CONSTRUCTOR", "require": "E_REQUIRE_CALL"}
EXPORTS = ("__all__",)


@dataclass(frozen=True)
class Finding:
    code: str
    message: str
    line: int | None = None
    column: int | None = None


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)
    file_size: int = 0
    statements: int = 0
    branches: int = 0
    nesting: int = 0

    @property
    def ok(self) -> bool:
        return not self.findings

    @property
    def codes(self) -> list[str]:
        return [f.code for f in self.findings]


class _Walker:
    def __init__(self, report: Report):
        self.report = report

    def say(self, node: ast.AST, code: str, message: str) -> None:
        self.report.findings.append(Finding(code, message, getattr(node, "lineno", None), getattr(node, "col_offset", None)))

    def each(self, node: ast.AST, depth: int, in_expr: bool = False) -> None:
        for child in ast.iter_child_nodes(node):
            self.walk(child, depth, in_expr)

    def walk(self, node: ast.AST, depth: int, in_expr: bool = False) -> None:
        r = self.report
        r.nesting = max(r.nesting, depth)
        match node:
            case ast.Import() | ast.ImportFrom():
                self.say(node, "E_IMPORT_STATEMENT", "import statements are not allowed in plan files")
            case ast.For() | ast.While() | ast.AsyncFor() | ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
                self.say(node, "E_LOOP_STATEMENT", f"{type(node).__name__} is not allowed in plan files")
            case ast.ClassDef():
                self.say(node, "E_CLASS_DECLARATION", "classes are not allowed in plan files")
            case ast.With() | ast.AsyncWith():
                self.say(node, "E_WITH_STATEMENT", "with statements are not allowed in plan files")
            case ast.AsyncFunctionDef():
                self.say(node, "E_ASYNC_FUNCTION", "async functions are not allowed in plan files")
                self.each(node, depth)
            case ast.FunctionDef():
                if any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)):
                    self.say(node, "E_GENERATOR_FUNCTION", "generator functions are not allowed in plan files")
                self.each(node, depth)
            case ast.Lambda():
                if not in_expr:
                    self.say(node, "E_ARROW_OUTSIDE_EXPR", "lambdas are only allowed inside dsl.expr()")
            case ast.Call(func=func):
                name = func.id if isinstance(func, ast.Name) else func.attr if isinstance(func, ast.Attribute) else ""
                if name in CALLS:
                    self.say(node, CALLS[name], f"{name}() is not allowed in plan files")
                self.each(node, depth + 1, isinstance(func, ast.Attribute) and name == "expr" and isinstance(func.value, ast.Name) and func.value.id == "dsl")
            case ast.If():
                r.branches += 1
                r.statements += 1
                self.each(node, depth + 1)
            case ast.IfExp():
                r.branches += 1
                self.each(node, depth + 1)
            case ast.Match():
                r.statements += 1
                r.branches += len(node.cases)
                self.each(node, depth + 1)
            case ast.Expr() | ast.Assign() | ast.AnnAssign() | ast.AugAssign() | ast.Return() | ast.Raise():
                r.statements += 1
                self.each(node, depth, in_expr)
            case ast.Name(id=name) | ast.Attribute(attr=name):
                if name in GLOBALS:
                    self.say(node, "E_DISALLOWED_GLOBAL", f"'{name}' is not allowed in plan files")
                if name in EXPORTS:
                    self.say(node, "E_EXPORT_STATEMENT", f"'{name}' is not allowed in plan files")
                self.each(node, depth, in_expr)
            case _:
                self.each(node, depth, in_expr)


def check_source(source: str, limits: Limits = Limits()) -> Report:
    """Everything that the gate finds in a plan file."""
    report = Report(file_size=len(source))
    if report.file_size > limits.file_size:
        report.findings.append(Finding("E_FILE_TOO_LARGE", f"File size {report.file_size} exceeds limit {limits.file_size}"))
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        report.findings.append(Finding("E_PARSE_ERROR", e.msg, e.lineno, e.offset))
        return report
    _Walker(report).each(tree, 0)
    for code, what, value, most in (("E_TOO_MANY_STATEMENTS", "Statement count", report.statements, limits.statements), ("E_TOO_MANY_BRANCHES", "Branch count", report.branches, limits.branches), ("E_NESTING_TOO_DEEP", "Nesting depth", report.nesting, limits.nesting)):
        if value > most:
            report.findings.append(Finding(code, f"{what} {value} exceeds limit {most}"))
    return report


def load_plan_file(path: str):
    """The plan that a gated plan file leaves in ``plan`` (a Plan, or a step of a pipeline)."""
    from pathlib import Path
    from types import SimpleNamespace

    from ..functions import E
    from .pipeline import Pipeline, Step

    source = Path(path).read_text(encoding="utf-8")
    report = check_source(source)
    if not report.ok:
        raise ValueError("\n".join(f"{path}:{f.line or 0}: {f.code}: {f.message}" for f in report.findings))
    space = {"__builtins__": {"min": min, "max": max, "len": len, "str": str, "int": int, "float": float, "dict": dict, "list": list, "tuple": tuple}, "Pipeline": Pipeline, "E": E, "dsl": SimpleNamespace(F=E, expr=lambda f: f())}
    exec(compile(source, path, "exec"), space)  # noqa: S102  gated, without builtins that do IO
    made = space.get("plan")
    return made.plan() if isinstance(made, Step) else made
