"""The expression tree as JSON: checks and walks."""

from __future__ import annotations

from collections.abc import Callable

# The operators and what each holds.
FOLDS = ("add", "mul", "min", "max")
OPS = ("const", "signal", *FOLDS, "cos", "clamp", "penalty")


class ExprError(ValueError):
    pass


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def problem(tree: object) -> str | None:
    """What is wrong with the top of a tree, its sub-trees aside."""
    if not isinstance(tree, dict) or not isinstance(tree.get("op"), str):
        return "expression must be an object with an 'op'"
    op = tree["op"]
    if op not in OPS:
        return f"Unknown expression op: {op}"
    need = {"const": ("value", _number, "a number"), "signal": ("key_id", lambda v: isinstance(v, int) and not isinstance(v, bool), "an integer"), "penalty": ("name", lambda v: isinstance(v, str), "a string")}
    if op in FOLDS:
        return None if isinstance(tree.get("args"), list) else f"{op}: 'args' must be a list"
    if op in need:
        field, fine, what = need[op]
        return None if fine(tree.get(field)) else f"{op}: '{field}' must be {what}"
    fields = ("a", "b") if op == "cos" else ("x", "lo", "hi")
    missing = [f for f in fields if f not in tree]
    return f"{op}: missing {', '.join(missing)}" if missing else None


def children(tree: dict) -> list:
    op = tree["op"]
    if op in FOLDS:
        return tree["args"]
    return [tree["a"], tree["b"]] if op == "cos" else [tree["x"], tree["lo"], tree["hi"]] if op == "clamp" else []


def is_expr(tree: object) -> bool:
    return problem(tree) is None and all(map(is_expr, children(tree)))


def parse(tree: object, strict: bool = True, report: Callable[[str], None] | None = None) -> dict:
    """A valid tree.  Unless strict, what can't be parsed becomes the constant 0 there, and is reported."""
    if (why := problem(tree)) is not None:
        if strict:
            raise ExprError(why)
        if report:
            report(why)
        return {"op": "const", "value": 0.0}
    out = dict(tree)
    for field in ("args",) if tree["op"] in FOLDS else ("a", "b") if tree["op"] == "cos" else ("x", "lo", "hi") if tree["op"] == "clamp" else ():
        out[field] = [parse(t, strict, report) for t in tree[field]] if field == "args" else parse(tree[field], strict, report)
    return out


def collect_key_ids(tree: object) -> set[int]:
    """Ids of the signals of a tree (penalties are looked up by name and aren't among them)."""
    if problem(tree) is not None:
        return set()
    if tree["op"] == "signal":
        return {tree["key_id"]}
    return set().union(*map(collect_key_ids, children(tree)), set())
