"""Expression trees as Catalyst columns, in 32-bit float arithmetic.

Which columns exist, and their types, is known from the schema, so a missing or
ill-typed signal is a constant in the plan.  Division and square roots are made
in double and narrowed, which rounds like 32-bit hardware does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..keys import Key, KeyRegistry


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def less(x: Column, y: Column) -> Column:
    """IEEE less-than: false if either side is not a number."""
    return ~F.isnan(x) & ~F.isnan(y) & (x < y)


def signal(schema: T.StructType, key: Key | None) -> Column:
    """The key's value as a float; 0 for nulls, missing columns and types that aren't numbers."""
    if key is None or key.column not in schema.names:
        return f32(0.0)
    kind = schema[key.column].dataType
    if isinstance(kind, T.FloatType):
        return F.coalesce(F.col(key.column), f32(0.0))
    if isinstance(kind, T.LongType):
        return F.coalesce(F.col(key.column).cast("float"), f32(0.0))
    return f32(0.0)


def vector(schema: T.StructType, registry: KeyRegistry, tree: dict) -> Column | None:
    key = registry.by_id(tree["key_id"]) if tree["op"] == "signal" else None
    if key is None or key.column not in schema.names:
        return None
    kind = schema[key.column].dataType
    return F.col(key.column) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else None


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of float arrays, accumulated in order; 0 where it isn't defined."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), f32(0.0), lambda s, v: (s + v).cast("float"))
    dot, aa, bb = total(a, b), total(a, a), total(b, b)
    norm = (f32(F.sqrt(aa)) * f32(F.sqrt(bb))).cast("float")
    # evaluated once a row: the sums are bound by a one-element transform
    parts = F.array(F.struct(dot.alias("d"), norm.alias("n")))
    ratio = F.transform(parts, lambda p: F.when(p["n"] > 0, clamp(f32(F.try_divide(p["d"], p["n"])), f32(-1.0), f32(1.0))).otherwise(f32(0.0)))[0]
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(fits, ratio), f32(0.0))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(less(x, lo), lo).when(less(hi, x), hi).otherwise(x)


def bound(value: Column, then: Callable[[Column], Column], simple: bool = False) -> Column:
    """``then(value)`` with the value evaluated once, however often ``then`` uses it."""
    return then(value) if simple else F.transform(F.array(value), then)[0]


def to_column(tree: dict, schema: T.StructType, registry: KeyRegistry) -> Column:
    """A valid tree (see :func:`~ranklume.functions.tree.parse`) as a float column."""
    op = tree["op"]
    if op == "const":
        return f32(tree["value"])
    if op == "signal":
        return signal(schema, registry.by_id(tree["key_id"]))
    if op == "penalty":
        return signal(schema, registry.by_name(f"penalty.{tree['name']}"))
    if op == "cos":
        a, b = (vector(schema, registry, tree[s]) for s in ("a", "b"))
        return f32(0.0) if a is None or b is None else cosine(a, b)
    if op == "clamp":
        x, lo, hi = (to_column(tree[s], schema, registry) for s in ("x", "lo", "hi"))
        simple = {s: tree[s]["op"] in ("const", "signal", "penalty") for s in ("x", "lo", "hi")}
        return bound(lo, lambda b: bound(hi, lambda c: bound(x, lambda a: clamp(a, b, c), simple["x"]), simple["hi"]), simple["lo"])
    args = [to_column(t, schema, registry) for t in tree["args"]]
    if op == "add":
        return reduce(lambda x, y: (x + y).cast("float"), args, f32(0.0))
    if op == "mul":
        return reduce(lambda x, y: (x * y).cast("float"), args, f32(1.0))
    if not args:
        return f32(0.0)
    wins = (lambda x, y: less(y, x)) if op == "min" else (lambda x, y: less(x, y))
    if len(args) == 2 and all(t["op"] in ("const", "signal", "penalty") for t in tree["args"]):
        return F.when(wins(*args), args[1]).otherwise(args[0])
    return F.aggregate(F.array(*args[1:]), args[0], lambda x, y: F.when(wins(x, y), y).otherwise(x))  # each argument once
