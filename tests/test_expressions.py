"""Expressions: the JSON tree, the builder, and compiled columns against a scalar model."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ranklume.functions import E, ExprError, collect_key_ids, is_expr, parse, to_column
from ranklume.keys import KeyRegistry

REG = KeyRegistry.default()
NAN, INF = float("nan"), float("inf")
f = np.float32


def model(tree, row):
    """The scalar semantics, in 32-bit floats."""
    op = tree["op"]
    with np.errstate(all="ignore"):
        if op == "const":
            return f(tree["value"])
        if op in ("signal", "penalty"):
            key = REG.by_id(tree["key_id"]) if op == "signal" else REG.by_name("penalty." + tree["name"])
            v = row.get(key.column) if key else None
            return f(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else f(0)
        if op == "clamp":
            x, lo, hi = (model(tree[k], row) for k in ("x", "lo", "hi"))
            return lo if x < lo else hi if hi < x else x
        args = [model(a, row) for a in tree["args"]]
        if op in ("add", "mul"):
            total = f(0 if op == "add" else 1)
            for a in args:
                total = f(total + a) if op == "add" else f(total * a)
            return total
        best = args[0] if args else f(0)
        for a in args[1:]:
            best = a if (a < best if op == "min" else best < a) else best
        return best


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def evaluate(spark, trees, rows, schema="score_base float, score_ml float, cand_candidate_id long, debug_node_timings string"):
    df = spark.createDataFrame(rows, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    got = df.select(*(to_column(t, df.schema, REG).alias(f"c{i}") for i, t in enumerate(trees))).collect()
    assert all(t == "float" for _, t in df.select(*(to_column(t, df.schema, REG).alias(f"c{i}") for i, t in enumerate(trees))).dtypes)
    return got, [dict(zip(names, r)) for r in rows]


ROWS = [(0.5, 0.25, 7, "x"), (NAN, 1.0, -3, None), (None, None, None, None), (INF, -INF, 2**40, ""), (-0.0, 0.0, 0, ""), (-1.5, 2.0, 1, "")]
b, m, c = E.signal(3001), E.signal(3002), E.signal(1001)
TREES = [
    E.const(42), b, c, E.signal(9001), E.signal(9999), E.signal(3003), E.add(1.5, 2.5), E.mul(3, 4), 0.7 * b + 0.3 * m, E.min(b, m), E.min(3, 1, 2), E.max(b, m, c), E.clamp(1.5, 0, 1), E.clamp(b, m, 1), E.clamp(b, 1, -1),
    E.neg(b), b - m, E.penalty("constraints"), E.penalty("none"), E.max(E.min(b, m), E.clamp(E.add(b, m), E.neg(1), E.mul(b, 2)), 0), {"op": "add", "args": []}, {"op": "mul", "args": []}, {"op": "min", "args": []}, {"op": "max", "args": [b]},
]


def test_columns_match_the_scalar_model(spark):
    got, rows = evaluate(spark, TREES, ROWS)
    for r, row in zip(got, rows):
        for i, t in enumerate(TREES):
            assert same(r[i], float(model(t, row))), (t, row, r[i])


def test_min_max_clamp_on_all_special_triples(spark):
    special = [NAN, INF, -INF, -1.0, -0.0, 0.0, 0.5, 2.0]
    rows = [(x, y, i, "") for i, (x, y) in enumerate(itertools.product(special, special))]
    trees = [t for z in special for t in (E.min(b, m, z), E.max(b, m, z), E.clamp(b, m, z))]
    got, dicts = evaluate(spark, trees, rows)
    for r, row in zip(got, dicts):
        for i, t in enumerate(trees):
            assert same(r[i], float(model(t, row))), (t, row)


leaf = st.one_of(st.floats(-4, 4, width=32).map(E.const), st.sampled_from([b, m, c]))
trees = st.recursive(leaf, lambda s: st.one_of(st.tuples(st.sampled_from(["add", "mul", "min", "max"]), st.lists(s, min_size=0, max_size=3)).map(lambda x: {"op": x[0], "args": x[1]}), st.tuples(s, s, s).map(lambda x: E.clamp(*x))), max_leaves=8)


@settings(max_examples=12, deadline=None)
@given(st.lists(trees, min_size=1, max_size=4))
def test_random_trees(spark, ts):
    got, rows = evaluate(spark, ts, ROWS)
    for r, row in zip(got, rows):
        for i, t in enumerate(ts):
            assert same(r[i], float(model(t, row))), (t, row, r[i])


def test_deep_trees_stay_small(spark):
    t = b
    for _ in range(12):
        t = E.clamp(E.max(t, 0.1, m), -1, E.min(t, 5)) if _ % 4 == 0 else E.clamp(E.add(t, 0.1), -3, 3)
    got, rows = evaluate(spark, [t], ROWS[:1])
    assert same(got[0][0], float(model(t, rows[0])))


def cosine(spark, a, v, schema="feat_embedding array<float>, feat_query_embedding array<float>"):
    df = spark.createDataFrame([(a, v)], schema)
    return df.select(to_column(E.cos(E.signal(2002), E.signal(2003)), df.schema, REG)).collect()[0][0]


def test_cosine(spark):
    assert cosine(spark, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]) == 1
    assert cosine(spark, [1.0, 0.0], [0.0, 1.0]) == 0
    assert cosine(spark, [1.0, 0.0], [-1.0, 0.0]) == -1
    assert cosine(spark, [0.0, 0.0], [1.0, 0.0]) == 0
    assert cosine(spark, [1.0], [1.0, 0.0]) == 0
    assert cosine(spark, None, [1.0, 0.0]) == 0
    assert cosine(spark, [], []) == 0
    df = spark.createDataFrame([(1.0,)], "score_base float")
    assert df.select(to_column(E.cos(E.signal(2002), b), df.schema, REG)).collect()[0][0] == 0
    assert df.select(to_column(E.cos(E.add(1, 2), b), df.schema, REG)).collect()[0][0] == 0


def test_cosine_is_sequential_float32(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=64).astype(f), rng.normal(size=64).astype(f)

    def dot(p, q):
        s = f(0)
        for u, v in zip(p, q):
            s = f(s + f(u * v))
        return s

    want = f(dot(x, y) / f(np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))))
    assert cosine(spark, x.tolist(), y.tolist()) == float(want)
    assert cosine(spark, x.tolist(), x.tolist()) <= 1


def test_builder_shapes():
    assert E.neg(b) == {"op": "mul", "args": [E.const(-1), b]}
    assert E.sub(b, m) == {"op": "add", "args": [b, {"op": "mul", "args": [E.const(-1), m]}]}
    assert E.cos_sim(b, m)["op"] == "cos" and E.signal(REG.resolve("score.ml")) == m
    assert (2 - b)["op"] == "add" and (-b) == E.neg(b)
    for fold in (E.add, E.mul, E.min, E.max):
        with pytest.raises(ExprError, match="at least 2"):
            fold(b)


def test_parse_and_checks():
    assert is_expr({"op": "add", "args": []}) and is_expr(E.clamp(b, 0, 1))
    for bad in (None, 3, {}, {"op": "div", "args": []}, {"op": "const"}, {"op": "const", "value": "x"}, {"op": "const", "value": True}, {"op": "signal", "key_id": 1.5}, {"op": "cos", "a": b}, {"op": "clamp", "x": b}, {"op": "penalty"}, {"op": "add", "args": 3}, {"op": "add", "args": [{"op": "?"}]}):
        assert not is_expr(bad)
        with pytest.raises(ExprError):
            parse(bad)
    said = []
    assert parse({"op": "add", "args": [b, {"op": "what"}]}, strict=False, report=said.append) == {"op": "add", "args": [b, {"op": "const", "value": 0.0}]}
    assert said == ["Unknown expression op: what"]
    assert collect_key_ids(E.add(b, E.cos(E.signal(2002), E.signal(2003)), E.clamp(m, b, E.penalty("x")))) == {3001, 3002, 2002, 2003}
