"""Plans: parsing, compilation, complexity, execution, tracing, the gate and the builder."""

import json

import pytest
from pyspark.sql import functions as F

from ranklume.functions import E
from ranklume.keys import POSITION
from ranklume.operators import Context, NodeError, NodeSpec, default_operators
from ranklume.plans import Budget, CompileError, Pipeline, PlanError, check_budget, compile_plan, execute, load_plan, measure, parse_plan, score
from ranklume.plans.executor import sample_dump
from ranklume.plans.gate import Limits, check_source, load_plan_file
from ranklume.plans.plan import trace_key_problem
from ranklume.plans.trace import Tracer, module_prefix, prefixed_key, span_name
from ranklume.queries import COMPLEX_PLAN


def nodes(*items):
    return {"nodes": [{"id": i, "op": op, "inputs": list(inputs)} for i, op, *inputs in items]}


def linear(n):
    return nodes(("n0", "core:sourcer"), *((f"n{i}", "core:features", f"n{i - 1}") for i in range(1, n)))


# -- parsing -------------------------------------------------------------------


def test_defaults_and_full_plan():
    p = parse_plan({"nodes": []})
    assert (p.name, p.version, p.env, p.sample_rate, p.dump_keys) == ("unnamed", 1, "dev", 0.0, ())
    doc = {"name": "x", "version": 2, "meta": {"env": "prod"}, "nodes": [{"id": "a", "op": "core:sourcer", "params": {"k": 3}, "trace_key": "t/1"}, {"id": "b", "op": "core:model", "inputs": ["a"]}], "logging": {"sample_rate": 0.5, "dump_keys": [3001]}}
    p = parse_plan(json.dumps(doc))
    assert p.nodes[0].params == {"k": 3} and p.nodes[1].inputs == ("a",) and p.dump_keys == (3001,)
    assert parse_plan(p.to_json()) == p


@pytest.mark.parametrize("bad", ["{", "[]", {"version": "2"}, {"version": True}, {"nodes": {}}, {"nodes": [{"op": "x"}]}, {"nodes": [{"id": "a"}]}, {"nodes": [{"id": 1, "op": "x"}]}, {"nodes": [{"id": "a", "op": "x", "inputs": "b"}]}, {"nodes": [3]}])
def test_parse_errors(bad):
    with pytest.raises(PlanError, match="parse error"):
        parse_plan(bad)


def test_environments():
    for env in ("prod", "dev", "test"):
        assert parse_plan({"meta": {"env": env}}).env == env
    for env in ("Prod", "PROD", "production", "staging", ""):
        with pytest.raises(PlanError, match="Must be one of"):
            parse_plan({"meta": {"env": env}})


def test_trace_keys():
    for fine in ("", "a" * 64, "A-z_0.9/x"):
        assert trace_key_problem(fine) is None
    for bad in ("a" * 65, "a b", "a@b", "a:b"):
        assert trace_key_problem(bad)
        with pytest.raises(PlanError, match="Node 'n'"):
            parse_plan({"nodes": [{"id": "n", "op": "core:model", "trace_key": bad}]})


def test_load_plan(tmp_path):
    with pytest.raises(PlanError, match="Failed to open"):
        load_plan(tmp_path / "none.json")
    (tmp_path / "p.json").write_text('{"name": "f", "nodes": []}')
    assert load_plan(tmp_path / "p.json").name == "f"


# -- compilation -----------------------------------------------------------------


@pytest.mark.parametrize(
    "doc,message",
    [
        (nodes(("a", "core:sourcer"), ("a", "core:model", "a")), "Duplicate"),
        (nodes(("a", "core:model", "b"), ("b", "core:model", "a")), "cycle"),
        (nodes(("a", "core:model", "zzz")), "unknown input"),
        (nodes(("a", "what:ever")), "Unknown op"),
        (nodes(("a", "core:nothing")), "Unknown op"),
        (nodes(("a", "core:sourcer"), ("b", "core:sourcer"), ("c", "core:model", "a", "b")), "takes one input"),
        # ids come before order, order before operators
        (nodes(("a", "what:ever", "a"), ("a", "core:model")), "Duplicate"),
        (nodes(("a", "what:ever", "a")), "cycle"),
    ],
)
def test_compile_errors(doc, message):
    with pytest.raises(CompileError, match=message):
        compile_plan(parse_plan(doc))


def test_loose_compilation():
    loose = lambda d: compile_plan(parse_plan(d), strict=False)
    assert loose(nodes(("a", "js:mod"))).order == ("a",)
    assert loose(nodes(("a", "core:anything"))).order == ("a",)
    with pytest.raises(CompileError, match="cycle"):
        loose(nodes(("a", "core:model", "zzz")))


def test_experimental_nodes_are_kept_from_production():
    ops = default_operators()
    ops.register(NodeSpec("ext:new", "experimental.new", lambda c, i, p: i[0], stability="experimental"))
    doc = nodes(("a", "core:sourcer"), ("b", "ext:new", "a"))
    for env in ("dev", "test"):
        compile_plan(parse_plan(doc | {"meta": {"env": env}}), ops)
    with pytest.raises(CompileError, match="stability=experimental"):
        compile_plan(parse_plan(doc | {"meta": {"env": "prod"}}), ops)


def test_order_and_result():
    c = compile_plan(parse_plan(nodes(("z", "core:model", "a"), ("a", "core:sourcer"), ("b", "core:sourcer"), ("y", "core:model", "b"))))
    assert c.order == ("a", "b", "z", "y") and c.result == "y"
    assert any("nobody's input" in w for w in c.warnings)


# -- complexity --------------------------------------------------------------------


def test_metrics():
    m = measure(parse_plan(COMPLEX_PLAN))
    assert (m.node_count, m.edge_count, m.max_depth, m.fanout_peak, m.fanin_peak, score(m)) == (8, 9, 5, 3, 3, 49)
    assert m.top_fanout[0] == ("s", "core:sourcer", 3) and m.top_fanin[0][0] == "merge" and m.longest_path[-1] == "final"
    m = measure(parse_plan(linear(5)))
    assert (m.edge_count, m.max_depth, m.longest_path) == (4, 5, tuple(f"n{i}" for i in range(5)))
    assert score(measure(parse_plan(linear(10)))) == 68
    out = measure(parse_plan(nodes(("s", "core:sourcer"), *((f"x{i}", "core:model", "s") for i in range(10)))))
    assert (out.node_count, out.edge_count, out.max_depth, out.fanout_peak) == (11, 10, 2, 10)
    fan_in = measure(parse_plan(nodes(*((f"x{i}", "core:sourcer") for i in range(8)), ("m", "core:merge", *(f"x{i}" for i in range(8))))))
    assert (fan_in.node_count, fan_in.fanin_peak) == (9, 8)
    # an input named before its node is declared counts
    assert measure(parse_plan(nodes(("b", "core:model", "a"), ("a", "core:sourcer")))).fanout_peak == 1
    assert measure(parse_plan({"nodes": []})).max_depth == 0


def test_budgets():
    m = measure(parse_plan(linear(10)))
    assert check_budget(m, Budget(node_count=10)).passed and check_budget(m, Budget(node_count=0)).passed
    v = check_budget(m, Budget(node_count=9, max_depth=3))
    assert not v.passed and v.error_code == "PLAN_TOO_COMPLEX" and v.violations == ("node_count=10 (hard_limit=9)", "max_depth=10 (hard_limit=3)")
    for text in ("PLAN_TOO_COMPLEX:", "node_count=10 (hard_limit=9)", "edge_count=9 (soft_limit=10000)", "Top fanout nodes:", "n0 core:sourcer fanout=1", "Top fanin nodes:", "Longest path (len=10):", "-> ... -> n9", "Hint:"):
        assert text in v.diagnostics
    soft = check_budget(m, Budget(edge_count=3, complexity_score=67))
    assert soft.passed and soft.warnings == ("edge_count=9 (soft_limit=3)", "complexity_score=68 (soft_limit=67)")
    b = Budget.of({"hard": {"node_count": 7}, "score_weights": {"edge_count": 2.0}})
    assert (b.node_count, b.max_depth, b.weights.edge_count, b.weights.max_depth) == (7, 120, 2.0, 5.0)
    with pytest.raises(CompileError, match="PLAN_TOO_COMPLEX"):
        compile_plan(parse_plan(linear(121)))
    assert len(compile_plan(parse_plan(linear(121)), budget=None).order) == 121


# -- execution -----------------------------------------------------------------------


def full_plan():
    p = Pipeline("demo")
    return p.core.sourcer(k=20).core.features(keys=[2001]).core.model(name="m").core.score_formula(expr=0.7 * E.signal(3001) + 0.3 * E.signal(3002)).ext.topk(k=5)


def test_execute_end_to_end(spark):
    df = execute(compile_plan(full_plan().plan()), Context(spark))
    got = [(r["cand_candidate_id"], round(r["score_final"], 4)) for r in df.orderBy(POSITION).collect()]
    want = sorted(((i + 1, round(0.7 * (1 - i / 20) + 0.3 * (0.6 * (1 - i / 20) + 0.4 * (i + 1) / 100), 4)) for i in range(20)), key=lambda x: -x[1])[:5]
    assert got == [(i, pytest.approx(s, abs=2e-4)) for i, s in want]


def test_first_input_only_when_loose(spark):
    doc = parse_plan({"nodes": [{"id": "a", "op": "core:sourcer", "params": {"k": 3}}, {"id": "b", "op": "core:sourcer", "params": {"k": 5}}, {"id": "m", "op": "core:merge", "inputs": ["a", "b"]}]})
    assert execute(compile_plan(doc), Context(spark)).count() == 5
    assert execute(compile_plan(doc), Context(spark, strict=False)).count() == 3


def test_nodes_without_input_get_an_empty_batch(spark):
    doc = parse_plan({"nodes": [{"id": "f", "op": "core:features", "params": {"keys": [2001]}}]})
    assert execute(compile_plan(doc), Context(spark)).count() == 0
    assert execute(compile_plan(parse_plan({"nodes": []})), Context(spark)).count() == 0
    with pytest.raises(NodeError, match="No operator"):
        execute(compile_plan(parse_plan(nodes(("a", "js:x"))), strict=False), Context(spark))


def test_deep_plan(spark):
    p = Pipeline()
    s = p.core.sourcer(k=3)
    for i in range(60):
        s = s.core.score_formula(expr=E.signal(3999 if i else 3001) + 1)
    assert [r[0] for r in execute(compile_plan(s.plan()), Context(spark)).orderBy(POSITION).select("score_final").collect()][0] == 61.0


def test_tracing(spark):
    lines = []
    for mode in ("off", "build", "observe", "materialize"):
        lines.clear()
        tracer = Tracer(mode, lines.append)
        df = execute(compile_plan(full_plan().plan()), Context(spark), tracer=tracer)
        assert df.count() == 5
        events = [json.loads(x) for x in lines]
        assert len(events) == (0 if mode == "off" else 10)
        if mode == "observe":
            assert tracer.counts()["topk_5"] == 5
        if mode == "materialize":
            assert [e["rows_out"] for e in events if e["event"] == "node_end"] == [20, 20, 20, 20, 5]
        tracer.release()
    bad = Pipeline().core.sourcer(k="x", trace_key="src", id="s")
    lines.clear()
    with pytest.raises(NodeError):
        execute(compile_plan(bad.plan()), Context(spark), tracer=Tracer("build", lines.append))
    end = json.loads(lines[-1])
    assert end["span_name"] == "core:sourcer(src)" and "integer" in end["error"] and end["duration_ms"] >= 0
    with pytest.raises(ValueError):
        Tracer("loud")


def test_span_helpers():
    assert span_name("core:merge") == "core:merge" and span_name("core:merge", "k") == "core:merge(k)"
    assert (prefixed_key("", "c"), prefixed_key("p", ""), prefixed_key("p", "c")) == ("c", "p", "p::c")
    assert [module_prefix(x) for x in ("", "a/b/rank.py", r"a\b\rank.v2.py", "noext", ".hidden")] == ["", "rank", "rank.v2", "noext", ".hidden"]


def test_sample_dump(spark):
    p = Pipeline("d", sample_rate=1.0, dump_keys=(3001, 3002))
    c = compile_plan(p.core.sourcer(k=6).plan())
    assert sample_dump(execute(c, Context(spark)), c, Context(spark)).columns == [POSITION, "score_base"]


def test_keep_shared(spark):
    p = Pipeline()
    m = p.core.sourcer(k=6).core.merge()
    step = m.core.features(keys=[2001]).core.merge(m.core.model())
    df = execute(compile_plan(step.plan()), Context(spark), keep_shared=True)
    assert df.count() == 6
    spark.catalog.clearCache()


# -- the gate ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source,code",
    [
        ("import os", "E_IMPORT_STATEMENT"), ("from x import y", "E_IMPORT_STATEMENT"), ("__all__ = ['x']", "E_EXPORT_STATEMENT"), ("require('fs')", "E_REQUIRE_CALL"), ("__import__('os')", "E_DYNAMIC_IMPORT"), ("eval('1')", "E_EVAL_CALL"),
        ("exec('1')", "E_EVAL_CALL"), ("compile('1', '', 'eval')", "E_FUNCTION_CONSTRUCTOR"), ("for i in []: pass", "E_LOOP_STATEMENT"), ("while True: pass", "E_LOOP_STATEMENT"), ("x = [i for i in y]", "E_LOOP_STATEMENT"),
        ("class A: pass", "E_CLASS_DECLARATION"), ("def f():\n  yield 1", "E_GENERATOR_FUNCTION"), ("async def f(): pass", "E_ASYNC_FUNCTION"), ("with x: pass", "E_WITH_STATEMENT"), ("f = lambda: 1", "E_ARROW_OUTSIDE_EXPR"), ("process.exit()", "E_DISALLOWED_GLOBAL"),
        ("a.process", "E_DISALLOWED_GLOBAL"), ("open('x')", "E_DISALLOWED_GLOBAL"), ("x = (", "E_PARSE_ERROR"), ("x = 1\n" * 201, "E_TOO_MANY_STATEMENTS"), ("if a:\n  b = 1\n" * 51, "E_TOO_MANY_BRANCHES"), ("#" * 50_001, "E_FILE_TOO_LARGE"), ("x = " + "f(" * 11 + ")" * 11, "E_NESTING_TOO_DEEP"),
    ],
)
def test_gate_codes(source, code):
    assert code in check_source(source).codes


def test_gate_details():
    assert sorted(check_source("require('x')").codes) == ["E_DISALLOWED_GLOBAL", "E_REQUIRE_CALL"]
    assert check_source("x = dsl.expr(lambda: process)").ok
    assert check_source("for i in []:\n  import os").codes == ["E_LOOP_STATEMENT"]
    r = check_source("x = 1\nif x:\n  y = f(g(x))\nz = 1 if x else 2\nmatch x:\n  case 1:\n    pass\n  case 2:\n    pass")
    assert r.ok and (r.statements, r.branches, r.nesting) == (5, 4, 3)
    assert check_source("x = 1\ny = 2", Limits(statements=1)).codes == ["E_TOO_MANY_STATEMENTS"]
    f = check_source("x = 1\nimport os").findings[0]
    assert (f.line, f.column) == (2, 0)


def test_plan_files(tmp_path, spark):
    good = tmp_path / "a.plan.py"
    good.write_text("p = Pipeline('from_file')\nplan = p.core.sourcer(k=4).core.score_formula(expr=dsl.expr(lambda: E.signal(3001) * 2))\n")
    plan = load_plan_file(str(good))
    assert plan.name == "from_file"
    assert execute(compile_plan(plan), Context(spark)).agg(F.max("score_final")).collect()[0][0] == 2.0
    bad = tmp_path / "b.plan.py"
    bad.write_text("import os")
    with pytest.raises(ValueError, match="E_IMPORT_STATEMENT"):
        load_plan_file(str(bad))


def test_builder():
    p = Pipeline("b", env="test")
    a, c = p.core.sourcer(k=1, id="src"), p.core.sourcer(k=2, trace_key="two")
    m = a.core.merge(c, dedup="first")
    plan = m.plan()
    assert [n.id for n in plan.nodes] == ["src", "sourcer_2", "merge_3"] and plan.nodes[2].inputs == ("src", "sourcer_2") and plan.nodes[1].trace_key == "two" and plan.env == "test"
    with pytest.raises(AttributeError):
        p.core.nothing
