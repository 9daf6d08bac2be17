"""Command line: run, validate, codegen, nodes.

Exit status 1 on any error.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import catalog, codegen
from .keys import KeyRegistry
from .operators.base import Context
from .plans import Budget, compile_plan, execute, load_plan, measure, score
from .plans.gate import check_source, load_plan_file
from .plans.trace import MODES, Tracer
from .sources import Policy, lines


def _plan(path: str):
    return load_plan_file(path) if path.endswith(".py") else load_plan(path)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ranklume", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="execute a plan and print its rows")
    run.add_argument("plan")
    run.add_argument("-k", "--keys")
    run.add_argument("-b", "--budget")
    run.add_argument("-n", "--dump-top", type=int, default=0)
    run.add_argument("-q", "--quiet", action="store_true")
    run.add_argument("-p", "--policy")
    run.add_argument("-t", "--table", action="append", default=[], help="name=path of a Parquet table")
    run.add_argument("--trace", choices=MODES, default="off")
    run.add_argument("--no-complexity-check", action="store_true")
    check = sub.add_parser("validate", help="check plans: gate, compilation, complexity")
    check.add_argument("plans", nargs="+")
    check.add_argument("-b", "--budget")
    check.add_argument("--json", action="store_true")
    gen = sub.add_parser("codegen", help="write generated files, or check that they are fresh")
    gen.add_argument("-k", "--keys")
    gen.add_argument("-o", "--out", required=True)
    gen.add_argument("--check", action="store_true")
    nodes = sub.add_parser("nodes", help="the node catalog")
    nodes.add_argument("action", choices=("export", "codegen", "graduate"))
    nodes.add_argument("-m", "--modules")
    nodes.add_argument("--format", choices=("yaml", "json"), default="yaml")
    return p


def _run(a) -> int:
    from pyspark.sql import SparkSession

    registry = KeyRegistry.load(a.keys) if a.keys else KeyRegistry.default()
    budget = None if a.no_complexity_check else Budget.load(a.budget) if a.budget else Budget()
    compiled = compile_plan(_plan(a.plan), budget=budget, warn=lambda m: print(f"warning: {m}", file=sys.stderr))
    spark = SparkSession.builder.appName("ranklume").getOrCreate()
    tables = dict(t.split("=", 1) for t in a.table)
    ctx = Context(spark, registry, tables={n: spark.read.parquet(p) for n, p in tables.items()}, policy=Policy.load(a.policy) if a.policy else None, warn=lambda m: print(f"warning: {m}", file=sys.stderr))
    tracer = Tracer(a.trace)
    result = execute(compiled, ctx, tracer=tracer)
    if not a.quiet:
        for line in lines(result, registry, a.dump_top):
            print(line)
    tracer.release()
    return 0


def _validate(a) -> int:
    budget, bad = Budget.load(a.budget) if a.budget else Budget(), 0
    for path in a.plans:
        try:
            if path.endswith(".py"):
                with open(path, encoding="utf-8") as f:
                    report = check_source(f.read())
                if not report.ok:
                    raise ValueError("\n".join(f"{x.line or 0}: {x.code}: {x.message}" for x in report.findings))
            plan = _plan(path)
            compiled = compile_plan(plan, budget=budget)
            m = measure(plan)
            facts = {"nodes": m.node_count, "edges": m.edge_count, "depth": m.max_depth, "fanout": m.fanout_peak, "fanin": m.fanin_peak, "score": score(m, budget.weights), "warnings": list(compiled.warnings)}
            print(json.dumps({"plan": path, "ok": True, **facts}) if a.json else f"{path}: ok {facts}")
        except (ValueError, OSError) as e:
            bad += 1
            print(json.dumps({"plan": path, "ok": False, "error": str(e)}) if a.json else f"{path}: {e}")
    return int(bad > 0)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "run":
            return _run(a)
        if a.command == "validate":
            return _validate(a)
        if a.command == "codegen":
            off = codegen.generate(KeyRegistry.load(a.keys) if a.keys else KeyRegistry.default(), a.out, a.check)
            print("\n".join(off))
            return int(bool(off))
        if a.action == "graduate":
            print("graduation is a change of the operator's registration: move its namespace out of experimental.*", file=sys.stderr)
            return 1
        if a.action == "codegen":
            print(codegen.bindings_python())
            return 0
        document = catalog.export(modules=a.modules)
        print(catalog.to_yaml(document) if a.format == "yaml" else json.dumps(document, indent=2))
        return 0
    except (ValueError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
