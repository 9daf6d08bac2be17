"""Checks a plan as a whole and orders its nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.base import Operators, default_operators
from .complexity import Budget, Metrics, check_budget, measure, order
from .plan import Plan

PREFIXES = ("core:", "ext:", "py:")


class CompileError(ValueError):
    pass


@dataclass(frozen=True)
class CompiledPlan:
    plan: Plan
    order: tuple[str, ...]
    metrics: Metrics
    warnings: tuple[str, ...] = field(default=())

    @property
    def result(self) -> str | None:
        """The node whose output is the plan's: the last in order."""
        return self.order[-1] if self.order else None


def compile_plan(plan: Plan, operators: Operators | None = None, budget: Budget | None = Budget(), strict: bool = True, warn: Callable[[str], None] = lambda m: None) -> CompiledPlan:
    """Checks in this order: ids, order, operators, environment, complexity; the first failure is raised.

    Without ``strict``, operators are checked by prefix only and dangling inputs
    are told as a cycle.  ``budget`` of None skips the complexity check.
    """
    operators = operators or default_operators()
    seen: set[str] = set()
    for n in plan.nodes:
        if n.id in seen:
            raise CompileError(f"Duplicate node ID: {n.id}")
        seen.add(n.id)
    if strict:
        for n in plan.nodes:
            for i in n.inputs:
                if i not in seen:
                    raise CompileError(f"Node '{n.id}' has an unknown input: {i}")
    ready = order(plan.nodes)
    if len(ready) < len(plan.nodes):
        raise CompileError("Plan contains a cycle")
    for n in plan.nodes:
        if not (operators.has(n.op) if strict else n.op.startswith((*PREFIXES, "js:"))):
            raise CompileError(f"Unknown op type: {n.op}")
    if plan.env == "prod":
        for n in plan.nodes:
            spec = operators.get(n.op)
            if spec and spec.stability == "experimental":
                raise CompileError(f"Production plans cannot use experimental nodes. Node '{n.id}' (op: '{n.op}', namespace: '{spec.namespace}') has stability=experimental.")
    metrics = measure(plan)
    warnings: list[str] = []
    if budget is not None:
        verdict = check_budget(metrics, budget)
        if not verdict.passed:
            raise CompileError(verdict.diagnostics)
        warnings += verdict.warnings
    used = {i for n in plan.nodes for i in n.inputs}
    if len(sinks := [n.id for n in plan.nodes if n.id not in used]) > 1:
        warnings.append(f"{len(sinks)} nodes are nobody's input ({', '.join(sinks)}); the result is that of {ready[-1]}")
    if strict:
        for n in plan.nodes:
            spec = operators.get(n.op)
            if len(n.inputs) > 1 and not spec.many_inputs:
                raise CompileError(f"Node '{n.id}': {n.op} takes one input")
            if not n.inputs and not spec.source and spec.op.startswith("core:") and spec.op != "core:merge":
                warnings.append(f"node '{n.id}' has no input and gets an empty batch")
    for w in warnings:
        warn(w)
    return CompiledPlan(plan, tuple(ready), metrics, tuple(warnings))
