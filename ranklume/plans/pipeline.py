"""A fluent builder of plans: ``p.core.sourcer(k=10).core.model().ext.topk(k=3)``."""

from __future__ import annotations

from ..operators.base import Operators, default_operators
from .plan import Plan, PlanNode


class _Namespace:
    def __init__(self, step: Step, prefix: str):
        self._step, self._prefix = step, prefix

    def __getattr__(self, name: str):
        op = f"{self._prefix}:{name}"
        if not self._step.pipeline.operators.has(op):
            raise AttributeError(f"no operator {op}")
        return lambda *inputs, id=None, trace_key="", **params: self._step.pipeline.add(op, [*([self._step.node] if self._step.node else []), *(i.node for i in inputs)], params, id, trace_key)  # noqa: A002


class Step:
    """A node of a pipeline under construction; its namespaces add nodes that read it."""

    def __init__(self, pipeline: Pipeline, node: str | None):
        self.pipeline, self.node = pipeline, node

    @property
    def core(self) -> _Namespace:
        return _Namespace(self, "core")

    @property
    def ext(self) -> _Namespace:
        return _Namespace(self, "ext")

    @property
    def py(self) -> _Namespace:
        return _Namespace(self, "py")

    def plan(self) -> Plan:
        return self.pipeline.plan()


class Pipeline(Step):
    """The start of a pipeline; it has no node itself."""

    def __init__(self, name: str = "unnamed", env: str = "dev", operators: Operators | None = None, **logging):
        self.name, self.env, self.logging = name, env, logging
        self.operators = operators or default_operators()
        self.nodes: list[PlanNode] = []
        super().__init__(self, None)

    def add(self, op: str, inputs: list[str], params: dict, node_id: str | None, trace_key: str) -> Step:
        node_id = node_id or f"{op.partition(':')[2]}_{len(self.nodes) + 1}"
        self.nodes.append(PlanNode(node_id, op, tuple(inputs), params, trace_key))
        return Step(self, node_id)

    def plan(self) -> Plan:
        return Plan(tuple(self.nodes), self.name, env=self.env, **self.logging)
