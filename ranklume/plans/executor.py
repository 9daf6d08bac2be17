"""Folds a compiled plan into one lazy DataFrame."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import POSITION
from ..operators.base import Context, NodeError, Operators, default_operators, empty_batch
from .compiler import CompiledPlan
from .trace import Tracer

#: Operators whose output is worth keeping when several nodes read it.
COSTLY = ("core:merge", "py:module", "ext:weighted_union", "ext:topk", "ext:join_features")


def execute(compiled: CompiledPlan, ctx: Context, operators: Operators | None = None, tracer: Tracer | None = None, keep_shared: bool = False) -> DataFrame:
    """The plan's result, unevaluated: filters and column pruning reach the sources through all nodes.

    Only nodes that the result needs become part of the lineage.  With
    ``keep_shared``, costly nodes with several readers are persisted.  Unless
    ``ctx.strict``, a node takes the first of its inputs only.
    """
    operators, tracer = operators or default_operators(), tracer or Tracer()
    nodes = {n.id: n for n in compiled.plan.nodes}
    readers = {x: 0 for x in nodes}
    for n in compiled.plan.nodes:
        for i in n.inputs:
            readers[i] = readers.get(i, 0) + 1
    done: dict[str, DataFrame] = {}
    for x in compiled.order:
        node = nodes[x]
        spec = operators.get(node.op)
        if spec is None:
            raise NodeError(f"No operator is registered for {node.op} (node '{x}')")
        inputs = [done[i] for i in (node.inputs if ctx.strict else node.inputs[:1])] or ([] if spec.source else [empty_batch(ctx)])
        df = tracer.run(compiled.plan.name, node, inputs, lambda spec=spec, inputs=inputs, node=node: spec.run(ctx, inputs, node.params))
        if keep_shared and readers[x] > 1 and node.op in COSTLY:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        done[x] = df
    return done[compiled.result] if compiled.order else empty_batch(ctx)


def sample_dump(df: DataFrame, compiled: CompiledPlan, ctx: Context) -> DataFrame:
    """The share of rows and the keys that the plan's logging asks for."""
    columns = [c for c in (ctx.registry.resolve(k).column for k in compiled.plan.dump_keys) if c in df.columns]
    chosen = F.pmod(F.xxhash64(POSITION), F.lit(1_000_000)) < int(compiled.plan.sample_rate * 1_000_000)
    return df.where(chosen).select(POSITION, *columns)
