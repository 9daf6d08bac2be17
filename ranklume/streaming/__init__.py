"""Plans over streams of candidates.

Row-local nodes run unchanged on a streaming DataFrame.  Merging keeps state:
``merge_stream`` emits the first row of each id within a watermark.  Plans with
whole-batch nodes run on each micro-batch (``run_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import Context, NodeError, Operators, default_operators
from ..operators.core import CANDIDATE_ID
from ..plans import CompiledPlan, execute

#: Operators that look at one row at a time.
ROW_LOCAL = ("core:features", "core:model", "core:score_formula", "ext:filter", "ext:table", "ext:join_features")


def check_row_local(compiled: CompiledPlan) -> None:
    for n in compiled.plan.nodes:
        if n.op not in ROW_LOCAL:
            raise NodeError(f"Node '{n.id}': {n.op} needs whole batches; use run_batches")


def stream(compiled: CompiledPlan, ctx: Context, operators: Operators | None = None) -> DataFrame:
    """A row-local plan as a streaming DataFrame; ``ext:table`` nodes read streaming tables of the context."""
    check_row_local(compiled)
    return execute(compiled, ctx, operators or default_operators())


def merge_stream(df: DataFrame, ctx: Context, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each candidate id; ids are forgotten after the watermark."""
    cid = ctx.registry.resolve(CANDIDATE_ID).column
    return df.where(f"{cid} is not null").withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([cid])


def run_batches(source: DataFrame, table: str, compiled: CompiledPlan, ctx: Context, sink: Callable[[DataFrame, int], None], checkpoint: str, operators: Operators | None = None, **trigger) -> StreamingQuery:
    """Runs a plan on each micro-batch of ``source`` (the table ``table`` of the plan) and hands results to ``sink``.

    A batch can be given again after a failure; ``sink`` gets the batch's number
    to write idempotently.
    """

    def on(batch: DataFrame, number: int) -> None:
        own = Context(batch.sparkSession, ctx.registry, ctx.strict, ctx.tables | {table: batch}, ctx.policy, ctx.warn)
        sink(execute(compiled, own, operators), number)

    return source.writeStream.foreachBatch(on).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
