"""The core nodes: source, merge, features, model, score formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse, to_column
from ..functions.compile import f32, signal
from ..keys import POSITION
from .base import Context, NodeError, NodeSpec, with_keys

# Ids of the keys that the core nodes know.
CANDIDATE_ID, FRESHNESS, EMBEDDING, QUERY_EMBEDDING, SCORE_BASE, SCORE_ML, SCORE_FINAL = 1001, 2001, 2002, 2003, 3001, 3002, 3999
EMBEDDING_DIM = 128


def sourcer(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """``k`` candidates with falling base scores; any input is ignored."""
    k = params.get("k", 100)
    if not isinstance(k, int) or isinstance(k, bool):
        raise NodeError("sourcer: 'k' must be an integer")
    rows = ctx.spark.range(max(0, k)).select(F.col("id").alias(POSITION))
    share = f32(F.col(POSITION).cast("float") / f32(max(1, k)))
    return with_keys(rows, {ctx.registry.resolve(CANDIDATE_ID): F.col(POSITION) + 1, ctx.registry.resolve(SCORE_BASE): (f32(1.0) - share).cast("float")})


def union_in_order(inputs: list[DataFrame]) -> DataFrame:
    """Inputs one after the other.  Positions stay in order: (input, position) is packed into one long.

    The input's number takes the upper bits, so positions must stay below 2 ** 48.
    """
    placed = [df.withColumn(POSITION, F.lit(i << 48) + F.col(POSITION)) for i, df in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def merge(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """One row for each candidate id: the first, or the first with the largest base score.

    Rows with a null id are dropped, and all rows if there is no id column of the
    right type.  Survivors keep their columns and positions.  Several inputs are
    taken one after the other.
    """
    df = inputs[0] if len(inputs) == 1 else union_in_order(inputs)
    cid, base = ctx.registry.resolve(CANDIDATE_ID).column, ctx.registry.resolve(SCORE_BASE).column
    types = {f.name: f.dataType for f in df.schema}
    if not isinstance(types.get(cid), T.LongType):
        return df.where(F.lit(False))
    how = params.get("dedup", "first")
    if how not in ("first", "max_base") and ctx.strict:
        raise NodeError(f"merge: unknown dedup strategy {how!r}")
    rows = df.where(F.col(cid).isNotNull())
    # aggregates of whole rows: they are combined before the shuffle, so a hot id is no large task
    row = F.struct(*df.columns)
    first = F.min_by(row, POSITION)
    if how == "max_base" and isinstance(types.get(base), T.FloatType):
        # An id's running best is replaced by a strictly larger score only, and comparisons with NaN
        # are false: a NaN wins if it comes first, and never otherwise.
        score = F.coalesce(F.col(base), f32(0.0))
        best = F.max_by(row, F.when(~F.isnan(score), F.struct((score + f32(0.0)).alias("value"), (-F.col(POSITION)).alias("at"))))
        merged = rows.groupBy(cid).agg(first.alias("_first"), best.alias("_best"))
        merged = merged.select(F.when(F.isnan(F.col(f"_first.{base}")), F.col("_first")).otherwise(F.col("_best")).alias("_row"))
    else:
        merged = rows.groupBy(cid).agg(first.alias("_row"))
    return merged.select(*(F.col(f"_row.{c}").alias(c, metadata=df.schema[c].metadata) for c in df.columns))


def features(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Fills the keys in ``keys``: freshness from the id, fixed embeddings, 0 for any other key."""
    df = inputs[0]
    cid = ctx.registry.resolve(CANDIDATE_ID).column
    values = {}
    for key_id in params.get("keys") or []:
        key = ctx.registry.by_id(key_id)
        if key is None:
            if ctx.strict:
                raise NodeError(f"features: unknown key {key_id}")
            continue
        if key_id == FRESHNESS:
            known = isinstance(dict((f.name, f.dataType) for f in df.schema).get(cid), T.LongType)
            values[key] = F.coalesce(f32((F.col(cid) % 100).cast("float") / f32(100.0)), f32(0.5)) if known else f32(0.5)
        elif key_id in (EMBEDDING, QUERY_EMBEDDING):
            values[key] = F.array_repeat(f32(0.1), EMBEDDING_DIM)
        else:
            if key.type != "f32" and ctx.strict:
                raise NodeError(f"features: key {key_id} ({key.name}) isn't a float")
            values[key] = f32(0.0)
    return with_keys(df, values) if values else df


def model(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """A linear model of base score and freshness."""
    df = inputs[0]
    of = lambda k: signal(df.schema, ctx.registry.resolve(k))
    score = ((f32(0.6) * of(SCORE_BASE)).cast("float") + (f32(0.4) * of(FRESHNESS)).cast("float")).cast("float")
    return with_keys(df, {ctx.registry.resolve(SCORE_ML): score})


def score_formula(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Evaluates an expression tree into a key; without one, copies the base score."""
    df = inputs[0]
    out_id = params.get("output_key_id", SCORE_FINAL)
    out = ctx.registry.by_id(out_id)
    if out is None:
        raise NodeError(f"score_formula: unknown output key {out_id}")
    if out.type != "f32" and ctx.strict:
        raise NodeError(f"score_formula: output key {out_id} ({out.name}) isn't a float")
    tree = parse(params.get("expr", {"op": "signal", "key_id": SCORE_BASE}), ctx.strict, ctx.warn)
    return with_keys(df, {out: to_column(tree, df.schema, ctx.registry)})


SPECS = (
    NodeSpec("core:sourcer", "core.sourcer", sourcer, sourcer.__doc__.splitlines()[0], params={"name": "string", "k": "int"}, writes=(CANDIDATE_ID, SCORE_BASE), source=True),
    NodeSpec("core:merge", "core.merge", merge, merge.__doc__.splitlines()[0], params={"dedup": "first|max_base"}, reads=(CANDIDATE_ID, SCORE_BASE), many_inputs=True),
    NodeSpec("core:features", "core.features", features, features.__doc__.splitlines()[0], params={"keys": "int[]"}, reads=(CANDIDATE_ID,), writes_from="keys"),
    NodeSpec("core:model", "core.model", model, model.__doc__.splitlines()[0], params={"name": "string"}, reads=(SCORE_BASE, FRESHNESS), writes=(SCORE_ML,)),
    NodeSpec("core:score_formula", "core.score_formula", score_formula, score_formula.__doc__.splitlines()[0], params={"expr": "expr", "output_key_id": "int"}, writes_from="output_key_id"),
)
