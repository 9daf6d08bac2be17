"""Nodes that documents describe or that a Spark engine needs, beyond the core ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, to_column
from ..functions.compile import f32, less, signal
from ..keys import POSITION, Key
from ..sources.csv import IoError, check_resource, read_csv_frame
from .base import Context, NodeError, NodeSpec, positioned, with_keys
from .core import CANDIDATE_ID, SCORE_BASE, SCORE_FINAL, union_in_order


def as_key(expression: str, key: Key) -> Column:
    """A SQL expression as a value of the key's type; a vector with null elements is a null vector."""
    if key.type != "f32vec":
        return F.expr(expression).cast(key.spark_type)
    vector = F.expr(expression).cast("array<float>")
    return F.when(F.forall(vector, lambda x: x.isNotNull()), vector)


def table(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Reads a named table as candidates: SQL expressions for keys, and one for the position."""
    name = params.get("table")
    if name not in ctx.tables:
        raise NodeError(f"table: unknown table {name!r}")
    source = ctx.tables[name]
    if params.get("where"):
        source = source.where(params["where"])
    keys = {ctx.registry.resolve(k): e for k, e in params.get("keys", {}).items()}
    picked = source.select(F.expr(params.get("position", "monotonically_increasing_id()")).cast("long").alias(POSITION), *(as_key(e, k).alias(k.column, metadata=k.metadata()) for k, e in keys.items()))
    return positioned(picked)


def csv(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Reads a CSV asset as candidates, if the context's policy allows the module name ``ext.csv`` to.

    ``keys`` are SQL expressions over the file's columns, all of them strings;
    positions are those of the rows.
    """
    if ctx.policy is None or not ctx.policy.allows_csv("ext.csv"):
        raise IoError("csv: the policy doesn't allow ext.csv to read CSV")
    path = f"{ctx.policy.assets_dir.rstrip('/')}/{check_resource(params.get('resource', ''))}"
    keys = {ctx.registry.resolve(k): e for k, e in params.get("keys", {}).items()}
    rows = read_csv_frame(ctx.spark, path)
    picked = rows.select(F.monotonically_increasing_id().alias(POSITION), *(as_key(e, k).alias(k.column, metadata=k.metadata()) for k, e in keys.items()))
    return positioned(picked)


def union(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """All rows of all inputs, in input order."""
    return union_in_order(inputs)


def weighted_union(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """One row for each id: the weighted sum of its base scores over the inputs.

    Each input counts an id once, with its first row.
    """
    weights = params.get("weights") or [1.0] * len(inputs)
    if len(weights) != len(inputs):
        raise NodeError("weighted_union: one weight an input")
    cid, base = (ctx.registry.resolve(k).column for k in (CANDIDATE_ID, SCORE_BASE))
    parts = []
    for i, (df, w) in enumerate(zip(inputs, weights)):
        first = df.where(F.col(cid).isNotNull()).groupBy(cid).agg(F.min_by(F.struct(F.coalesce(F.col(base), f32(0.0)).alias("s")), POSITION).alias("x"), F.min(POSITION).alias("p"))
        parts.append(first.select(cid, (F.lit(i << 48) + F.col("p")).alias("p"), F.lit(i).alias("i"), (f32(w) * F.col("x.s")).cast("double").alias("s")))
    # at most one row an input and id; summed in input order
    rows = reduce(DataFrame.unionByName, parts).groupBy(cid).agg(F.min("p").alias(POSITION), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("xs"))
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["s"]).cast("float")
    return with_keys(rows.select(POSITION, cid, total.alias(base)), {ctx.registry.resolve(k): F.col(ctx.registry.resolve(k).column) for k in (CANDIDATE_ID, SCORE_BASE)})


def filter_rows(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Rows whose expression is above a bound."""
    df = inputs[0]
    value = to_column(parse(params["expr"], ctx.strict, ctx.warn), df.schema, ctx.registry)
    return df.where(less(f32(params.get("above", 0.0)), value))


def topk(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """The ``k`` rows with the largest score, by smallest id if equal; positions are the ranks."""
    df = inputs[0]
    score, cid = (ctx.registry.resolve(k) for k in (params.get("score_key_id", SCORE_FINAL), CANDIDATE_ID))
    ranked = df.withColumn("_score", signal(df.schema, score)).orderBy(F.desc("_score"), F.asc(cid.column), F.asc(POSITION)).limit(int(params.get("k", 10)))
    # k rows: numbering them in one task is bounded
    order = Window.orderBy(F.desc("_score"), F.asc(cid.column), F.asc(POSITION))
    return ranked.withColumn("_rank", F.row_number().over(order) - 1).withColumn(POSITION, F.col("_rank").cast("long")).drop("_rank", "_score")


def limit(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """The first ``n`` rows in batch order; 0 is all."""
    n = int(params.get("n", 0))
    return inputs[0].orderBy(POSITION).limit(n) if n else inputs[0]


def normalize(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Min-max scaling of a score into a key; 0.5 where all are equal."""
    df = inputs[0]
    source, out = (ctx.registry.resolve(params.get(k, d)) for k, d in (("key_id", SCORE_BASE), ("output_key_id", 3003)))
    value = signal(df.schema, source)
    # one row: the extremes, so that no window needs all rows in one task
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), f32((value - F.col("_lo")).cast("float") / (F.col("_hi") - F.col("_lo")).cast("float"))).otherwise(f32(0.5))
    return with_keys(df.join(F.broadcast(ends)), {out: scaled}).drop("_lo", "_hi")


def join_features(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Attaches keys of a named table by candidate id; ids without a row get nulls.

    Of several rows of an id, that with the smallest values counts, compared in
    the order of ``keys`` (nulls are smallest).
    """
    df, name = inputs[0], params.get("table")
    if name not in ctx.tables:
        raise NodeError(f"join_features: unknown table {name!r}")
    cid = ctx.registry.resolve(CANDIDATE_ID).column
    keys = {ctx.registry.resolve(k): e for k, e in params.get("keys", {}).items()}
    side = ctx.tables[name].select(F.expr(params["on"]).cast("long").alias(cid), *(as_key(e, k).alias(k.column) for k, e in keys.items())).where(F.col(cid).isNotNull())
    side = side.groupBy(cid).agg(F.min(F.struct(*(k.column for k in keys))).alias("x")).select(cid, "x.*") if keys else side.distinct()
    joined = df.drop(*(k.column for k in keys)).join(side, cid, "left")
    return with_keys(joined, {k: F.col(k.column) for k in keys})


def sample(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """A share of the rows, chosen by a hash of the position, with the given keys only."""
    df, rate = inputs[0], float(params.get("rate", 1.0))
    columns = [c for c in (ctx.registry.resolve(k).column for k in params.get("keys", [])) if c in df.columns]
    kept = df.where(F.pmod(F.xxhash64(POSITION), F.lit(1_000_000)) < int(rate * 1_000_000))
    return kept.select(POSITION, *columns) if columns else kept


def _spec(op, run, **more):
    return NodeSpec(f"ext:{op}", f"ext.{op}", run, run.__doc__.splitlines()[0], **more)


SPECS = (
    _spec("table", table, params={"table": "string", "keys": "map", "position": "sql", "where": "sql"}, source=True),
    _spec("csv", csv, params={"resource": "string", "keys": "map"}, source=True, capabilities={"io": {"csv_read": True}}),
    _spec("union", union, many_inputs=True),
    _spec("weighted_union", weighted_union, params={"weights": "float[]"}, reads=(CANDIDATE_ID, SCORE_BASE), writes=(SCORE_BASE,), many_inputs=True),
    _spec("filter", filter_rows, params={"expr": "expr", "above": "float"}),
    _spec("topk", topk, params={"k": "int", "score_key_id": "int"}, reads=(CANDIDATE_ID,)),
    _spec("limit", limit, params={"n": "int"}),
    _spec("normalize", normalize, params={"key_id": "int", "output_key_id": "int"}, writes_from="output_key_id"),
    _spec("join_features", join_features, params={"table": "string", "on": "sql", "keys": "map"}, reads=(CANDIDATE_ID,)),
    _spec("sample", sample, params={"rate": "float", "keys": "int[]"}),
)
