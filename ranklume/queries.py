"""Queries over the test tables, one for each operator and expression, with their SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import behaviour, catalog
from .functions import E, to_column
from .functions.compile import f32
from .keys import POSITION, KeyRegistry
from .operators.base import Context
from .operators.python_module import apply_module, make_module
from .plans import Pipeline, compile_plan, execute, measure, parse_plan, score
from .plans.trace import Tracer
from .sources import Policy, lines, read_csv_frame
from .streaming import stream

REGISTRY = KeyRegistry.default()
PART_KEYS = {1001: "p_partkey", 3001: "cast(p_retailprice / 1000 as float)"}
EVENT_KEYS = {1001: "user_id", 3001: "cast(value as float)"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def context(spark: SparkSession, sf_dir: str, *tables: str) -> Context:
    return Context(spark, REGISTRY, tables={t: read(spark, sf_dir, t) for t in tables})


def parts(p: Pipeline):
    return p.ext.table(table="part", keys=PART_KEYS, position="p_partkey")


def events(p: Pipeline, **more):
    return p.ext.table(table="events", keys=EVENT_KEYS, position="event_id", **more)


def run(step, ctx: Context) -> DataFrame:
    return execute(compile_plan(step.plan()), ctx)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Floats as doubles rounded to 4 places, so that engines compare."""
    rounded = lambda c: F.round(F.col(c).cast("double"), 4).alias(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)
    return df.select(*(rounded(c) for c in columns))


ID, BASE, ML, FINAL = "cand_candidate_id", "score_base", "score_ml", "score_final"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# -- sources -----------------------------------------------------------------


@query("select (range + 1)::bigint as cand_candidate_id, round((1::float - (range::float / 100::float))::float::double, 4) as score_base from range(100)")
def sourcer_synthetic(spark, sf_dir):
    return shown(run(Pipeline().core.sourcer(k=100), context(spark, sf_dir)), ID, BASE)


PART_SQL = "select p_partkey as id, (p_retailprice / 1000)::float as b, (p_partkey % 100)::float / 100::float as f from part"


@query(f"select id as cand_candidate_id, round(b::double, 4) as score_base from ({PART_SQL})")
def sourcer_parquet(spark, sf_dir):
    return shown(run(parts(Pipeline()), context(spark, sf_dir, "part")), ID, BASE)


# -- expressions ---------------------------------------------------------------

b, q = E.signal(3001), E.signal(1001)
EXPRESSIONS = {
    "expr_const": (E.const(42), "42::float"),
    "expr_signal": (b, "b"),
    "expr_i64_signal": (q, "id::float"),
    "expr_signal_missing": (E.signal(3003), "0::float"),
    "expr_add": (E.add(b, 1.5, b), "(b + 1.5::float) + b"),
    "expr_mul": (E.mul(b, 0.7, b), "(b * 0.7::float) * b"),
    "expr_neg": (E.neg(b), "-1::float * b"),
    "expr_sub": (b - 0.25, "b - 0.25::float"),
    "expr_min": (E.min(b, 0.95, E.mul(b, b)), "least(b, 0.95::float, b * b)"),
    "expr_max": (E.max(b, 0.95, E.mul(b, b)), "greatest(b, 0.95::float, b * b)"),
    "expr_clamp": (E.clamp(b, 0.92, 0.97), "greatest(0.92::float, least(0.97::float, b))"),
    "expr_penalty_unknown": (E.penalty("nothing"), "0::float"),
    "expr_blend_clamped": (E.clamp(0.7 * b + 0.3 * E.max(b, 0.93) - 0.1, 0.0, 0.9), "greatest(0::float, least(0.9::float, 0.7::float * b + 0.3::float * greatest(b, 0.93::float) - 0.1::float))"),
    "expr_zero_arguments": ({"op": "add", "args": [{"op": "mul", "args": []}, {"op": "min", "args": []}, {"op": "max", "args": []}, {"op": "add", "args": []}]}, "1::float"),
}


def _expression(tree):
    return lambda spark, sf_dir: shown(run(parts(Pipeline()).core.score_formula(expr=tree), context(spark, sf_dir, "part")), ID, FINAL)


for _name, (_tree, _sql) in EXPRESSIONS.items():
    query(f"select id as cand_candidate_id, round(({_sql})::float::double, 4) as score_final from ({PART_SQL})", _name)(_expression(_tree))


@query(f"select id as cand_candidate_id, round((b + -1::float * (id % 7)::float)::float::double, 4) as score_final from ({PART_SQL})")
def expr_penalty(spark, sf_dir):
    keys = PART_KEYS | {4001: "cast(p_partkey % 7 as float)"}
    step = Pipeline().ext.table(table="part", keys=keys, position="p_partkey").core.score_formula(expr=b - E.penalty("constraints"))
    return shown(run(step, context(spark, sf_dir, "part")), ID, FINAL)


COS_SQL = """
with q as (select embedding as v from embeddings where vec_id = 0),
d as (select vec_id, list_reduce(list_transform(list_zip(embedding, v), lambda z: z[1] * z[2]), lambda a, x: a + x) as ab,
             list_reduce(list_transform(embedding, lambda z: z * z), lambda a, x: a + x) as aa, list_reduce(list_transform(v, lambda z: z * z), lambda a, x: a + x) as bb from embeddings, q)
select vec_id as cand_candidate_id, round(case when aa = 0 or bb = 0 then 0 else greatest(-1, least(1, ab / (sqrt(aa)::float * sqrt(bb)::float))) end::double, 4) as score_final from d
"""


def with_query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("qv")).limit(1)  # one row
    return vectors.join(F.broadcast(one))


@query(COS_SQL)
def expr_cos(spark, sf_dir):
    ctx = Context(spark, REGISTRY, tables={"vectors": with_query_vector(spark, sf_dir)})
    step = Pipeline().ext.table(table="vectors", keys={1001: "vec_id", 2002: "embedding", 2003: "qv"}, position="vec_id").core.score_formula(expr=E.cos(E.signal(2002), E.signal(2003)))
    return shown(run(step, ctx), ID, FINAL)


# -- merge -----------------------------------------------------------------------

MERGE_SQL = "select user_id as cand_candidate_id, round(b::double, 4) as score_base from (select user_id, value::float as b, row_number() over (partition by user_id order by {order}) as rn from {source}) where rn = 1"


@query(MERGE_SQL.format(order="event_id", source="events"))
def merge_first(spark, sf_dir):
    return shown(run(events(Pipeline()).core.merge(dedup="first"), context(spark, sf_dir, "events")), ID, BASE)


@query(MERGE_SQL.format(order="value::float desc, event_id", source="events"))
def merge_max_base(spark, sf_dir):
    return shown(run(events(Pipeline()).core.merge(dedup="max_base"), context(spark, sf_dir, "events")), ID, BASE)


@query(MERGE_SQL.format(order="value::float desc, part, event_id", source="(select *, case when event_type = 'click' then 0 else 1 end as part from events where event_type in ('click', 'purchase'))"))
def merge_union_max_base(spark, sf_dir):
    p = Pipeline()
    first, second = (events(p, where=f"event_type = '{t}'") for t in ("click", "purchase"))
    return shown(run(first.core.merge(second, dedup="max_base"), context(spark, sf_dir, "events")), ID, BASE)


WEIGHTED_SQL = """
with s as (select *, case when event_type = 'click' then 0 else 1 end as part from events where event_type in ('click', 'purchase')),
f as (select *, row_number() over (partition by part, user_id order by event_id) as rn from s)
select user_id as cand_candidate_id, round(sum((case when part = 0 then 0.7::float else 0.3::float end * value::float)::double order by part)::float::double, 4) as score_base from f where rn = 1 group by user_id
"""


@query(WEIGHTED_SQL)
def weighted_union(spark, sf_dir):
    p = Pipeline()
    first, second = (events(p, where=f"event_type = '{t}'") for t in ("click", "purchase"))
    return shown(run(first.ext.weighted_union(second, weights=[0.7, 0.3]), context(spark, sf_dir, "events")), ID, BASE)


# -- features, model, selection ------------------------------------------------------


@query(f"select id as cand_candidate_id, round(f::double, 4) as feat_freshness from ({PART_SQL})")
def features_freshness(spark, sf_dir):
    return shown(run(parts(Pipeline()).core.features(keys=[2001]), context(spark, sf_dir, "part")), ID, "feat_freshness")


@query(f"select id as cand_candidate_id, 0::double as penalty_diversity, 128 as dims, round(0.1::float::double, 4) as first from ({PART_SQL})")
def features_fixed(spark, sf_dir):
    df = run(parts(Pipeline()).core.features(keys=[4002, 2002]), context(spark, sf_dir, "part"))
    return shown(df.select(ID, "penalty_diversity", F.size("feat_embedding").alias("dims"), F.col("feat_embedding")[0].alias("first")), ID, "penalty_diversity", "dims", "first")


@query("select user_id as cand_candidate_id, event_id, label from events left join embeddings on vec_id = user_id")
def features_join(spark, sf_dir):
    ctx = context(spark, sf_dir, "events", "embeddings")
    step = events(Pipeline()).ext.join_features(table="embeddings", on="vec_id", keys={2002: "embedding", 9001: "cast(label as string)"})
    return run(step, ctx).select(ID, F.col(POSITION).alias("event_id"), F.col("debug_node_timings").cast("int").alias("label"))


MODEL_SQL = f"select id, b, f, (0.6::float * b + 0.4::float * f)::float as m from ({PART_SQL})"


@query(f"select id as cand_candidate_id, round(m::double, 4) as score_ml from ({MODEL_SQL})")
def model_linear(spark, sf_dir):
    return shown(run(parts(Pipeline()).core.features(keys=[2001]).core.model(), context(spark, sf_dir, "part")), ID, ML)


@query(f"select id as cand_candidate_id, round(b::double, 4) as score_base from ({PART_SQL}) order by id limit 25")
def limit_batch_order(spark, sf_dir):
    return shown(run(parts(Pipeline()).ext.limit(n=25), context(spark, sf_dir, "part")), ID, BASE)


@query(f"select id as cand_candidate_id, round(b::double, 4) as score_final, (row_number() over (order by b desc, id) - 1)::bigint as place from ({PART_SQL}) order by b desc, id limit 20")
def topk_score(spark, sf_dir):
    df = run(parts(Pipeline()).core.score_formula().ext.topk(k=20), context(spark, sf_dir, "part"))
    return shown(df.withColumnRenamed(POSITION, "place"), ID, FINAL, "place")


@query(f"select id as cand_candidate_id, round(b::double, 4) as score_base from ({PART_SQL}) where b * b > 0.9::float")
def filter_expr(spark, sf_dir):
    return shown(run(parts(Pipeline()).ext.filter(expr=b * b, above=0.9), context(spark, sf_dir, "part")), ID, BASE)


NORMALIZE_SQL = f"select id as cand_candidate_id, round(((b - lo) / (hi - lo))::float::double, 4) as score_adjusted from ({PART_SQL}), (select min(b) as lo, max(b) as hi from ({PART_SQL}))"


@query(NORMALIZE_SQL)
def normalize_score(spark, sf_dir):
    return shown(run(parts(Pipeline()).ext.normalize(), context(spark, sf_dir, "part")), ID, "score_adjusted")


PIPELINE_SQL = """
with m as (select user_id as id, b from (select user_id, value::float as b, row_number() over (partition by user_id order by value::float desc, event_id) as rn from events) where rn = 1),
s as (select id, b, (0.6::float * b + 0.4::float * ((id % 100)::float / 100::float))::float as ml from m),
f as (select id, ml, (0.7::float * b + 0.3::float * ml)::float as s from s)
select id as cand_candidate_id, round(ml::double, 4) as score_ml, round(s::double, 4) as score_final from f order by s desc, id limit 50
"""


@query(PIPELINE_SQL)
def pipeline_full(spark, sf_dir):
    """The flagship: events are merged by user, scored by a model and a formula, and ranked."""
    step = events(Pipeline("flagship", env="prod")).core.merge(dedup="max_base").core.features(keys=[2001]).core.model(name="linear").core.score_formula(expr=0.7 * b + 0.3 * E.signal(3002)).ext.topk(k=50)
    return shown(run(step, context(spark, sf_dir, "events")), ID, ML, FINAL)


# -- user modules, CSV, streams ----------------------------------------------------------


def scale(batch, ctx, params):
    batch.write_f32(3002)[:] = batch.f32(3001) * params["by"]


def spread(batch, ctx, params):
    x, low, high = batch.f32(3001), ctx.totals.low, ctx.totals.high
    batch.write_f32(3003)[:] = (x - low) / (high - low) if high > low else 0.5


#: The budget of a module that writes one float a row, for tables of any size.
ONE_FLOAT = {"max_write_bytes_per_row": 4, "max_write_cells_per_row": 1}


@query(f"select id as cand_candidate_id, round((b * 2.5::float)::float::double, 4) as score_ml from ({PART_SQL})")
def udf_scale(spark, sf_dir):
    module = make_module({"name": "scale", "reads": [3001], "writes": [3002], "scope": "row", "budget": ONE_FLOAT}, scale)
    ctx = context(spark, sf_dir, "part")
    return shown(apply_module(module, ctx, run(parts(Pipeline()), ctx), {"by": 2.5}), ID, ML)


@query(NORMALIZE_SQL)
def udf_minmax_normalize(spark, sf_dir):
    totals = {"low": ("min", 3001), "high": ("max", 3001)}
    module = make_module({"name": "spread", "reads": [3001], "writes": [3003], "scope": "row", "budget": ONE_FLOAT, "totals": totals}, spread)
    ctx = context(spark, sf_dir, "part")
    return shown(apply_module(module, ctx, run(parts(Pipeline()), ctx), {}), ID, "score_adjusted")


def shared_folder(spark):
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where the master is this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="ranklume-shared-")).rstrip("/")


SCALE = str(Path(__file__).parent / "modules" / "scale.py")


@query(f"select id as cand_candidate_id, round((b * 2.5::float)::float::double, 4) as score_ml from ({PART_SQL}) where b > 0.95::float")
def module_in_plan(spark, sf_dir):
    """A user module from a file, as a node of a plan, under a filter."""
    return shown(run(parts(Pipeline()).py.module(module=SCALE, by=2.5).ext.filter(expr=b, above=0.95), context(spark, sf_dir, "part")), ID, ML)


CSV_TEXT = "id,name,score\n1,apple,0.9\n2, banana ,0.8\n\n3,cherry\n4,\"quo,ted,extra\n"


@query("select * from (values ('1', 'apple', '0.9'), ('2', 'banana', '0.8'), ('', '', ''), ('3', 'cherry', ''), ('4', '\"quo', 'ted')) as t(id, name, score)")
def csv_lookup(spark, sf_dir):
    from .sources.csv import check_resource

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}/{check_resource('fruit.csv')}"
    spark.createDataFrame([(CSV_TEXT.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
    return read_csv_frame(spark, path)


@query("select * from (values (1::bigint, 0.9::double), (2, 0.8), (3, null), (4, null)) as t(cand_candidate_id, score_base)")
def csv_node(spark, sf_dir):
    """A CSV asset as the source of a plan, under a policy; lines without an id are dropped by the merge."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    spark.createDataFrame([(CSV_TEXT.removesuffix("\n"),)], "value string").coalesce(1).write.text(f"{folder}/fruit.csv")
    ctx = Context(spark, REGISTRY, policy=Policy(folder, ({"name": "ext.csv", "allow_io_csv_read": True},)))
    step = Pipeline().ext.csv(resource="fruit.csv", keys={1001: "try_cast(id as long)", 3001: "try_cast(score as float)"}).core.merge()
    return shown(run(step, ctx), ID, BASE)


@query("select (range + 1)::bigint as place, '[' || range || '] candidate_id=' || (range + 1) || ', score.final=' || printf('%.4f', 1 - range / 4.0) as line from range(4)")
def printed_rows(spark, sf_dir):
    df = run(Pipeline().core.sourcer(k=4).core.score_formula(), Context(spark, REGISTRY))
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines(df, REGISTRY), 1)], "place long, line string")


@query("select * from (values ('sourcer_1', 'core:sourcer', 20), ('features_2', 'core:features', 20), ('topk_3', 'ext:topk', 5)) as t(node, span, rows_out)")
def traced_run(spark, sf_dir):
    """The events that a traced run gives off."""
    told: list[str] = []
    tracer = Tracer("materialize", told.append)
    execute(compile_plan(Pipeline().core.sourcer(k=20).core.features(keys=[2001]).ext.topk(k=5, score_key_id=3001).plan()), Context(spark, REGISTRY), tracer=tracer).count()
    tracer.release()
    ends = [e for e in map(json.loads, told) if e["event"] == "node_end"]
    return spark.createDataFrame([(e["node_id"], e["span_name"], e["rows_out"]) for e in ends], "node string, span string, rows_out int")


@query("select event_id as _pos, round((0.6::float * value::float + 0.4::float * ((user_id % 100)::float / 100::float))::float::double, 4) as score_ml from events")
def stream_row_local(spark, sf_dir):
    """A row-local plan over a stream of the events' files, as it lands in Parquet."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    step = events(Pipeline()).core.features(keys=[2001]).core.model()
    out = stream(compile_plan(step.plan()), Context(spark, REGISTRY, tables={"events": source})).select(F.col(POSITION).alias("_pos"), ML)
    out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return shown(spark.read.parquet(f"{folder}/out"), "_pos", ML)


# -- plans, catalog, keys -----------------------------------------------------------------

COMPLEX_PLAN = {
    "name": "complexity",
    "nodes": [
        {"id": "s", "op": "core:sourcer"},
        *({"id": f"f{i}", "op": "core:features", "inputs": ["s"]} for i in (1, 2, 3)),
        *({"id": f"m{i}", "op": "core:model", "inputs": [f"f{i}"]} for i in (1, 2)),
        {"id": "merge", "op": "core:merge", "inputs": ["m1", "m2", "f3"]},
        {"id": "final", "op": "core:score_formula", "inputs": ["merge"]},
    ],
}


@query("select * from (values ('node_count', 8), ('edge_count', 9), ('max_depth', 5), ('fanout_peak', 3), ('fanin_peak', 3), ('score', 49)) as t(metric, value)")
def plan_complexity_metrics(spark, sf_dir):
    m = measure(parse_plan(COMPLEX_PLAN))
    rows = [(k, getattr(m, k)) for k in ("node_count", "edge_count", "max_depth", "fanout_peak", "fanin_peak")] + [("score", score(m))]
    return spark.createDataFrame(rows, "metric string, value int")


CATALOG_SQL = "select * from (values " + ", ".join(f"('{op}', '{ns}', 'stable')" for op, ns in [("core:features", "core.features"), ("core:merge", "core.merge"), ("core:model", "core.model"), ("core:score_formula", "core.score_formula"), ("core:sourcer", "core.sourcer"), ("py:module", "py.module")]) + ") as t(op, namespace, stability)"


@query(CATALOG_SQL)
def node_catalog(spark, sf_dir):
    return catalog.to_frame(spark).where("op not like 'ext:%'").select("op", "namespace", "stability")


KEY_SQL = "select * from (values (1001, 'cand.candidate_id', 'i64', 'candidate'), (2001, 'feat.freshness', 'f32', 'feature'), (2002, 'feat.embedding', 'f32vec', 'feature'), (2003, 'feat.query_embedding', 'f32vec', 'feature'), (3001, 'score.base', 'f32', 'score'), (3002, 'score.ml', 'f32', 'score'), (3003, 'score.adjusted', 'f32', 'score'), (3999, 'score.final', 'f32', 'score'), (4001, 'penalty.constraints', 'f32', 'penalty'), (4002, 'penalty.diversity', 'f32', 'penalty'), (9001, 'debug.node_timings', 'string', 'debug')) as t(key_id, name, type, scope)"


@query(KEY_SQL)
def key_registry(spark, sf_dir):
    return REGISTRY.to_frame(spark).select("key_id", "name", "type", "scope")


QUERIES |= behaviour.QUERIES
SQL |= behaviour.SQL

__all__ = ["QUERIES", "SQL", "f32", "to_column"]
