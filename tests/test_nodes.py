"""Node operators, on literals and against sequential models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ranklume.functions import E
from ranklume.keys import POSITION, KeyRegistry
from ranklume.operators import Context, NodeError, NodeSpec, Operators, default_operators
from ranklume.operators import core, extensions
from ranklume.plans import Pipeline, compile_plan, execute

NAN = float("nan")
SCHEMA = f"{POSITION} long, cand_candidate_id long, score_base float"


@pytest.fixture
def ctx(spark):
    return Context(spark)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy(POSITION).select(*columns).collect()]


def test_sourcer(ctx):
    df = core.sourcer(ctx, [], {"k": 4})
    assert rows(df, "cand_candidate_id", "score_base") == [(1, 1.0), (2, 0.75), (3, 0.5), (4, 0.25)]
    assert df.schema["score_base"].metadata["key_id"] == 3001
    assert core.sourcer(ctx, [], {}).count() == 100 and core.sourcer(ctx, [], {"k": 0}).count() == 0
    with pytest.raises(NodeError):
        core.sourcer(ctx, [], {"k": "3"})


def fold(batch, how):
    best, order = {}, []
    for pos, cid, s in batch:
        if cid is None:
            continue
        s = 0.0 if s is None else s
        if cid not in best:
            best[cid] = (pos, s)
        elif how == "max_base" and s > best[cid][1]:
            best[cid] = (pos, s)
    return sorted(p for p, _ in best.values())


def test_merge_matches_a_sequential_fold(ctx, spark):
    rng = random.Random(1)
    batch = [(i, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, NAN, 0.0, -1.0, 0.5, 0.5, 2.0, float("inf")])) for i in range(400)]
    df = spark.createDataFrame(batch, SCHEMA).repartition(3)
    for how in ("first", "max_base"):
        assert [r[0] for r in rows(core.merge(ctx, [df], {"dedup": how}), POSITION)] == fold(batch, how)


def test_merge_edges(ctx, spark):
    df = spark.createDataFrame([(0, 1, 0.5)], SCHEMA)
    assert core.merge(ctx, [df.drop("cand_candidate_id")], {}).count() == 0
    assert core.merge(ctx, [df.withColumn("cand_candidate_id", F.lit("1"))], {}).count() == 0
    assert core.merge(ctx, [df.where("false")], {"dedup": "max_base"}).columns == df.columns
    assert core.merge(ctx, [df.drop("score_base")], {"dedup": "max_base"}).count() == 1
    with pytest.raises(NodeError):
        core.merge(ctx, [df], {"dedup": "last"})
    assert core.merge(Context(spark, strict=False), [df], {"dedup": "last"}).count() == 1


def test_merge_of_several_inputs_keeps_input_order(ctx, spark):
    a = spark.createDataFrame([(5, 1, 0.5), (6, 2, 0.1)], SCHEMA)
    c = spark.createDataFrame([(0, 1, 0.9), (1, 3, 0.2)], SCHEMA).withColumn("score_ml", F.lit(1.0).cast("float"))
    assert rows(core.merge(ctx, [a, c], {}), "cand_candidate_id", "score_base", "score_ml") == [(1, 0.5, None), (2, pytest.approx(0.1), None), (3, pytest.approx(0.2), 1.0)]
    assert rows(core.merge(ctx, [a, c], {"dedup": "max_base"}), "cand_candidate_id") == [(2,), (1,), (3,)]


def test_features(ctx, spark):
    df = spark.createDataFrame([(0, 150, 0.5), (1, None, 0.5), (2, -30, 0.5)], SCHEMA)
    out = core.features(ctx, [df], {"keys": [2001, 2002, 4001]})
    got = rows(out, "feat_freshness", F.size("feat_embedding"), "penalty_constraints")
    assert got == [(0.5, 128, 0.0), (0.5, 128, 0.0), (pytest.approx(-0.3), 128, 0.0)]
    assert core.features(ctx, [df], {}) is df
    assert rows(core.features(ctx, [df.drop("cand_candidate_id")], {"keys": [2001]}), "feat_freshness") == [(0.5,)] * 3
    for bad in ([1001], [77]):
        with pytest.raises(NodeError):
            core.features(ctx, [df], {"keys": bad})
    loose = core.features(Context(spark, strict=False), [df], {"keys": [1001, 77]})
    assert dict(loose.dtypes)["cand_candidate_id"] == "float"


def test_model_and_formula(ctx, spark):
    df = spark.createDataFrame([(0, 50, 0.5), (1, None, None)], SCHEMA)
    out = core.model(ctx, [core.features(ctx, [df], {"keys": [2001]})], {"name": "any"})
    assert rows(out, "score_ml") == [(pytest.approx(0.5),), (pytest.approx(0.2),)]
    assert rows(core.model(ctx, [df], {}), "score_ml") == [(pytest.approx(0.3),), (0.0,)]
    assert rows(core.score_formula(ctx, [df], {}), "score_final") == [(0.5,), (0.0,)]
    assert rows(core.score_formula(ctx, [df], {"expr": E.const(2), "output_key_id": 3003}), "score_adjusted") == [(2.0,)] * 2
    with pytest.raises(ValueError):
        core.score_formula(ctx, [df], {"expr": {"op": "nope"}})
    assert rows(core.score_formula(Context(spark, strict=False), [df], {"expr": {"op": "nope"}}), "score_final") == [(0.0,)] * 2
    for bad in (3005, 1001):
        with pytest.raises(NodeError):
            core.score_formula(ctx, [df], {"output_key_id": bad})


def test_extension_nodes(ctx, spark):
    df = spark.createDataFrame([(0, 3, 0.2), (1, 1, 0.9), (2, 2, 0.9), (3, 4, None)], SCHEMA)
    scored = core.score_formula(ctx, [df], {})
    assert rows(extensions.topk(ctx, [scored], {"k": 3}), "cand_candidate_id", POSITION) == [(1, 0), (2, 1), (3, 2)]
    assert rows(extensions.filter_rows(ctx, [df], {"expr": E.signal(3001), "above": 0.5}), "cand_candidate_id") == [(1,), (2,)]
    assert rows(extensions.limit(ctx, [df], {"n": 2}), "cand_candidate_id") == [(3,), (1,)]
    assert extensions.limit(ctx, [df], {}).count() == 4
    assert [round(r[0], 3) for r in rows(extensions.normalize(ctx, [df], {}), "score_adjusted")] == [0.222, 1.0, 1.0, 0.0]
    assert {r[0] for r in rows(extensions.normalize(ctx, [df.where("cand_candidate_id in (1, 2)")], {}), "score_adjusted")} == {0.5}
    assert extensions.normalize(ctx, [df.where("false")], {}).count() == 0
    assert extensions.union(ctx, [df, df], {}).count() == 8
    both = rows(extensions.weighted_union(ctx, [df, df.where("cand_candidate_id > 2")], {"weights": [0.5, 0.25]}), "cand_candidate_id", "score_base")
    assert both == [(3, pytest.approx(0.15)), (1, pytest.approx(0.45)), (2, pytest.approx(0.45)), (4, 0.0)]
    assert extensions.sample(ctx, [df], {"rate": 1.0, "keys": [3001]}).columns == [POSITION, "score_base"]
    assert extensions.sample(ctx, [df], {"rate": 0.0}).count() == 0
    ctx.tables["side"] = spark.createDataFrame([(1, 5.0), (1, 5.0), (None, 1.0), (4, 2.0)], "k long, v double")
    joined = extensions.join_features(ctx, [df], {"table": "side", "on": "k", "keys": {2001: "v"}})
    assert rows(joined, "cand_candidate_id", "feat_freshness") == [(3, None), (1, 5.0), (2, None), (4, 2.0)]
    for node in (extensions.table, extensions.join_features):
        with pytest.raises(NodeError):
            node(ctx, [df], {"table": "none"})


def test_registry_of_operators():
    ops = default_operators()
    assert ops.has("core:merge") and not ops.has("core:sort") and ops.get("nope") is None
    assert [s.namespace for s in ops.all()] == sorted(s.namespace for s in ops.all())
    with pytest.raises(NodeError):
        ops.register(ops.get("core:merge"))
    with pytest.raises(NodeError):
        NodeSpec("ext:x", "ext.x", lambda *a: None, stability="experimental")
    with pytest.raises(NodeError):
        NodeSpec("ext:x", "experimental.x", lambda *a: None)
    assert Operators().all() == []


def test_filters_and_pruning_reach_the_scan(spark, sf_dir, ctx):
    from ranklume.queries import context, parts

    step = parts(Pipeline()).core.features(keys=[2001]).core.model().core.score_formula(expr=E.signal(3002))
    df = execute(compile_plan(step.plan()), context(spark, sf_dir, "part")).where("cand_candidate_id > 50").select("cand_candidate_id", "score_final")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_partkey,50)" in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_math_is_float(ctx):
    df = core.sourcer(ctx, [], {"k": 7})
    got = [r[0] for r in rows(df, "score_base")]
    import numpy as np

    assert got == [float(np.float32(1) - np.float32(i) / np.float32(7)) for i in range(7)]
    assert not any(map(math.isnan, got)) and KeyRegistry.default().by_id(3001).type == "f32"


def test_merge_combines_before_its_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias(POSITION), (F.col("id") % 3).alias("cand_candidate_id"), F.col("id").cast("float").alias("score_base"))
    for how in ("first", "max_base"):
        plan = core.merge(Context(spark), [df], {"dedup": how})._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("min_by") >= 2  # a partial and a final aggregate


def test_join_features_takes_the_smallest_row(spark):
    from ranklume.operators import extensions

    df = spark.createDataFrame([(0, 1), (1, 2)], f"{POSITION} long, cand_candidate_id long")
    side = spark.createDataFrame([(1, 0.5), (1, 0.25), (1, 0.75), (None, 9.0)], "id long, v float")
    out = extensions.join_features(Context(spark, tables={"t": side}), [df], {"table": "t", "on": "id", "keys": {3001: "v"}})
    assert sorted((r["cand_candidate_id"], r["score_base"]) for r in out.collect()) == [(1, 0.25), (2, None)]
