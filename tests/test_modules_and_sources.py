"""User modules, budgets, policies, CSV, sinks and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklume.keys import POSITION, KeyRegistry
from ranklume.operators import Context
from ranklume.operators.python_module import ModuleError, apply_module, load_module, make_module, run_on
from ranklume.plans import Pipeline, compile_plan, execute
from ranklume.sources import IoBudget, IoError, Policy, check_resource, dump_lines, read_csv, read_csv_frame, write_result
from ranklume.sources.sinks import format_value
from ranklume.streaming import check_row_local, merge_stream, run_batches, stream

REG = KeyRegistry.default()
SCHEMA = f"{POSITION} long, cand_candidate_id long, score_base float"


@pytest.fixture
def batch3(spark):
    return spark.createDataFrame([(2, 300, 3.0), (0, 100, 1.0), (1, 200, 2.0)], SCHEMA)


def values(df, column):
    return [r[0] for r in df.orderBy(POSITION).select(column).collect()]


def module(run, **meta):
    return make_module({"name": "m", "version": "1", "reads": [3001], "writes": [3002], **meta}, run)


def constant(batch, ctx, params):
    batch.write_f32(ctx.keys.SCORE_ML)[:] = 42.0


def test_module_writes(spark, batch3):
    ctx = Context(spark)
    for scope in ("row", "batch"):
        out = apply_module(module(constant, scope=scope), ctx, batch3, {})
        assert values(out, "score_ml") == [42.0] * 3 and values(out, "cand_candidate_id") == [100, 200, 300]
        assert dict(out.dtypes)["score_ml"] == "float"
    assert apply_module(module(constant), ctx, batch3.where("false"), {}).count() == 0


def test_batch_modules_see_all_rows_in_order(spark, batch3):
    def ranks(batch, ctx, params):
        batch.write_i64(1001)[:] = np.arange(batch.row_count()) + params["from"]
        batch.write_f32(3002)[:] = batch.f32(3001) / batch.f32(3001).sum()

    out = apply_module(module(ranks, writes=[1001, 3002]), Context(spark), batch3.repartition(3), {"from": 10})
    assert values(out, "cand_candidate_id") == [10, 11, 12] and values(out, "score_ml") == pytest.approx([1 / 6, 2 / 6, 3 / 6])


def run(m, rows, params=None, policy=None):
    import pandas as pd

    return run_on(m, pd.DataFrame(rows), REG, policy, params or {})


@pytest.mark.parametrize(
    "write,message",
    [
        (lambda b: b.write_f32(3003), r"3003 \(score.adjusted\) not allowed - not in meta.writes"),
        (lambda b: b.write_f32(7777), "Unknown key: 7777"),
        (lambda b: b.write_i64(3002), "Type mismatch"),
        (lambda b: [b.write_f32(3002) for _ in range(3)], "max_write_cells"),
        (lambda b: b.write_f32vec(2002, 100), "max_write_bytes"),
        (lambda b: b.f32(3002), "not in meta.reads"),
    ],
)
def test_what_modules_may_not_do(write, message):
    m = make_module({"name": "m", "reads": [3001], "writes": [3002, 7777, 2002], "budget": {"max_write_cells": 250, "max_write_bytes": 2000}}, lambda b, c, p: write(b))
    with pytest.raises(ModuleError, match=message):
        run(m, {"score_base": np.zeros(100, "f4"), "score_ml": np.zeros(100, "f4")})


def test_reads():
    seen = {}

    def look(b, ctx, p):
        seen.update(n=b.row_count(), f=b.f32(3001), i=b.i64(1001), wrong=b.i64(3001), absent=b.f32(3003), v=b.f32vec(2002), info=ctx.key_info.SCORE_ML)

    import pandas as pd

    run(make_module({"name": "m", "reads": [3001, 1001, 3003, 2002]}, look), {"score_base": pd.Series([1.0, None], dtype="Float32"), "cand_candidate_id": pd.Series([5, None], dtype="Int64"), "feat_embedding": [[1.0, 2.0], None]})
    assert seen["n"] == 2 and seen["f"].tolist() == [1.0, 0.0] and seen["i"].tolist() == [5, 0]
    assert seen["wrong"] is None and seen["absent"] is None and seen["v"].tolist() == [[1, 2], [0, 0]] and seen["info"]["type"] == "f32"


def test_batch_size_is_bounded_by_the_write_budget(spark):
    df = spark.range(100).select(F.col("id").alias(POSITION), F.col("id").alias("cand_candidate_id"), F.lit(1.0).cast("float").alias("score_base"))
    with pytest.raises(ModuleError, match="max_write_cells"):
        apply_module(module(constant, budget={"max_write_cells": 10}), Context(spark), df, {})
    with pytest.raises(ModuleError, match="max_write_bytes"):
        apply_module(module(constant, budget={"max_write_bytes": 100}), Context(spark), df, {})


def many(spark, n):
    return spark.range(n).repartition(4).select(F.col("id").alias(POSITION), F.col("id").alias("cand_candidate_id"), F.lit(1.0).cast("float").alias("score_base"), F.lit("x").alias("other"))


def test_budgets_of_row_modules_are_for_all_rows(spark):
    def twice(batch, ctx, params):
        batch.write_f32(3002), batch.write_f32(3003)

    fine = module(constant, scope="row", budget={"max_write_cells": 20_000})
    assert apply_module(fine, Context(spark), many(spark, 20_000), {}).where("score_ml = 42").count() == 20_000
    with pytest.raises(ModuleError, match="max_write_cells"):
        apply_module(module(constant, scope="row", budget={"max_write_cells": 15_000}), Context(spark), many(spark, 20_000), {})
    with pytest.raises(Exception, match="max_write_cells"):  # the second write goes beyond, in whatever part it is
        apply_module(module(twice, scope="row", writes=[3002, 3003], budget={"max_write_cells": 30_000}), Context(spark), many(spark, 20_000), {}).collect()


ONE_FLOAT = {"max_write_bytes_per_row": 4, "max_write_cells_per_row": 1}


def test_budgets_a_row_hold_for_any_number_of_rows(spark):
    def twice(batch, ctx, params):
        batch.write_f32(3002), batch.write_f32(3003)

    assert apply_module(module(constant, scope="row", budget=ONE_FLOAT), Context(spark), many(spark, 100_001), {}).where("score_ml = 42").count() == 100_001
    for budget, message in ((ONE_FLOAT | {"max_write_cells_per_row": 2}, "max_write_bytes_per_row"), (ONE_FLOAT | {"max_write_bytes_per_row": 8}, "max_write_cells_per_row"), (ONE_FLOAT | {"max_write_cells": 10}, "max_write_cells")):
        with pytest.raises(Exception, match=message):
            apply_module(module(twice, scope="row", writes=[3002, 3003], budget=budget), Context(spark), many(spark, 20), {}).collect()
    for more in ({"budget": ONE_FLOAT}, {"totals": {"low": ("min", 3001)}}):
        with pytest.raises(ModuleError, match="scope 'row'"):  # all rows in one task stay bounded
            module(constant, **more)


def test_totals_are_over_all_rows(spark):
    def ends(batch, ctx, params):
        t = ctx.totals
        assert t.absent is None and t.low.dtype == np.float32
        batch.write_f32(3002)[:] = t.low
        batch.write_f32(3003)[:] = t.high
        batch.write_i64(1001)[:] = t.last

    totals = {"low": ("min", 3001), "high": ("max", 3001), "last": ("max", 1001), "absent": ("min", 4001)}
    m = module(ends, scope="row", reads=[3001, 1001, 4001], writes=[3002, 3003, 1001], totals=totals)
    df = spark.createDataFrame([(i, 2**60 + i, {7: None, 8: float("nan")}.get(i, i / 10 + 0.1)) for i in range(40)], SCHEMA).repartition(8)
    out = apply_module(m, Context(spark), df, {})
    assert {tuple(r) for r in out.select("score_ml", "score_adjusted", "cand_candidate_id").collect()} == {(0.0, 4.0, 2**60 + 39)}  # null and NaN read as 0
    assert apply_module(m, Context(spark), df.where("false"), {}).count() == 0
    for bad, message in ((("median", 3001), "unknown function"), (("min", 3003), "not in meta.reads")):
        with pytest.raises(ModuleError, match=message):
            module(ends, scope="row", totals={"low": bad})
    with pytest.raises(ModuleError, match="isn't a f32 or i64"):
        apply_module(module(constant, scope="row", reads=[2002], totals={"low": ("min", 2002)}), Context(spark), df, {})


def test_undeclared_reads_raise_in_runs(spark, batch3):
    for key in (3003, 1001):
        for scope in ("row", "batch"):
            with pytest.raises(Exception, match="not in meta.reads"):
                apply_module(module(lambda b, c, p, key=key: b.f32(key), scope=scope), Context(spark), batch3, {}).collect()


def test_modules_without_writes_are_bounded(spark):
    look = lambda b, c, p: None
    with pytest.raises(ModuleError, match="max_write_cells"):
        apply_module(module(look, writes=[], budget={"max_write_cells": 10}), Context(spark), many(spark, 100), {})
    assert apply_module(module(look, writes=[], scope="row"), Context(spark), many(spark, 100), {}).count() == 100


def test_only_reads_travel_to_row_modules(spark, tmp_path):
    many(spark, 50).write.parquet(str(tmp_path / "t"))
    out = apply_module(module(constant, scope="row"), Context(spark), spark.read.parquet(str(tmp_path / "t")), {}).where("cand_candidate_id < 5").select("score_ml")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1] and "LessThan(cand_candidate_id,5)" in plan and out.count() == 5


def test_unwritten_keys_keep_their_values(spark, batch3):
    df = batch3.withColumn("score_ml", F.lit(7.0).cast("float"))
    some = lambda b, c, p: b.write_f32(3003)
    for scope in ("row", "batch"):
        out = apply_module(module(some, writes=[3002, 3003], scope=scope), Context(spark), df, {})
        assert values(out, "score_ml") == [7.0] * 3 and values(out, "score_adjusted") == [0.0] * 3


def test_csv_node(spark, assets):
    step = lambda r: Pipeline().ext.csv(resource=r, keys={1001: "cast(id as long)", 3001: "cast(score as float)"})
    run_ = lambda policy, r="sample.csv": execute(compile_plan(step(r).plan()), Context(spark, policy=policy))
    allowed = Policy(assets, ({"name": "ext.csv", "allow_io_csv_read": True},))
    assert [(r["cand_candidate_id"], round(r["score_base"], 1)) for r in run_(allowed).orderBy(POSITION).collect()] == [(1, 0.9), (2, 0.8), (3, 0.7)]
    for policy, resource in ((None, "sample.csv"), (Policy(assets), "sample.csv"), (allowed, "../sample.csv")):
        with pytest.raises(IoError):
            run_(policy, resource)


def test_module_time_limit(spark):
    def spin(b, c, p):
        while True:
            pass

    with pytest.raises(ModuleError, match="exceeded"):
        run(module(spin, time_limit_s=0.2), {"score_base": [1.0]})


def test_module_files(tmp_path, spark):
    path = tmp_path / "double.py"
    path.write_text("META = {'name': 'double', 'version': '2', 'reads': [3001], 'writes': [3002], 'params': {'by': 'float'}, 'scope': 'row'}\ndef run_batch(batch, ctx, params):\n    batch.write_f32(3002)[:] = batch.f32(3001) * params['by']\n")
    m = load_module(path)
    assert m.op.startswith(f"py:{path}@2#") and len(m.op.rpartition("#")[2]) == 16
    step = Pipeline().core.sourcer(k=2).py.module(module=str(path), by=2.0)
    assert values(execute(compile_plan(step.plan()), Context(spark)), "score_ml") == [2.0, 1.0]
    with pytest.raises(ModuleError, match="unknown params"):
        execute(compile_plan(Pipeline().core.sourcer(k=2).py.module(module=str(path), to=2.0).plan()), Context(spark))
    with pytest.raises(FileNotFoundError):
        load_module(tmp_path / "none.py")
    with pytest.raises(ModuleError, match="module"):
        execute(compile_plan(Pipeline().core.sourcer(k=2).py.module().plan()), Context(spark))
    for bad, why in ((None, "META"), ({"name": "x"}, "run_batch")):
        with pytest.raises(ModuleError, match=why):
            make_module(bad, None)
    with pytest.raises(ModuleError, match="scope"):
        make_module({"name": "x", "scope": "all"}, constant)


# -- policy and CSV ------------------------------------------------------------


CSV = "id,name,score\n1,apple,0.9\n2,banana,0.8\n3,cherry,0.7\n"


@pytest.fixture
def assets(tmp_path):
    (tmp_path / "sample.csv").write_text(CSV)
    (tmp_path / "odd.csv").write_text('a, b ,a\n1,2,3\n\n4\n5,"6,7",8,9\n')
    return str(tmp_path)


def test_policy():
    p = Policy.from_json(json.dumps({"csv_assets_dir": "d", "modules": [{"name": "a", "version": "2", "allow_io_csv_read": True}, {"name": "b", "allow_io_csv_read": True}, {"name": "b", "version": "1"}, {"name": "c"}]}))
    assert p.assets_dir == "d" and p.allows_csv("a", "2") and not p.allows_csv("a", "1") and p.allows_csv("b", "1") and not p.allows_csv("c") and not p.allows_csv("z")
    assert not Policy().allows_csv("a") and Policy().assets_dir == "njs/assets/csv"
    with pytest.raises(ValueError):
        Policy.from_json("{")


def test_io_capability(assets):
    def count(b, ctx, p):
        b.write_f32(3002)[:] = ctx.io.read_csv("sample.csv")["rowCount"] if hasattr(ctx, "io") else -1

    caps = {"capabilities": {"io": {"csv_read": True}}, "budget": {"max_io_read_bytes": 1000, "max_io_read_rows": 10}}
    allowed = Policy(assets, ({"name": "m", "allow_io_csv_read": True},))
    result = lambda m, policy: run(m, {"score_base": [1.0]}, policy=policy).written[3002].tolist()
    assert result(module(count, **caps), allowed) == [3.0]
    assert result(module(count, **caps), None) == result(module(count, **caps), Policy(assets)) == result(module(count, budget=caps["budget"]), allowed) == [-1.0]
    assert result(module(count, **(caps | {"capabilities": ["io"]})), allowed) == [-1.0]
    with pytest.raises(IoError, match="IO budget not configured"):
        result(module(count, capabilities=caps["capabilities"]), allowed)


@pytest.mark.parametrize("resource,message", [("../../../etc/passwd", "Path traversal not allowed"), ("/etc/passwd", "Absolute paths not allowed"), ("\\x", "Absolute paths not allowed"), ("a\\b", "Backslash not allowed")])
def test_path_guard(resource, message):
    with pytest.raises(IoError, match=message):
        check_resource(resource)


def test_read_csv(assets):
    assert read_csv(assets, "sample.csv", IoBudget(1000, 10)) == {"columns": {"id": ["1", "2", "3"], "name": ["apple", "banana", "cherry"], "score": ["0.9", "0.8", "0.7"]}, "rowCount": 3}
    odd = read_csv(assets, "odd.csv", IoBudget(1000, 10))
    assert odd == {"columns": {"a": ["3", "", "", '7"'], "b": ["2", "", "", '"6']}, "rowCount": 4}
    budget = IoBudget(60, 100)
    read_csv(assets, "sample.csv", budget)
    assert budget.bytes_read == len(CSV) and budget.rows_read == 3
    with pytest.raises(IoError, match="max_io_read_bytes"):
        read_csv(assets, "sample.csv", budget)
    with pytest.raises(IoError, match="max_io_read_rows"):
        read_csv(assets, "sample.csv", IoBudget(1000, 2))
    with pytest.raises(FileNotFoundError):
        read_csv(assets, "none.csv", IoBudget(1, 1))


def test_csv_frame_has_the_same_rows(spark, assets):
    for name in ("sample.csv", "odd.csv"):
        want = read_csv(assets, name, IoBudget(10**6, 10**6))["columns"]
        got = read_csv_frame(spark, f"{assets}/{name}").collect()
        assert {c: [r[c] for r in got] for c in want} == want
    open(f"{assets}/empty.csv", "w").close()
    assert read_csv_frame(spark, f"{assets}/empty.csv").count() == 0


def test_sinks(spark, batch3, tmp_path):
    df = batch3.withColumn("score_final", F.col("score_base") / 2).withColumn("score_final", F.col("score_final").cast("float"))
    assert dump_lines(df, REG, 2) == ["[0] candidate_id=100, score.final=0.5000", "[1] candidate_id=200, score.final=1.0000"]
    assert dump_lines(batch3.drop("cand_candidate_id"), REG)[2] == "[2] candidate_id=0, score.final=0.0000"
    write_result(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert [format_value(v) for v in (None, True, 0.1, 3, "x", b"ab", [1.0])] == ["null", "true", "0.1", "3", '"x"', "<bytes len=2>", "<f32vec len=1>"]


# -- streams ----------------------------------------------------------------------


@pytest.fixture
def event_stream(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def keyed(step):
    return step.ext.table(table="events", keys={1001: "user_id", 3001: "cast(value as float)"}, position="event_id")


def test_row_local_plans_stream(spark, event_stream, sf_dir):
    plan = compile_plan(keyed(Pipeline()).core.features(keys=[2001]).core.model().plan())
    df = stream(plan, Context(spark, tables={"events": event_stream}))
    q = df.select(POSITION, "score_ml").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = execute(plan, Context(spark, tables={"events": spark.read.parquet(f"{sf_dir}/events.parquet")}))
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, want.select(POSITION, "score_ml").collect()))
    with pytest.raises(ValueError, match="whole batches"):
        check_row_local(compile_plan(keyed(Pipeline()).core.merge().plan()))


def test_merge_stream_and_batches(spark, event_stream, tmp_path, sf_dir):
    rows = event_stream.select("ts", F.col("user_id").alias("cand_candidate_id"))
    q = merge_stream(rows, Context(spark), "ts", "365 days").writeStream.format("memory").queryName("merged").trigger(availableNow=True).start()
    q.awaitTermination(120)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert spark.table("merged").count() == users
    plan = compile_plan(keyed(Pipeline()).core.merge(dedup="max_base").plan())
    q = run_batches(event_stream, "events", plan, Context(spark), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/*").select("cand_candidate_id").distinct().count() == users
