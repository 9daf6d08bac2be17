"""Every core query against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from ranklume.queries import QUERIES, SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(rows, columns):
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert plain([r.asDict() for r in df.collect()], columns) == plain([dict(zip(names, r)) for r in cursor.fetchall()], columns)


@pytest.mark.parametrize("name", ["udf_minmax_normalize", "udf_scale"])
def test_user_modules_take_tables_beyond_the_default_budget(spark, tmp_path, name):
    spark.range(100_001).selectExpr("id as p_partkey", "900 + id % 1000 / 10 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(SQL[name]).fetchall())


def test_csv_lookup_reads_a_file_on_a_cluster_too(spark, sf_dir, monkeypatch):
    import ranklume.queries as q

    paths, read = [], q.read_csv_frame
    monkeypatch.setattr(q, "read_csv_frame", lambda s, path: paths.append(path) or read(s, path))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    assert q.csv_lookup(spark, sf_dir).count() == 5 and len(paths) == 1


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["cand_candidate_id", "score_ml", "score_final"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_points_work_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "ranklume", tmp_path / "ranklume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline_full' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
