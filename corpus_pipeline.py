"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, shards.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklume.llm import decontaminate, mixing, quality, sharding, simhash
from ranklume.llm.common import new_shared_path, stored
from ranklume.llm.queries import QUALITY_BOUND, table


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number, and the name of its column.

    They are stored, so that the number of a row is the same each time it is
    read: how a scan is split can change between two plans.
    """
    name = free_name(docs, "_row")
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    trees, name = quality.train(docs, table(spark, sf_dir, "labels")), free_name(docs, "_quality")
    return quality.score(docs, trees, score_col=name).where(F.col(name) >= QUALITY_BOUND).drop(name)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the row with the smallest id (null ids last)."""
    rows, row = numbered(docs)
    found = simhash.near_duplicates(rows, id_col=row, name_col="doc_id", radius=4)
    first = found.groupBy("component_root").agg(F.min(F.struct(F.col("name").isNull(), "name", row)).alias("x")).select(f"x.{row}")
    return rows.join(first, row).select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    rows, row = numbered(docs)
    taken = mixing.mix(rows, 1.5, id_col=row, key_col="doc_id").where(F.col("taken") > 0)
    times, copy = free_name(docs, "_times"), free_name(docs, "_copy")
    taken = taken.select(row, F.floor(F.col("taken") / F.col("size")).cast("int").alias(times))
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def cut_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.assign_shards(docs, 24)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", cut_into_shards),
]

#: The classifier is trained, so SQL can't give the rows; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage's result is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
