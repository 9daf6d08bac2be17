"""Shared pieces: the shared folder, reliable materialisation, word classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the whitespace tokenisation, as a Java / RE2 pattern.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: An input with less than this for each core is small.
SPREAD_BYTES = 4 << 20
#: Spark's switch that removes shuffle files when the query that wrote them ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a master in this very
    process (local tests) gets a temporary folder, made once and set as the
    checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ranklume-shared-"))
    return sc.getCheckpointDir()


def new_shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    Cuts the lineage with files that outlive any executor.  It also gives the
    result no known partitioning, so a join on it gets an exchange on both
    sides and adaptive execution can split a hot key.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`settled`, for larger results: as Parquet, which is smaller than a checkpoint."""
    path = new_shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder; those not kept are deleted at its end.

    The shuffle files of a write are given back as soon as it is done.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        """:func:`stored`, until it is dropped or the computation ends."""
        path = new_shared_path(self._spark, "scratch")
        out = self._written(df, path)
        self._paths[id(out)] = (out, path)
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """:func:`stored`, left in place for the reader of the result."""
        return self._written(df, new_shared_path(self._spark, "stored"))

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        before = self._spark.conf.get(CLEAN_SHUFFLES, "false")
        self._spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self._spark.conf.set(CLEAN_SHUFFLES, before)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._paths.pop(id(df))
            self._delete(path)

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in list(self._paths.values())))

    def _delete(self, path: str) -> None:
        sc = self._spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may be a single block of a file, dealt over the cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def hash60(col) -> F.Column:
    """60 uniform bits of a string (null: empty), the same in any SQL engine."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def long_array(values) -> str:
    """SQL text of a literal array of bigints."""
    return "array(" + ",".join(f"{int(v)}L" for v in values) + ")" if len(values) else "cast(array() as array<bigint>)"


def hash_sample(df: DataFrame, n: int, size: int, *keys: str) -> DataFrame:
    """About ``size`` of ``n`` rows, those whose keys have small hashes; the same in every run.

    A filter, so no partition holds or sends more than its share; the limit, a
    tenth above the expected size, bounds what the driver gets.
    """
    if n <= size:
        return df
    share = (F.xxhash64(F.lit(1), *keys).bitwiseAND(F.lit((1 << 40) - 1))) < int((1 << 40) * size / n)
    return df.where(share).limit(size + size // 10 + 100)
