"""Sharding by sampled splitters (DataFrame operations only).

All rows are put in one total order -- hash of the text, hash of the id, id --
and that order is cut into shards of near-equal bytes.  The order is realised
without a global sort:

1. a size-weighted key sample (every row's exponential key against one bound,
   chosen for an expected size) gives quantile boundaries of the text hash; a value that fills several quantiles
   is a hot group and gets a range of its own;
2. every row goes to its range; a range that is overfull because of one hot
   group is subdivided by the id hash, and what one id fills of that by a row
   number (rows with equal id and text are interchangeable);
3. bytes and rows per range, a small table, are prefix-summed; windows inside
   the ranges add the rest, so positions are exact whatever the sample was.

Equal texts stay in one shard unless the group is larger than ``whole_share``
of a shard; larger groups are cut at byte targets like single rows.

Nulls: a null text is an empty one of size 8; a null id is ordered as the empty
string.  Repeated rows are separate rows of one group.  Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, long_array, settled

TWO60 = 1 << 60


def splitters(keys: list[int], ranges: int) -> list[int]:
    """Quantile boundaries of sorted sample keys; a repeated boundary is isolated."""
    keys, out = sorted(keys), set()
    at = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    for prev, key in zip([None, *at], at):
        out.add(key)
        if key == prev:
            out.add(key + 1)
    return sorted(out)


def range_of(key: str, bounds: list[int]) -> F.Column:
    """Number of boundaries at or below ``key``; two levels of about sqrt(n) compares."""
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not rows:
        return F.lit(0)
    coarse = f"size(filter({long_array([r[0] for r in rows])}, s -> s <= {key}))"
    fine = "array(" + ",".join(long_array(r) for r in rows) + ")"
    return F.expr(f"case when {coarse} = 0 then 0 else ({coarse} - 1) * {step} + size(filter(element_at({fine}, {coarse}), s -> s <= {key})) end")


def assign_shards(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int = 1024, samples_per_range: int = 16, rows_per_range: int = 1_000_000, whole_share: float = 0.01
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by bytes.

    ``ranges`` is the least number of ranges; more are used so that each holds
    about ``rows_per_range`` rows.  The sample holds about ``samples_per_range``
    keys a range, whatever the input's size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = settled(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), hash60(text).alias("k1"), hash60(F.col(id_col)).alias("k2"), F.monotonically_increasing_id().alias("at")))
    n, total = base.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    ranges = min(max(ranges, -(-n // rows_per_range)), 65_536)
    target = max(1.0, n / ranges)
    weight = F.col("size") + total / max(1, n)
    # exponential keys: below a small bound c, a share of about c * weight of the rows; the weights add up to 2 * total
    expo = -F.log((F.hash("k2", "k1").cast("double") + 2147483648.5) / 4294967296.0) / weight
    sample = [r[0] for r in base.where(expo <= ranges * samples_per_range / (2.0 * total)).select("k1").collect()]

    ranged = base.withColumn("rng", range_of("k1", splitters(sample, ranges)))
    fill = ranged.groupBy("rng").agg(F.count("*").alias("n"), F.sum("size").alias("r_bytes"), (F.min("k1") == F.max("k1")).alias("alone"))
    # at most 2 * ranges rows, and only the overfull ones matter
    hot = fill.where(F.col("alone") & (F.col("n") > 2 * target)).select("rng", "r_bytes", F.ceil(F.col("n") / target).alias("parts"))
    cut = ranged.join(F.broadcast(hot), "rng", "left").withColumn("sub", F.coalesce(F.floor(F.col("k2") / TWO60 * F.col("parts")), F.lit(0)).cast("int"))
    same_id = cut.where("parts is not null").groupBy("rng", "sub").agg(F.count("*").alias("n"), (F.min("k2") == F.max("k2")).alias("alone"))
    same_id = same_id.where(F.col("alone") & (F.col("n") > 2 * target)).select("rng", "sub", F.ceil(F.col("n") / target).alias("times"))
    cut = cut.join(F.broadcast(same_id), ["rng", "sub"], "left").withColumn("salt", F.coalesce(F.pmod("at", "times"), F.lit(0)).cast("int"))
    cut = settled(cut.withColumn("hot", F.col("parts").isNotNull()).select("id", "size", "crc", "k1", "k2", "rng", "sub", "salt", "hot"))

    cell = ["rng", "sub", "salt"]
    order = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy(*cell).agg(F.count("*").alias("c_rows"), F.sum("size").alias("c_bytes"))
    cells = cells.withColumn("row0", F.coalesce(F.sum("c_rows").over(order), F.lit(0))).withColumn("byte0", F.coalesce(F.sum("c_bytes").over(order), F.lit(0)))
    whole = Window.partitionBy("rng")
    cells = cells.withColumn("hot_bytes", F.sum("c_bytes").over(whole)).withColumn("hot_byte0", F.min("byte0").over(whole))

    inside = Window.partitionBy(*cell).orderBy("k1", "k2", "id", "size")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    same = Window.partitionBy(*cell, "k1")
    placed = cut.withColumn("pos", before).withColumn("rn", F.row_number().over(inside) - 1).withColumn("g_bytes", F.sum("size").over(same)).withColumn("g_pos", F.min("pos").over(same))
    placed = placed.join(F.broadcast(cells.drop("c_rows", "c_bytes")), cell)
    g_bytes = F.when(F.col("hot"), F.col("hot_bytes")).otherwise(F.col("g_bytes"))
    g_start = F.when(F.col("hot"), F.col("hot_byte0")).otherwise(F.col("byte0") + F.col("g_pos"))
    together = g_bytes <= whole_share * total / n_shards
    twice_mid = F.when(together, 2 * g_start + g_bytes).otherwise(2 * (F.col("byte0") + F.col("pos")) + F.col("size"))
    shard = F.least(F.lit(n_shards - 1), F.floor((twice_mid * n_shards) / (2.0 * total))).cast("int")
    placed = settled(placed.select("id", "size", "crc", shard.alias("shard"), (F.col("row0") + F.col("rn")).alias("at")))

    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder a shard, rows in slot order (ids must be unique)."""
    placed = docs.join(assigned.select(id_col, "shard", "slot"), id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
