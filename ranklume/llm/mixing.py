"""Mixing sources to target weights (DataFrame operations only).

Every source gets a token target: its weight's share of the budget, at most
``max_epochs`` times its size, what is cut off being reshared by weight.  A
source is then used in complete epochs; what remains is filled by
Efraimidis-Spirakis sampling without replacement: each document draws the key
-ln(u) / weight, documents are taken in key order, and the prefix sum of their
sizes decides where the budget ends (a document is taken if at least half of it
fits, so the miss is at most half a document).

A source may hold most rows, so prefix sums are two-level: keys are bucketed
monotonically, (source, bucket) sums are prefix-summed, and only the bucket in
which the budget ends is ordered row by row.  There are more buckets for more
rows.  Rows with equal id, text and source have equal keys; in that bucket they are
counted, not ordered.

Nulls: a null text has size 0 and is taken 0 times its size; a null source is a
source of its own, last in order; a null id is hashed as the empty string.
Repeated rows are separate rows.  Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, settled, spread

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
TWO52 = 1 << 52
#: So many equal rows at most are dealt out from one array.
EQUAL_ROWS = 10_000
#: Characters that are rare in prose.
SYMBOLS = "#$%&*+=@^_|<>[]{}/~0123456789"


def quality_weight(text: F.Column, size: F.Column) -> F.Column:
    """Prose-likeness from document statistics: words of about 6 characters, and few symbols and digits, score 1."""
    n = F.char_length(text)
    plain = F.char_length(F.translate(text, SYMBOLS, "")) / n
    return F.when(size == 0, F.lit(1.0)).otherwise((0.01 + 0.99 * plain * plain) / (1.0 + F.abs(n / size - 6.0)))


def targets(sources: DataFrame, share: float, weights=WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """``sk, s_size`` -> also ``target``: capped shares with the excess reshared.

    Resharing by weight until nothing is above its cap is water-filling: with
    sources ordered by cap / weight, the first k are at their caps and the rest
    share what is left, for the smallest consistent k.  One row a source.
    """
    kinds = "array(" + ",".join(f"{w}D" for w in weights) + ")"
    rank = F.row_number().over(Window.orderBy("sk")) - 1
    s = sources.withColumn("w", F.element_at(F.expr(kinds), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("s_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    order, every = Window.orderBy("ratio", "sk"), Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("budget", F.sum("s_size").over(every) * share).withColumn("caps_below", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_left", F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w"))
    # the level if this source and those after it share what is left
    s = s.withColumn("level", (F.col("budget") - F.col("caps_below")) / F.col("w_left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sk", "level"))).over(every)["level"]
    s = s.withColumn("free", level)
    return s.select("sk", "s_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = 2, seed: str = "mix", buckets: int = 1024, rows_per_bucket: int = 250_000, weight: F.Column | None = None, key_col: str | None = None) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row.

    Keys are drawn from hashes of ``key_col``, by default the id, and of the text, so
    reruns agree.  There are ``buckets`` buckets a source at least, and as many as
    it takes for a source of all rows to have about ``rows_per_bucket`` in each.
    ``weight`` is the document's quality weight, a positive column of ``docs``;
    by default :func:`quality_weight`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    needed = dict.fromkeys((id_col, source_col, text_col, key_col or id_col))
    docs = docs.select(*needed, *([weight.alias("_weight")] if weight is not None else []))
    sized = spread(docs).select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("sk"),
        F.regexp_count(text, F.lit(SPACE_WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key_col or id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long").alias("u"),
        (F.col("_weight").cast("double") if weight is not None else quality_weight(text, F.regexp_count(text, F.lit(SPACE_WORD)))).alias("w"),
    )
    keyed = settled(sized.select("id", "sk", "size", (-F.log((F.col("u") + 0.5) / TWO52) / F.col("w")).alias("e")))
    buckets = max(buckets, -(-keyed.count() // rows_per_bucket))
    keyed = keyed.withColumn("b", F.least(F.lit(buckets - 1), F.floor((1.0 - F.exp(-F.col("e") / 3.0)) * buckets)).cast("int"))

    cells = settled(keyed.groupBy("sk", "b").agg(F.sum("size").alias("c_size")))
    aims = targets(cells.groupBy("sk").agg(F.sum("c_size").alias("s_size")), share, weights, max_epochs)
    aims = aims.withColumn("epochs", F.when(F.col("s_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("s_size")))).withColumn("rest", F.col("target") - F.col("epochs") * F.col("s_size"))
    below = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = settled(cells.withColumn("c0", F.coalesce(F.sum("c_size").over(below), F.lit(0))).join(aims, "sk"))

    rows = keyed.join(cells, ["sk", "b"])
    cut = (F.col("c0") < F.col("rest")) & (F.col("rest") < F.col("c0") + F.col("c_size"))
    inside = Window.partitionBy("sk", "b").orderBy("e", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(cut).groupBy("id", "sk", "b", "e", "size", "c0", "s_size", "target", "epochs", "rest").agg(F.count("*").alias("times"))
    edge = edge.withColumn("before", F.col("c0") + F.sum(F.col("size") * F.col("times")).over(inside) - F.col("size") * F.col("times"))
    # of equal rows, so many are taken as one by one would be
    most = F.when(F.col("size") == 0, F.col("times")).otherwise(F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5))
    edge = edge.withColumn("taken_times", F.greatest(F.lit(0), F.least(F.col("times"), most)))
    edge = edge.withColumn("some", F.explode(F.expr(f"sequence(0, (times - 1) div {EQUAL_ROWS})"))).withColumn("place", F.explode(F.expr(f"sequence(some * {EQUAL_ROWS}, least(times, (some + 1) * {EQUAL_ROWS}) - 1)")))
    edge = edge.withColumn("more", (F.col("place") < F.col("taken_times")).cast("long"))
    plain = rows.where(~cut).withColumn("more", (F.col("c0") + F.col("c_size") <= F.col("rest")).cast("long"))
    columns = ["id", "size", "s_size", "target", "epochs", "more"]
    return plain.select(columns).unionByName(edge.select(columns)).select(F.col("id").alias(id_col), "size", F.col("s_size").alias("source_size"), "target", (F.col("size") * (F.col("epochs") + F.col("more"))).cast("long").alias("taken"))
