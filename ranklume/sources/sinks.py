"""Where results go: printed lines, files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compile import signal
from ..keys import POSITION, KeyRegistry


def lines(df: DataFrame, registry: KeyRegistry, n: int = 0) -> Iterator[str]:
    """The first ``n`` rows in batch order as printable lines; 0 is all of them, a partition at a time."""
    cid, final = registry.resolve(1001), registry.resolve(3999)
    id_column = F.coalesce(F.col(cid.column), F.lit(0)) if cid.column in df.columns else F.lit(0)
    rows = df.select(POSITION, id_column.alias("c"), signal(df.schema, final).alias("s")).orderBy(POSITION)
    for i, r in enumerate((rows.limit(n) if n else rows).toLocalIterator()):
        yield f"[{i}] candidate_id={r['c']}, score.final={r['s']:.4f}"


def dump_lines(df: DataFrame, registry: KeyRegistry, n: int = 0) -> list[str]:
    """:func:`lines` as a list, for small ``n`` or small results."""
    return list(lines(df, registry, n))


def write_result(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a result as Parquet, range-partitioned and sorted by position."""
    df.repartitionByRange(POSITION).sortWithinPartitions(POSITION).write.mode(mode).parquet(path)


def format_value(value: object) -> str:
    """A value as debug output shows it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, (bytes, bytearray)):
        return f"<bytes len={len(value)}>"
    if isinstance(value, (list, tuple)):
        return f"<f32vec len={len(value)}>"
    return str(value)
