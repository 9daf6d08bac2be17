"""Plain CSV assets under a policy, a path guard and a read budget.

The format is comma-split lines without quoting; cells are trimmed; short rows
are padded with empty cells and long ones cut; a blank line is a row of empty
cells; of equal headers the last one wins.  All cells are strings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIM = " \t\r\n"


class IoError(PermissionError):
    pass


@dataclass
class IoBudget:
    """What a module may read in all its reads; 0 is nothing at all."""

    max_bytes: int = 0
    max_rows: int = 0
    bytes_read: int = 0
    rows_read: int = 0


@dataclass(frozen=True)
class Policy:
    """Which modules may read CSV assets, and from where; the first entry of a name that fits decides."""

    assets_dir: str = "njs/assets/csv"
    modules: tuple[dict, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str) -> Policy:
        j = json.loads(text)
        return cls(j.get("csv_assets_dir", cls.assets_dir), tuple(j.get("modules") or ()))

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))

    def allows_csv(self, name: str, version: str = "") -> bool:
        for m in self.modules:
            if m.get("name", "") == name and m.get("version", "") in ("", version):
                return bool(m.get("allow_io_csv_read", False))
        return False


def check_resource(resource: str) -> str:
    """The resource, if it can't leave the assets folder."""
    for bad, why in ((resource[:1] in ("/", "\\") and resource != "", "Absolute paths not allowed"), (".." in resource, "Path traversal not allowed"), ("\\" in resource, "Backslash not allowed in path")):
        if bad:
            raise IoError(f"{why}: {resource}")
    return resource


def _cells(line: str) -> list[str]:
    return [c.strip(TRIM) for c in line.split(",")]


def read_csv(assets_dir: str, resource: str, budget: IoBudget) -> dict:
    """``{"columns": {header: [cells]}, "rowCount": n}`` of one asset, for use inside a module."""
    path = Path(assets_dir) / check_resource(resource)
    if budget.max_bytes == 0 or budget.max_rows == 0:
        raise IoError("IO budget not configured (max_io_read_bytes/rows = 0)")
    if not path.is_file():
        raise FileNotFoundError(f"Failed to open CSV file: {path}")
    lines = path.read_text(encoding="utf-8").split("\n")
    if lines[-1] == "":
        lines.pop()
    if not lines:
        return {"columns": {}, "rowCount": 0}
    headers = _cells(lines[0])
    columns: list[list[str]] = [[] for _ in headers]
    used = len(lines[0].encode()) + 1
    for n, line in enumerate(lines[1:], 1):
        used += len(line.encode()) + 1
        if budget.bytes_read + used > budget.max_bytes:
            raise IoError("IO budget exceeded: max_io_read_bytes")
        if budget.rows_read + n > budget.max_rows:
            raise IoError("IO budget exceeded: max_io_read_rows")
        cells = _cells(line)
        for i, column in enumerate(columns):
            column.append(cells[i] if i < len(cells) else "")
    budget.bytes_read += used
    budget.rows_read += len(lines) - 1
    return {"columns": dict(zip(headers, columns)), "rowCount": len(lines) - 1}


def read_csv_frame(spark: SparkSession, path: str) -> DataFrame:
    """The same format as a distributed source: text lines, split and trimmed in the JVM.

    The header is the first line of the file, so ``path`` is one file; the rows
    are read in parallel.
    """
    lines = spark.read.text(path)
    top = lines.limit(1).collect()
    if not top:
        return spark.createDataFrame([], "empty string").drop("empty")
    headers = _cells(top[0]["value"])
    last = {h: i for i, h in enumerate(headers)}
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    cells = F.split("value", ",", -1)
    # a line equal to the header's can occur again as data: only the very first is the header
    numbered = lines.withColumn("_at", F.monotonically_increasing_id()).where("_at > 0")
    return numbered.select(*(F.coalesce(trim(F.get(cells, F.lit(i))), F.lit("")).alias(h) for h, i in last.items()))
