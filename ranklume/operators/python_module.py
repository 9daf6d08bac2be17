"""User modules: reviewed Python functions over whole batches, with declared effects.

A module has ``META`` (name, version, reads, writes, params, budget,
capabilities, scope) and ``run_batch(batch, ctx, params)``.  ``scope`` tells what
a batch is: ``row`` modules are given any part of the rows and run in parallel,
and only their reads travel to Python; ``batch`` modules are given all rows at
once, in one task, which their write budget bounds.  Budgets are for all rows of a
run: a module with scope ``row`` is charged for all of them by each of its parts.
It may declare budgets a row instead (``max_write_bytes_per_row``,
``max_write_cells_per_row``), which hold for any number of rows, and ``totals``:
extremes of its reads over all rows, by name, that it finds in ``ctx.totals``.
Only declared reads reach the module, only declared writes come
back; reads that aren't declared raise.  This is governance, not isolation: modules run as ordinary Python.
"""

from __future__ import annotations

import contextlib
import hashlib
import importlib.util
import signal as os_signal
import threading
from dataclasses import dataclass, field
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..keys import POSITION, Key, KeyRegistry
from ..shipping import ship
from ..sources.csv import IoBudget, IoError, Policy, read_csv
from .base import Context, NodeError, NodeSpec, with_keys

# Default budgets.
MAX_WRITE_BYTES, MAX_WRITE_CELLS, TIME_LIMIT_S = 1_048_576, 100_000, 60.0
#: Rows up to which a bound is checked by a limit.
SMALL_BOUND = 1_000_000
KIND_BYTES = {"f32": 4, "i64": 8}
#: What ``totals`` may ask for.
TOTALS = {"min": F.min, "max": F.max}


class ModuleError(NodeError):
    pass


@dataclass(frozen=True)
class Meta:
    name: str
    version: str = ""
    reads: tuple[int, ...] = ()
    writes: tuple[int, ...] = ()
    params: dict = field(default_factory=dict)
    max_write_bytes: int | None = MAX_WRITE_BYTES  # None: only the budget a row holds
    max_write_cells: int | None = MAX_WRITE_CELLS
    max_io_read_bytes: int = 0
    max_io_read_rows: int = 0
    csv_read: bool = False
    scope: str = "batch"
    vector_dims: dict[int, int] = field(default_factory=dict)
    time_limit_s: float = TIME_LIMIT_S
    max_write_bytes_per_row: int | None = None
    max_write_cells_per_row: int | None = None
    totals: dict[str, tuple[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict) -> Meta:
        budget = raw.get("budget", {})
        io = raw.get("capabilities", {}).get("io", {}) if isinstance(raw.get("capabilities", {}), dict) else {}
        per_row = {x: budget[x] for x in ("max_write_bytes_per_row", "max_write_cells_per_row") if x in budget}
        of_run = lambda name, default: budget.get(name, None if f"{name}_per_row" in per_row else default)
        meta = cls(
            raw.get("name", ""), raw.get("version", ""), tuple(map(int, raw.get("reads", ()))), tuple(map(int, raw.get("writes", ()))), raw.get("params", {}),
            of_run("max_write_bytes", MAX_WRITE_BYTES), of_run("max_write_cells", MAX_WRITE_CELLS), budget.get("max_io_read_bytes", 0), budget.get("max_io_read_rows", 0),
            bool(isinstance(io, dict) and io.get("csv_read") is True), raw.get("scope", "batch"), dict(raw.get("vector_dims", {})), raw.get("time_limit_s", TIME_LIMIT_S),
            **per_row, totals={name: (how, int(key_id)) for name, (how, key_id) in raw.get("totals", {}).items()},
        )
        if meta.scope not in ("row", "batch"):
            raise ModuleError(f"scope must be 'row' or 'batch', not {meta.scope!r}")
        if meta.scope == "batch" and (per_row or meta.totals):
            raise ModuleError("budgets a row and totals are for scope 'row'")
        for name, (how, key_id) in meta.totals.items():
            if how not in TOTALS:
                raise ModuleError(f"total {name}: unknown function {how!r}")
            if key_id not in meta.reads:
                raise ModuleError(f"total {name}: read of key {key_id} not allowed - not in meta.reads")
        return meta


@dataclass(frozen=True)
class Module:
    meta: Meta
    run_batch: object
    path: str = ""
    digest: str = ""

    @property
    def op(self) -> str:
        return f"py:{self.path or self.meta.name}@{self.meta.version}#{self.digest[:16]}"


def load_module(path: str | Path) -> Module:
    """Imports a module file; it must have META and run_batch."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"Failed to open module: {path}")
    spec = importlib.util.spec_from_file_location(f"_module_{hashlib.sha256(str(path).encode()).hexdigest()[:12]}", path)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return make_module(getattr(loaded, "META", None), getattr(loaded, "run_batch", None), str(path), hashlib.sha256(path.read_bytes()).hexdigest())


def make_module(meta: dict | None, run_batch, path: str = "", digest: str = "") -> Module:
    if not isinstance(meta, dict):
        raise ModuleError("Module must export META")
    if not callable(run_batch):
        raise ModuleError("Module must export run_batch")
    return Module(Meta.of(meta), run_batch, path, digest)


class Batch:
    """What a module sees: reads as arrays, writes as arrays to fill."""

    def __init__(self, rows: pd.DataFrame, meta: Meta, registry: KeyRegistry, charged_rows: int | None = None):
        self._rows, self._meta, self._registry = rows, meta, registry
        self._charged = len(rows) if charged_rows is None else charged_rows
        self.written: dict[int, np.ndarray] = {}
        self._bytes = self._cells = 0

    def row_count(self) -> int:
        return len(self._rows)

    def _column(self, key_id: int, kind: str) -> pd.Series | None:
        """A declared column; None if there is no such column of that type."""
        if key_id not in self._meta.reads:
            raise ModuleError(f"Read of key {_named(key_id, self._registry)} not allowed - not in meta.reads")
        key = self._registry.by_id(key_id)
        return None if key is None or key.type != kind or key.column not in self._rows else self._rows[key.column]

    def _read(self, key_id: int, kind: str, dtype) -> np.ndarray | None:
        """A copy of the column, nulls as 0."""
        column = self._column(key_id, kind)
        return None if column is None else column.fillna(0).to_numpy(dtype).copy()

    def f32(self, key_id: int) -> np.ndarray | None:
        return self._read(key_id, "f32", np.float32)

    def i64(self, key_id: int) -> np.ndarray | None:
        return self._read(key_id, "i64", np.int64)

    def f32vec(self, key_id: int) -> np.ndarray | None:
        column = self._column(key_id, "f32vec")
        if column is None:
            return None
        rows = list(column)
        width = next((len(v) for v in rows if v is not None), 0)
        return np.array([v if v is not None else [0.0] * width for v in rows], np.float32).reshape(len(rows), width)

    def _write(self, key_id: int, kind: str, shape, dtype, size: int) -> np.ndarray:
        check_write(key_id, kind, self._meta, self._registry)
        n = self._charged
        charge(self._meta, self._bytes + n * size, self._cells + n, n)
        self._bytes, self._cells = self._bytes + n * size, self._cells + n
        self.written[key_id] = np.zeros(shape, dtype)
        return self.written[key_id]

    def write_f32(self, key_id: int) -> np.ndarray:
        return self._write(key_id, "f32", len(self._rows), np.float32, 4)

    def write_i64(self, key_id: int) -> np.ndarray:
        return self._write(key_id, "i64", len(self._rows), np.int64, 8)

    def write_f32vec(self, key_id: int, dim: int) -> np.ndarray:
        return self._write(key_id, "f32vec", (len(self._rows), dim), np.float32, 4 * dim)


def _named(key_id: int, registry: KeyRegistry) -> str:
    key = registry.by_id(key_id)
    return f"{key_id} ({key.name})" if key else str(key_id)


def check_write(key_id: int, kind: str, meta: Meta, registry: KeyRegistry) -> None:
    if key_id not in meta.writes:
        raise ModuleError(f"Write to key {_named(key_id, registry)} not allowed - not in meta.writes")
    key = registry.by_id(key_id)
    if key is None:
        raise ModuleError(f"Unknown key: {key_id}")
    if key.type != kind:
        raise ModuleError(f"Type mismatch for key {_named(key_id, registry)}: expected {kind}, got {key.type}")


def charge(meta: Meta, total_bytes: int, total_cells: int, rows: int) -> None:
    for name, total in (("max_write_bytes", total_bytes), ("max_write_cells", total_cells)):
        most, a_row = getattr(meta, name), getattr(meta, f"{name}_per_row")
        if most is not None and total > most:
            raise ModuleError(f"Budget exceeded: {name} ({most})")
        if a_row is not None and total > a_row * rows:
            raise ModuleError(f"Budget exceeded: {name}_per_row ({a_row})")


@contextlib.contextmanager
def time_limit(seconds: float):
    """Interrupts the module after so many seconds, where the worker's main thread runs it."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise ModuleError(f"module execution exceeded {seconds:g} s")

    before = os_signal.signal(os_signal.SIGALRM, stop)
    os_signal.setitimer(os_signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        os_signal.setitimer(os_signal.ITIMER_REAL, 0)
        os_signal.signal(os_signal.SIGALRM, before)


def run_on(module: Module, rows: pd.DataFrame, registry: KeyRegistry, policy: Policy | None, params: dict, charged_rows: int | None = None, totals: dict | None = None) -> Batch:
    """Runs a module on rows and returns its batch with what was written."""
    meta = module.meta
    batch = Batch(rows, meta, registry, charged_rows)
    ctx = SimpleNamespace(keys=SimpleNamespace(**{k.constant: k.id for k in registry.keys}), key_info=SimpleNamespace(**{k.constant: {"id": k.id, "name": k.name, "type": k.type} for k in registry.keys}), totals=SimpleNamespace(**(totals or {})))
    if meta.csv_read and policy is not None and policy.allows_csv(meta.name, meta.version):
        budget = IoBudget(meta.max_io_read_bytes, meta.max_io_read_rows)
        ctx.io = SimpleNamespace(read_csv=lambda resource: read_csv(policy.assets_dir, resource, budget))
    with time_limit(meta.time_limit_s):
        module.run_batch(batch, ctx, params)
    return batch


def totals_of(meta: Meta, registry: KeyRegistry, df: DataFrame) -> dict:
    """The totals that a module declares, over all rows: nulls and NaN count as 0, as in reads.  Without rows, or without such a column, None."""
    columns = {}
    for name, (how, key_id) in meta.totals.items():
        key = registry.by_id(key_id)
        if key is None or key.type not in KIND_BYTES:
            raise ModuleError(f"total {name}: key {_named(key_id, registry)} isn't a f32 or i64")
        if key.column in df.columns:
            zero = F.lit(0).cast(key.field().dataType)
            value = F.coalesce(key.column, zero)
            columns[name] = TOTALS[how](F.when(F.isnan(value), zero).otherwise(value) if key.type == "f32" else value).alias(name)
    found = df.agg(*columns.values()).first().asDict() if columns else {}  # one row
    dtypes = {name: np.float32 if registry.by_id(key_id).type == "f32" else np.int64 for name, (_, key_id) in meta.totals.items()}
    return {name: None if found.get(name) is None else dtype(found[name]) for name, dtype in dtypes.items()}


def apply_module(module: Module, ctx: Context, df: DataFrame, params: dict) -> DataFrame:
    """Adds the columns that the module writes.  Rows, order and other columns stay."""
    ship(ctx.spark)
    meta, registry = module.meta, ctx.registry
    outputs: list[Key] = []
    for key_id in meta.writes:
        key = registry.by_id(key_id)
        if key is None:
            raise ModuleError(f"Unknown key: {key_id}")
        if key.type not in ("f32", "i64", "f32vec"):
            raise ModuleError(f"key {_named(key_id, registry)}: modules write f32, i64 and f32vec")
        outputs.append(key)
    reads = [k for k in (registry.by_id(i) for i in meta.reads) if k is not None and k.column in df.columns]
    # columns that are neither read nor written pass by in the JVM's schema order
    kept = [c for c in df.columns if c not in {k.column for k in outputs}]
    schema = T.StructType([df.schema[c] for c in kept] + [k.field() for k in outputs])
    policy = ctx.policy

    # the run's budget bounds the rows: with more than that the module's first write would fail; without writes, a row counts as a cell
    bounds = [] if meta.max_write_cells is None else [meta.max_write_cells]
    bounds += [] if meta.max_write_bytes is None else [meta.max_write_bytes // KIND_BYTES.get(k.type, 4) for k in outputs]
    total = None  # budgets a row need no count
    if bounds:
        bound = min(bounds)
        # a small bound needs no look at all rows; a large one no exchange of as many
        total = df.select(POSITION).limit(bound + 1).count() if bound <= SMALL_BOUND else df.count()
        if total > bound:
            charge(meta, total * min([KIND_BYTES.get(k.type, 4) for k in outputs], default=0), total, total)

    if meta.scope == "row":
        if not outputs:
            return df
        # only the reads go to Python; a key that isn't written keeps the column it has
        totals = totals_of(meta, registry, df)
        written = T.StructType([x for k in outputs for x in (T.StructField(k.column, k.field().dataType), T.StructField(f"{k.column}_set", T.BooleanType()))])

        @F.pandas_udf(written)
        def part(rows: pd.DataFrame) -> pd.DataFrame:
            batch = run_on(module, rows.drop(columns=POSITION), registry, policy, params, total, totals)
            out = {}
            for k in outputs:
                v = batch.written.get(k.id)
                out[k.column] = pd.Series([None] * len(rows)) if v is None else pd.Series(list(v) if v.ndim > 1 else v)
                out[f"{k.column}_set"] = v is not None
            return pd.DataFrame(out, index=range(len(rows)))

        made = df.withColumn("_written", part(F.struct(POSITION, *(k.column for k in reads))))
        old = lambda k: F.col(k.column) if k.column in df.columns else F.lit(None)
        return with_keys(made, {k: F.when(F.col(f"_written.{k.column}_set"), F.col(f"_written.{k.column}")).otherwise(old(k)).cast(k.field().dataType) for k in outputs}).drop("_written")

    def on(rows: pd.DataFrame) -> pd.DataFrame:
        seen = rows[[k.column for k in reads]] if reads else rows[[]]
        batch = run_on(module, seen, registry, policy, params)
        old = {k.column: rows[k.column] if k.column in rows else pd.Series([None] * len(rows), index=rows.index) for k in outputs}
        new = {registry.by_id(i).column: pd.Series(list(v) if v.ndim > 1 else v, index=rows.index) for i, v in batch.written.items()}
        return rows[kept].assign(**(old | new))[[f.name for f in schema.fields]]

    ordered = lambda rows: on(rows.sort_values(POSITION, kind="stable").reset_index(drop=True)) if len(rows) else rows
    return df.groupBy().applyInPandas(ordered, schema)


def python_module(ctx: Context, inputs: list[DataFrame], params: dict) -> DataFrame:
    """Runs a user module over a batch."""
    if not isinstance(params.get("module"), str):
        raise ModuleError("module node: missing 'module' param")
    module = load_module(params["module"])
    rest = {k: v for k, v in params.items() if k != "module"}
    declared = set(module.meta.params)
    if ctx.strict and declared and (extra := set(rest) - declared):
        raise ModuleError(f"module {module.meta.name}: unknown params {', '.join(sorted(extra))}")
    return apply_module(module, ctx, inputs[0], rest)


SPEC = NodeSpec("py:module", "py.module", python_module, python_module.__doc__, params={"module": "path"}, budget={"max_write_bytes": MAX_WRITE_BYTES, "max_write_cells": MAX_WRITE_CELLS, "max_io_read_bytes": 0, "max_io_read_rows": 0}, capabilities={"io": {"csv_read": False}})

__all__ = ["IoError", "Meta", "Module", "ModuleError", "apply_module", "load_module", "make_module", "python_module"]
