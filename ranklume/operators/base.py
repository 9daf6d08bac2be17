"""What a node operator is, and the explicit table of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..keys import POSITION, Key, KeyRegistry


class NodeError(ValueError):
    pass


@dataclass
class Context:
    """What nodes see besides their input."""

    spark: SparkSession
    registry: KeyRegistry = field(default_factory=KeyRegistry.default)
    strict: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    policy: object | None = None
    warn: Callable[[str], None] = lambda message: None


@dataclass(frozen=True)
class NodeSpec:
    """The catalog entry of an operator."""

    op: str
    namespace: str
    run: Callable[[Context, list[DataFrame], dict], DataFrame]
    doc: str = ""
    stability: str = "stable"
    params: dict[str, str] = field(default_factory=dict)
    reads: tuple[int, ...] = ()
    writes: tuple[int, ...] = ()
    writes_from: str | None = None  # the parameter that names a written key
    many_inputs: bool = False
    source: bool = False
    budget: dict[str, int] = field(default_factory=dict)
    capabilities: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.stability not in ("stable", "experimental"):
            raise NodeError(f"{self.op}: unknown stability {self.stability}")
        if (self.stability == "experimental") != self.namespace.startswith("experimental."):
            raise NodeError(f"{self.op}: experimental nodes, and only those, are in the namespace experimental.*")


class Operators:
    """Operators by name; filled explicitly."""

    def __init__(self, specs=()):
        self._specs: dict[str, NodeSpec] = {}
        for s in specs:
            self.register(s)

    def register(self, spec: NodeSpec) -> None:
        if spec.op in self._specs:
            raise NodeError(f"Operator registered twice: {spec.op}")
        self._specs[spec.op] = spec

    def has(self, op: str) -> bool:
        return op in self._specs

    def get(self, op: str) -> NodeSpec | None:
        return self._specs.get(op)

    def all(self) -> list[NodeSpec]:
        return sorted(self._specs.values(), key=lambda s: (s.namespace, s.op))

    def copy(self) -> Operators:
        return Operators(self._specs.values())


def key_column(key: Key, value: Column) -> dict[str, Column]:
    """A key's column, with its metadata."""
    return {key.column: value.alias(key.column, metadata=key.metadata())}


def with_keys(df: DataFrame, values: dict[Key, Column]) -> DataFrame:
    """Adds or replaces key columns in one projection."""
    out = df.withColumns({k.column: v for k, v in values.items()})
    for k in values:
        out = out.withMetadata(k.column, k.metadata())
    return out


def positioned(df: DataFrame, order: Column | None = None) -> DataFrame:
    """``df`` with a position column: the given order, or the one it has."""
    if order is not None:
        return df.withColumn(POSITION, order.cast("long"))
    if POSITION not in df.columns:
        raise NodeError(f"a batch needs the position column {POSITION}")
    return df


def empty_batch(ctx: Context) -> DataFrame:
    return ctx.spark.range(0).select(F.col("id").alias(POSITION))


def default_operators() -> Operators:
    from . import core, extensions, python_module

    return Operators([*core.SPECS, *extensions.SPECS, python_module.SPEC])
