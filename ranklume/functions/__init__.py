"""Score expressions: the JSON tree, its builder, and its compilation to columns."""

from .builder import E, Signal
from .compile import to_column
from .tree import ExprError, collect_key_ids, is_expr, parse

__all__ = ["E", "ExprError", "Signal", "collect_key_ids", "is_expr", "parse", "to_column"]
