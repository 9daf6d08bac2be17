"""Node operators over DataFrames of candidates."""

from .base import Context, NodeError, NodeSpec, Operators, default_operators

__all__ = ["Context", "NodeError", "NodeSpec", "Operators", "default_operators"]
