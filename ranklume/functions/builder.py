"""Builds expression trees: functions, or Python operators on signals."""

from __future__ import annotations

from ..keys import Key
from .tree import ExprError


class Signal(dict):
    """A tree that also takes ``+ - *`` and unary minus."""

    def __add__(self, other):
        return E.add(self, other)

    def __radd__(self, other):
        return E.add(other, self)

    def __sub__(self, other):
        return E.sub(self, other)

    def __rsub__(self, other):
        return E.sub(other, self)

    def __mul__(self, other):
        return E.mul(self, other)

    def __rmul__(self, other):
        return E.mul(other, self)

    def __neg__(self):
        return E.neg(self)


def _tree(x) -> dict:
    return E.const(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def _fold(op: str, args) -> Signal:
    if len(args) < 2:
        raise ExprError(f"{op}() takes at least 2 arguments")
    return Signal(op=op, args=[_tree(a) for a in args])


class E:
    """Constructors of expression trees; plain numbers stand for constants."""

    @staticmethod
    def const(value: float) -> Signal:
        return Signal(op="const", value=value)

    @staticmethod
    def signal(key: Key | int) -> Signal:
        return Signal(op="signal", key_id=key.id if isinstance(key, Key) else key)

    @staticmethod
    def add(*args) -> Signal:
        return _fold("add", args)

    @staticmethod
    def mul(*args) -> Signal:
        return _fold("mul", args)

    @staticmethod
    def min(*args) -> Signal:
        return _fold("min", args)

    @staticmethod
    def max(*args) -> Signal:
        return _fold("max", args)

    @staticmethod
    def cos(a, b) -> Signal:
        return Signal(op="cos", a=_tree(a), b=_tree(b))

    cos_sim = cos

    @staticmethod
    def clamp(x, lo, hi) -> Signal:
        return Signal(op="clamp", x=_tree(x), lo=_tree(lo), hi=_tree(hi))

    @staticmethod
    def penalty(name: str) -> Signal:
        return Signal(op="penalty", name=name)

    @staticmethod
    def neg(x) -> Signal:
        return E.mul(-1, x)

    @staticmethod
    def sub(a, b) -> Signal:
        return E.add(a, E.neg(b))
