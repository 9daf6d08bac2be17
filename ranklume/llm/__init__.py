"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage; it can be deleted as a
whole.  Each operator module has a general function and is applied to the
corpus tables by the thin queries in :mod:`ranklume.llm.queries`.
"""
