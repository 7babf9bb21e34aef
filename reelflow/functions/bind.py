"""Evaluate an expression once and reuse it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, evaluated once per row.

    Written as ``transform(array(value), v -> body(v))[0]``. Catalyst inlines
    a derived column into every expression (and pushed-down filter) that uses
    it; for large expressions tested many times, such as the model-answer
    classifier, that multiplies generated code until it no longer compiles.
    Binding keeps the tree linear in size.
    """
    return F.transform(F.array(value), body).getItem(0)
