"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    The optimizer may put a column's expression wherever the column is read, inside lambda
    functions too, where it would run for every element. A lambda variable cannot be replaced.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
