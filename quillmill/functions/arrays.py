"""Array expressions that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import bind


def indexes(items: Column) -> Column:
    """``[0, ..., size - 1]``; empty for an empty array."""
    none = F.array().cast("array<int>")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(none)


def split_where(items: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """The array cut into arrays; ``starts(previous, item)`` says where a new one begins."""

    def cut(items: Column) -> Column:
        first = F.filter(
            indexes(items), lambda i: (i == 0) | starts(F.get(items, i - 1), F.get(items, i))
        )

        def parts(first: Column) -> Column:
            return F.transform(
                first,
                lambda start, k: F.slice(
                    items, start + 1, F.coalesce(F.get(first, k + 1), F.size(items)) - start
                ),
            )

        return bind(first, parts)

    return bind(items, cut)


def group_sorted(items: Column, key: str) -> Column:
    """Arrays of the items with an equal first field ``key``, in its order."""
    return split_where(F.sort_array(items), lambda before, item: before[key] != item[key])
