"""Array expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it, inside the loops of array functions too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(array: Column, width: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of each run of ``width`` elements; empty if there are fewer."""
    count = F.size(array) - width + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: body(F.slice(array, i, width)))
