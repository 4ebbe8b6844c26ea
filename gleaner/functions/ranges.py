"""Places of values among sorted bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(column: Column, bounds: list[int] | list[float], kind: str = "double") -> Column:
    """How many of the sorted bounds are at most ``column``, found among every so many of them first, then between two of those; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    as_array = lambda x: F.array(*map(F.lit, x)).cast(f"array<{kind}>")
    before = lambda x, c: F.size(F.filter(x, lambda b: b <= c))
    fine = lambda k, c: F.when(k == 0, 0).otherwise((k - 1) * step + before(F.slice(as_array(bounds), F.greatest((k - 1) * step + 1, F.lit(1)), step), c))
    place = lambda c: F.element_at(F.transform(F.array(before(as_array(bounds[::step]), c)), lambda k: fine(k, c)), 1)
    return F.element_at(F.transform(F.array(column), place), 1)  # the column is computed once, not for each bound
