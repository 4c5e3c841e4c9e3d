"""Binding a value once within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with ``value`` evaluated once.

    An outer expression that a lambda mentions is evaluated for every element; bound as a lambda
    variable it is computed once a row.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))
