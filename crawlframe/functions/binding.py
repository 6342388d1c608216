"""Binding a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it: a lambda's variable isn't inlined as a column would be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
