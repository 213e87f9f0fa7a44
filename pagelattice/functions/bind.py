"""Binding a column expression to a name inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c`` with ``c`` evaluated once: as a plain column it would be evaluated wherever ``f`` names it, and per element inside a lambda."""
    return F.element_at(F.transform(F.array(c), f), 1)
