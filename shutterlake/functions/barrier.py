"""Keeping costly expressions from being repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sealed(number: Column) -> Column:
    """The same number, marked so that a filter on it isn't pushed below, which would repeat the expressions that make it, once for every use."""
    return number + F.monotonically_increasing_id() * 0
