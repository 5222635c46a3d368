"""Helpers for Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a computed value to a lambda variable: it is worked out once a row, and long rules stay out of generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)
