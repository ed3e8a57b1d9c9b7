"""Small tools for building long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    Long rules name the same piece many times. Without the binding every
    mention would copy the whole expression below it into the plan.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """Return a struct with the given field names."""
    return F.named_struct(*(part for name, value in fields.items() for part in (F.lit(name), value)))


def as_column(value: Column | str | None) -> Column:
    """Return a column for a column or a literal text."""
    return value if isinstance(value, Column) else F.lit(value)
