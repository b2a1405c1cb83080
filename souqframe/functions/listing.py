"""Expressions over listing columns shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Real screens, in inches (fixed values of the data).
SCREEN_RANGE = (10.0, 20.0)


def real_screen(c: Column) -> Column:
    """The size if it is one, NULL for NULL, NaN, zero, negative and placeholder numbers."""
    return F.when(c.between(*SCREEN_RANGE), c)


def memory_type(c: Column) -> Column:
    """``DDR4``, ``LPDDR5``, ``DDR3L`` ... however written, NULL for every way of saying nothing."""
    t = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
    found = F.regexp_extract(t, r"^((?:LP|G)?DDR\d[LX]?)", 1)
    return F.when(found != "", found)


def number(c: Column) -> Column:
    """A number with thousands separators, NULL if it is none."""
    n = F.translate(c, ",  ", "").try_cast("double")
    return F.when(~F.isnan(n), n)


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), c)
