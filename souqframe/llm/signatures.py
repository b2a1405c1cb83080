"""Configurations written as seven values joined by a bar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def configuration(c: Column) -> Column:
    """The same text for signatures whose values are equal as numbers, missing equal to missing.

    A value that is no number, in whatever word, is missing; thousands separators and blanks do not count.
    """

    def value(x: Column) -> Column:
        n = F.translate(x, ",  \t", "").try_cast("double")
        return F.when(n.isNull() | F.isnan(n), F.lit("?")).otherwise(F.when(n == 0, F.lit("0.0")).otherwise(n.cast("string")))

    return F.array_join(F.transform(F.split(c, r"\|", -1), value), "|")
