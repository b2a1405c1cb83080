"""Text keys under which differently formatted values agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever is neither letter, mark nor digit separates words.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def spaced(c: Column) -> Column:
    """Lower case, every run of white space and punctuation as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " "))


def word_key(c: Column) -> Column:
    """The same for values that differ in case, spacing, punctuation or order of words."""
    return F.array_join(F.array_sort(F.split(spaced(c), " ")), " ")


def glued(c: Column) -> Column:
    """Lower case without white space and punctuation, in the order written."""
    return F.regexp_replace(F.lower(c), NOT_WORD, "")


def blank_to_null(c: Column) -> Column:
    """NULL for NULL, blank and the written forms of nothing (fixed values of the data)."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "nan", "none", "na", "n/a", "null"), None).otherwise(t)
