"""Token-set similarity of texts, for candidates that share a word."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from souqframe.session import Workspace


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = at.get(c, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """100 times the share of letters not inserted or deleted."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's full words, in sorted order."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return max([ratio(left, right), *([ratio(both, left), ratio(both, right)] if both else [])])


@F.pandas_udf(DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def best_match(texts: DataFrame, text: str, reference: DataFrame, name: str, threshold: float) -> DataFrame:
    """The best reference entry of each distinct text; ties take the first name.

    Entries that share a word with the text are scored first, by a join on words. Texts that find nothing that way, because
    every word is misspelt or glued, meet the whole list, block by block."""
    from souqframe.operators.outliers import block_pairs

    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("_word")
    t = texts.select(F.col(text).alias("_t")).where("_t <> ''").distinct()
    r = reference.select(F.col(name).alias("_r")).where("_r IS NOT NULL").distinct()
    pairs = t.select("_t", words(F.col("_t"))).join(r.select("_r", words(F.col("_r"))), "_word").select("_t", "_r").distinct()
    scored = pairs.withColumn("score", token_set_score("_t", "_r")).where(F.col("score") >= threshold)
    best = scored.groupBy("_t").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_r").alias("r"))).alias("b"))
    best = Workspace(texts.sparkSession).stage(best, "shared-words")

    def whole(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in a["id"] if len(b) else ():
            s, y = min((-token_set_ratio(x, y), y) for y in b["id"])
            if -s >= threshold:
                out.append((x, s, y))
        return pd.DataFrame(out, columns=["_t", "s", "r"])

    rest = t.join(best, "_t", "left_anti").withColumnRenamed("_t", "id")
    far = block_pairs(rest, r.withColumnRenamed("_r", "id"), whole, "_t string, s double, r string", 1024).groupBy("_t").agg(F.min(F.struct("s", "r")).alias("b"))
    return t.join(best.unionByName(far), "_t", "left").select(F.col("_t").alias(text), F.col("b.r").alias("matched"), (-F.col("b.s")).alias("score"))
