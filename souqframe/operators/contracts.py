"""Data contracts: all violations of all rules in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    broken: Column  # true where a row breaks the rule; NULL is not broken


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(column, f"between {low:g} and {high:g}", ~F.col(column).between(low, high))


def required(column: str) -> Rule:
    return Rule(column, "present", F.col(column).isNull())


def one_of(column: str, *values: object) -> Rule:
    return Rule(column, "one of " + ", ".join(map(str, values)), ~F.col(column).isin(*values))


def missing_columns(df: DataFrame, rules: list[Rule]) -> list[str]:
    return sorted({r.column for r in rules} - set(df.columns))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``column_name, rule, violations, rows`` for every rule; missing columns are an error that names them all."""
    if lost := missing_columns(df, rules):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    one = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.coalesce(r.broken, F.lit(False)).cast("bigint")), F.lit(0)).alias(f"v{i}") for i, r in enumerate(rules)])
    parts = F.array(*[F.struct(F.lit(r.column).alias("column_name"), F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(rules)])
    return one.select("rows", F.explode(parts).alias("r")).select("r.*", "rows")
