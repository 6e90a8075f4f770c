"""Data-quality queries: duplicate keys, rule violations, orphans, unexpected values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (rule, violations); each rule is the condition that marks a bad row.

    All rules are counted in one pass.
    """
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counted.select(F.inline(F.array(*pairs)))


def not_binary(column: str) -> Column:
    return ~F.col(column).isin(0, 1)


def outside(column: str, low, high) -> Column:
    return ~F.col(column).between(low, high)


def missing(column: str) -> Column:
    return F.col(column).isNull()


def orphan_count(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row: child rows whose key the parent table does not have; a missing key is no orphan.

    Child rows are counted per key before the anti join.
    """
    counted = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = counted.join(parent.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def unexpected_values(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    return df.filter(~F.col(column).isin(list(allowed))).select(column).distinct()
