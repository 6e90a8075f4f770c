"""Window building blocks over daily series.

Every window here is partitioned by a series key and the input holds at most one row per
(series, date): the roll-ups and the keep-last merge enforce it. A partition is therefore
never longer than the calendar, whatever share of the raw events its key carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.expressions import day_number, round_stable


def add_lags(df: DataFrame, columns: dict[str, str], lags: dict[str, Sequence[int]], keys: Sequence[str],
             order: str = "date", calendar: bool = False) -> DataFrame:
    """Add `{prefix}_lag_{k}` for each column.

    `columns` maps source column to prefix, `lags` maps prefix to its lags. By default a lag
    counts observed rows; with `calendar=True` it is the value exactly k days earlier.
    """
    series = Window.partitionBy(*keys)
    new = {}
    for source, prefix in columns.items():
        for k in lags[prefix]:
            if calendar:
                w = series.orderBy(day_number(F.col(order))).rangeBetween(-k, -k)
                new[f"{prefix}_lag_{k}"] = F.max(source).over(w)
            else:
                new[f"{prefix}_lag_{k}"] = F.lag(source, k).over(series.orderBy(order))
    return df.withColumns(new)


def add_rolling(df: DataFrame, specs: dict[str, tuple[str, str, int]], keys: Sequence[str],
                order: str = "date", calendar: bool = False, strict: bool = False, digits: int | None = 2) -> DataFrame:
    """Add trailing means and sums; `specs` maps output name to (function, column, width).

    Windows count rows and may be partial. `strict` leaves the current row out; `calendar`
    measures the width in days.
    """
    series = Window.partitionBy(*keys)
    new = {}
    for name, (fn, column, width) in specs.items():
        first, last = (-width, -1) if strict else (-(width - 1), 0)
        if calendar:
            w = series.orderBy(day_number(F.col(order))).rangeBetween(first, last)
        else:
            w = series.orderBy(order).rowsBetween(first, last)
        value = {"avg": F.avg, "sum": F.sum}[fn](column).over(w)
        new[name] = value if digits is None else round_stable(value, digits)
    return df.withColumns(new)


def first_difference(df: DataFrame, column: str, output: str, keys: Sequence[str], order: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(output, F.col(column) - F.lag(column, 1).over(w))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key in the given order; NULL keys count as equal.

    Spark applies the rank limit before the shuffle as well, so of a key with very many
    copies each map task sends one row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
