"""Moment sums for least squares, and the small solves on them.

A regression over any number of rows needs only the sums of products of its columns. They are
formed per partition and added up by key, so neither the row count nor a hot key matters.
The sums are kept long, one row per (keys, position), until they are solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lagwise.functions.expressions import complete
from lagwise.functions.statistics import ridge_solve

MAX_OPEN_GROUPS = 512


def positions(width: int) -> list[tuple[int, int]]:
    """Upper triangle of the moment matrix over (1, columns), in row order."""
    return [(i, j) for i in range(width + 1) for j in range(i, width + 1)]


def moment_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shift: Sequence[float] | None = None) -> DataFrame:
    """Rows (keys, pos, value): sums of products of (1, columns less `shift`) over complete rows, NULL keys included.

    The products are formed on Arrow batches, whatever the number of columns.
    """
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).filter(complete(columns))
    if shift is not None:
        rows = rows.select(*keys, *[(F.col(c) - F.lit(s)).alias(c) for c, s in zip(columns, shift)])
    return _batch_sums(rows, keys, columns).groupBy(*keys, "pos").agg(F.sum("value").alias("value"))


def column_shift(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """About the mean of each column. Products of shifted columns keep their digits when means are large; any
    shift near the mean gives the same fit, so it is cut to single precision, which hides the order of additions."""
    means = df.filter(complete(columns)).agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [0.0 if m is None or not np.isfinite(m) else float(np.float32(m)) for m in means]


def _batch_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    key_names, column_names = list(keys), list(columns)
    upper = np.triu_indices(len(column_names) + 1)

    def flush(open_groups: dict) -> Iterator[pd.DataFrame]:
        for key, sums in open_groups.items():
            out = pd.DataFrame({"pos": np.arange(len(sums), dtype=np.int32), "value": sums})
            for name, value in zip(key_names, key):
                out.insert(0, name, pd.Series([None if pd.isna(value) else value] * len(sums), dtype=object))
            yield out[[*key_names, "pos", "value"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(key_names, sort=False, dropna=False):
                x = np.column_stack([np.ones(len(rows)), rows[column_names].to_numpy()])
                sums = (x.T @ x)[upper]
                groups[key] = groups[key] + sums if key in groups else sums
            if len(groups) > MAX_OPEN_GROUPS:
                yield from flush(groups)
                groups = {}
        yield from flush(groups)

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in key_names)
    return df.mapInPandas(run, f"{key_types}, pos int, value double")


def gather_moments(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the sums as an array; its length is fixed by the number of columns."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return sums.groupBy(*keys).agg(F.transform(packed, lambda s: s["value"]).alias("moments"))


def least_squares(moments: Column, alpha: float = 0.0, shift: Sequence[float] | None = None) -> Column:
    """Intercept and coefficients of the second column on the later ones; NULL when there are no rows.

    With `shift`, the moments are of shifted columns and the intercept is moved back.
    """

    @pandas_udf("array<double>")
    def solve(rows: pd.Series) -> pd.Series:
        out = []
        for flat in rows:
            size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
            full = np.zeros((size, size))
            full[np.triu_indices(size)] = flat
            full = full + np.triu(full, 1).T
            found = ridge_solve(full, alpha)
            if found is not None and shift is not None:
                found[0] += shift[0] - float(np.dot(found[1:], shift[1:]))
            out.append(found)
        return pd.Series(out)

    return solve(moments)


def linear_prediction(coefficients: Column, columns: Sequence[str]) -> Column:
    value = coefficients[0]
    for i, c in enumerate(columns, start=1):
        value = value + coefficients[i] * F.col(c)
    return value
