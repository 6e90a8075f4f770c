"""Moments of pairs that add up over pieces of the data, each piece about its own means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Of a piece: rows, means of both sides, sums of squares and of products about those means.
PAIR_MOMENTS = ["n", "ma", "mb", "aa", "bb", "ab"]
PAIR_TYPES = "n long, ma double, mb double, aa double, bb double, ab double"


def merged_correlations(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, corr) from rows (keys, PAIR_MOMENTS); NULL where a side does not vary.

    What rounding leaves of a side that does not vary counts as none.
    """
    whole = Window.partitionBy(*keys)
    pieces = pieces.filter("n > 0").withColumns(
        {f"_{m}": F.sum(F.col("n") * F.col(m)).over(whole) / F.sum("n").over(whole) for m in ("ma", "mb")})
    off = {m: F.col(m) - F.col(f"_{m}") for m in ("ma", "mb")}
    added = pieces.groupBy(*keys).agg(
        *[F.sum(F.col(name) + F.col("n") * off[p] * off[q]).alias(name) for name, p, q in (("aa", "ma", "ma"), ("bb", "mb", "mb"), ("ab", "ma", "mb"))],
        *[F.sum(F.col("n") * F.col(m) * F.col(m)).alias(f"_{m}") for m in ("ma", "mb")],
    )
    varies = [F.col(s) > 1e-14 * (F.col(s) + F.col(m)) for s, m in (("aa", "_ma"), ("bb", "_mb"))]
    corr = F.when(varies[0] & varies[1], F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    return added.select(*keys, corr.alias("corr"))
