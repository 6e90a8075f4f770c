"""Cleaning of daily weather: gap filling, winsorising, event flags, rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from lagwise.functions.expressions import day_number, flag, round_half_even
from lagwise.operators.windows import add_rolling
from lagwise.schemas import WEATHER_VALUES

# The percentiles and run length that define events and outliers.
OUTLIER_RANGE = (0.01, 0.99)
HOT, COLD, WET = 0.95, 0.05, 0.95
RUN_LENGTH = 3
NO_RAIN_THRESHOLD = 999.0

ROLLING_WEATHER = {
    "rolling_7d_temp": ("avg", "tavg", 7),
    "rolling_14d_temp": ("avg", "tavg", 14),
    "rolling_7d_precip": ("sum", "prcp", 7),
    "rolling_30d_precip": ("sum", "prcp", 30),
}


def fill_gaps(df: DataFrame, columns: Sequence[str] = tuple(WEATHER_VALUES), key: str = "region_id",
              order: str = "date") -> DataFrame:
    """Last known value, else the first known value of the series, else 0.

    Only rows before the first known value lack a last one, and for them the next value is
    the first of the whole series; a whole-partition frame gives it in one pass.
    """
    series = Window.partitionBy(key).orderBy(order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(so_far),
            F.first(c, ignorenulls=True).over(whole),
            F.lit(0.0),
        )
        for c in columns
    })


def interpolate_gaps(df: DataFrame, columns: Sequence[str], key: str = "region_id", order: str = "date") -> DataFrame:
    """Straight line by date between the known neighbours; the nearest value at the ends."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    day = day_number(F.col(order))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(day.alias("d"), F.col(c).alias("v"))) for c in columns}
    before = df.withColumns({f"_p_{c}": F.last(known[c], ignorenulls=True).over(past) for c in columns})
    both = before.withColumns({f"_n_{c}": F.last(known[c], ignorenulls=True).over(future) for c in columns})
    out = both
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = (day - p["d"]) / (n["d"] - p["d"])
        out = out.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * share)
            .otherwise(F.coalesce(p["v"], n["v"])),
        )
    return out.drop(*[f"_{side}_{c}" for side in "pn" for c in columns])


def missing_report(df: DataFrame, columns: Sequence[str] = tuple(WEATHER_VALUES)) -> DataFrame:
    """One row: NULLs per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


# Leading bits of a value that each reduction looks at: sign, exponent and 12 bits of the fraction, then 20 bits at a time.
PERCENTILE_BITS = (40, 20, 0)


@pandas_udf(LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """The bits of doubles as integers in the same order; 0.0 and -0.0 are one, NaN comes last."""
    plain = values.to_numpy(float) + 0.0
    bits = np.where(np.isnan(plain), np.nan, plain).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@pandas_udf(DoubleType())
def from_ordered_bits(bits: pd.Series) -> pd.Series:
    plain = bits.to_numpy(np.int64)
    return pd.Series(np.where(plain < 0, plain ^ np.int64(0x7FFFFFFFFFFFFFFF), plain).view(np.float64))


def group_percentiles(df: DataFrame, keys: Sequence[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation per group, one column per entry of `shares`.

    Exact for groups of any size, by three reductions: values are counted by their leading bits, then, where the ranks asked
    for lie, by the next ones, then by the last. Counts are formed before each shuffle; no value is sorted or sketched, and a
    group sends at most 2^24 counts, then 2^20 per rank. Groups of NULL keys are left out.
    """
    values = df.filter(F.col(column).isNotNull()).select(*keys, ordered_bits(F.col(column).cast("double")).alias("_u"))

    def counted(rows: DataFrame, held: list[str], shift: int) -> DataFrame:
        """Rows (keys, prefixes, _p, _before, _c): how many values have each prefix, and how many a smaller one."""
        counts = rows.groupBy(*held, F.shiftright("_u", shift).alias("_p")).agg(F.count("*").alias("_c"))
        earlier = Window.partitionBy(*held).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))

    first = counted(values, list(keys), PERCENTILE_BITS[0])
    # Ranks are 0-based: share * (n - 1) lies between the ranks below and above it.
    sizes = first.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    asked = sizes.select(*keys, *[(F.lit(s) * (F.col("_n") - 1)).alias(n) for n, s in shares.items()])
    ranks = asked.select(*keys, F.explode(F.array_distinct(F.array(
        *[f(n).cast("long") for n in shares for f in (F.floor, F.ceil)]))).alias("_rank")).withColumn("_left", F.col("_rank"))
    within = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_c"))
    held, found = list(keys), first
    for shift in (*PERCENTILE_BITS[1:], None):
        ranks = ranks.join(found, held).filter(within).withColumn("_left", F.col("_left") - F.col("_before"))
        if shift is None:
            break
        named = f"_p{len(held)}"
        ranks = ranks.select(*held, F.col("_p").alias(named), "_rank", "_left")
        held.append(named)
        prefix = [F.shiftright("_u", bits).alias(name) for bits, name in zip(PERCENTILE_BITS, held[len(keys):])]
        found = counted(values.select(*keys, *prefix, "_u").join(ranks.select(*held).distinct(), held), held, shift)
    at = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", from_ordered_bits("_p").alias("_v")))).alias("_at"))

    def between(rank):
        low, high = (F.element_at("_at", f(rank).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (rank - F.floor(rank))

    return asked.join(at, list(keys)).select(*keys, *[between(F.col(n)).alias(n) for n in shares])


def winsorise(df: DataFrame, columns: Sequence[str] = ("tmax", "tmin", "tavg"), key: str = "region_id",
              shares: tuple[float, float] = OUTLIER_RANGE) -> DataFrame:
    """Clip each column to its per-series percentiles.

    A daily series is at most as long as the calendar, so the percentiles are taken over the
    window that the other steps use, without another shuffle.
    """
    whole = Window.partitionBy(key)
    bounds = {c: F.percentile(c, F.array(*[F.lit(s) for s in shares])).over(whole) for c in columns}
    return df.withColumns({f"_b_{c}": b for c, b in bounds.items()}).withColumns(
        {c: F.greatest(F.least(F.col(c), F.col(f"_b_{c}")[1]), F.col(f"_b_{c}")[0]) for c in columns}
    ).drop(*[f"_b_{c}" for c in columns])


def rain_threshold(prcp: str = "prcp"):
    """Aggregate: the percentile over wet days only, and an unreachable value without any."""
    return F.coalesce(F.percentile(F.when(F.col(prcp) > 0, F.col(prcp)), WET), F.lit(NO_RAIN_THRESHOLD))


def flag_events(df: DataFrame, key: str = "region_id", order: str = "date") -> DataFrame:
    """Heatwave and coldwave flags on the third and later rows of a run, and heavy rain."""
    whole = Window.partitionBy(key)
    run = whole.orderBy(order).rowsBetween(-(RUN_LENGTH - 1), 0)
    days = df.withColumns({
        "_hot": flag(F.col("tmax") >= F.percentile("tmax", HOT).over(whole)),
        "_cold": flag(F.col("tmin") <= F.percentile("tmin", COLD).over(whole)),
        "_wet": F.percentile(F.when(F.col("prcp") > 0, F.col("prcp")), WET).over(whole),
    })
    return days.withColumns({
        "heatwave_flag": flag(F.sum("_hot").over(run) >= RUN_LENGTH),
        "coldwave_flag": flag(F.sum("_cold").over(run) >= RUN_LENGTH),
        "heavy_rain_flag": flag(F.col("prcp") >= F.coalesce("_wet", F.lit(NO_RAIN_THRESHOLD))),
    }).drop("_hot", "_cold", "_wet")


def rolling_weather(df: DataFrame, key: str = "region_id", calendar: bool = False) -> DataFrame:
    return add_rolling(df, ROLLING_WEATHER, [key], calendar=calendar)


def derived_columns(df: DataFrame) -> DataFrame:
    """Rounded output columns and the daily range."""
    return df.withColumns({
        "avg_temp": round_half_even(F.col("tavg"), 2),
        "max_temp": round_half_even(F.col("tmax"), 2),
        "min_temp": round_half_even(F.col("tmin"), 2),
        "temp_range": round_half_even(F.col("tmax") - F.col("tmin"), 2),
        "precip": round_half_even(F.col("prcp"), 2),
        "wind_speed": round_half_even(F.col("awnd"), 2),
    })
