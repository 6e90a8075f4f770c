"""The feature matrix: join, lags, rolling statistics, calendar, interactions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.expressions import complete, flag, season_of
from lagwise.operators.needs import SERIES
from lagwise.operators.windows import add_lags, add_rolling
from lagwise.schemas import EVENT_FLAGS, FEATURE_COLUMNS, FEATURE_INTS, TARGET_LAGS, WEATHER_LAGS

# The public holidays the calendar flag knows by default.
HOLIDAYS = [
    date(2025, 1, 1),
    date(2025, 1, 20),
    date(2025, 2, 17),
    date(2025, 5, 26),
    date(2025, 6, 19),
    date(2025, 7, 4),
]
LAG_COLUMNS = {"max_temp": "tmax", "precip": "prcp", "target_count": "target"}
LAGS = {"tmax": WEATHER_LAGS, "prcp": WEATHER_LAGS, "target": TARGET_LAGS}
WEATHER_ROLLING = {
    "temp_rollmean_7": ("avg", "max_temp", 7),
    "temp_rollmean_14": ("avg", "max_temp", 14),
    "precip_rollsum_7": ("sum", "precip", 7),
    "precip_rollsum_30": ("sum", "precip", 30),
}
TARGET_ROLLING = {
    "target_rollmean_7": ("avg", "target_count", 7),
    "target_rollmean_14": ("avg", "target_count", 14),
}


def join_weather(needs: DataFrame, weather: DataFrame) -> DataFrame:
    """Need cells with the weather of their date and region.

    Clashing weather columns get the suffix `_wx`; the count becomes `target_count`.
    """
    clash = (set(needs.columns) & set(weather.columns)) - {"date", "region_id"}
    right = weather.withColumnsRenamed({c: f"{c}_wx" for c in clash})
    return needs.join(right, ["date", "region_id"], "inner").withColumnRenamed("daily_need_count", "target_count")


def add_lag_features(df: DataFrame, calendar: bool = False) -> DataFrame:
    return add_lags(df, LAG_COLUMNS, LAGS, SERIES, calendar=calendar)


def add_rolling_features(df: DataFrame, calendar: bool = False, strict: bool = False) -> DataFrame:
    """`strict` keeps today's target out of the target means, so they can be used to forecast it."""
    df = add_rolling(df, WEATHER_ROLLING, SERIES, calendar=calendar)
    return add_rolling(df, TARGET_ROLLING, SERIES, calendar=calendar, strict=strict)


def add_calendar_features(df: DataFrame, holidays: Sequence[date] | DataFrame = HOLIDAYS) -> DataFrame:
    """Weekday (0 = Monday), month, season, weekend and holiday flags.

    `holidays` is a short list of dates, or a table with a `date` column.
    """
    df = df.withColumns({
        "day_of_week": F.weekday("date"),
        "month": F.month("date"),
        "season": season_of(F.month("date")),
        "is_weekend": flag(F.weekday("date") >= 5),
    })
    if isinstance(holidays, DataFrame):
        days = holidays.select("date").distinct().withColumn("_holiday", F.lit(1))
        joined = df.join(days, "date", "left")
        return joined.withColumn("holiday_flag", F.coalesce("_holiday", F.lit(0))).drop("_holiday")
    return df.withColumn("holiday_flag", flag(F.col("date").isin(list(holidays))) if holidays else F.lit(0))


def add_event_features(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Bring in the event flags the frame does not have yet; 0 where no weather is known."""
    missing = [c for c in EVENT_FLAGS if c not in df.columns]
    if not missing:
        return df
    flags = weather.select("date", "region_id", *missing).dropDuplicates()
    return df.join(flags, ["date", "region_id"], "left").fillna(0, subset=EVENT_FLAGS)


def add_interactions(df: DataFrame) -> DataFrame:
    trend = F.col("max_temp") - F.col("tmax_lag_7") if "tmax_lag_7" in df.columns else F.lit(0.0)
    return df.withColumns({
        "temp_precip_interact": F.col("temp_rollmean_7") * F.col("precip_rollsum_7"),
        "temp_target_interact": F.col("temp_rollmean_7") * F.col("target_rollmean_7"),
        "temp_trend_7d": trend,
    })


def drop_incomplete_lags(df: DataFrame) -> DataFrame:
    return df.filter(complete([c for c in df.columns if "_lag_" in c]))


def select_features(df: DataFrame, text_dates: bool = False) -> DataFrame:
    """The feature columns that exist, in order, with whole numbers as int."""
    def column(name: str):
        if name in FEATURE_INTS:
            return F.col(name).cast("int").alias(name)
        if name == "date" and text_dates:
            return F.date_format("date", "yyyy-MM-dd").alias("date")
        return F.col(name)

    return df.select(*[column(c) for c in FEATURE_COLUMNS if c in df.columns])


def with_current_weather(features: DataFrame, weather: DataFrame) -> DataFrame:
    """Put the day's own weather back next to the features."""
    return features.join(weather.select("date", "region_id", "max_temp", "precip"), ["date", "region_id"], "left")
