"""Cleaning of referral records and their roll-up to daily counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.expressions import flag, strip, text_to_date
from lagwise.operators.windows import add_rolling, keep_one

# Category spellings that are merged.
CATEGORY_NAMES = {"Other": "Other Assistance"}
DEDUP_KEY = ["ref_id", "need_id", "source_file"]
SERIES = ["region_id", "need_type"]

ROLLING_COUNTS = {
    "rolling_7d_count": ("avg", "daily_need_count", 7),
    "rolling_14d_count": ("avg", "daily_need_count", 14),
    "rolling_30d_count": ("avg", "daily_need_count", 30),
}


def require_fields(df: DataFrame, columns: Sequence[str] = ("ref_date", "category")) -> DataFrame:
    """Drop rows where a required text is missing or blank."""
    for c in columns:
        df = df.filter(F.length(strip(F.col(c))) > 0)
    return df


def normalise_dates(df: DataFrame, source: str = "ref_date") -> DataFrame:
    """Add `date`; rows whose date text cannot be read are dropped.

    Rows are dropped by way of an empty list, since a filter on the date would parse every text a second time.
    """
    dated = df.withColumn("_dates", F.array_compact(F.array(text_to_date(F.col(source)))))
    return dated.select(*[c for c in df.columns if c.lower() != "date"], F.explode("_dates").alias("date"))


def rejected_dates(df: DataFrame, keys: Sequence[str] = ("source_file",), source: str = "ref_date") -> DataFrame:
    """Rows (keys, n_rows, n_rejected): how many records have no readable date, per file."""
    date = text_to_date(F.col(source))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(date.isNull()).alias("n_rejected"))


def standardise_categories(df: DataFrame, names: dict[str, str] = CATEGORY_NAMES) -> DataFrame:
    category = strip(F.col("category"))
    for old, new in names.items():
        category = F.when(category == old, F.lit(new)).otherwise(category)
    return df.withColumn("category", category)


def deduplicate(df: DataFrame, keys: Sequence[str] = tuple(DEDUP_KEY), sequence: str = "row_seq") -> DataFrame:
    """Keep the earliest row per key."""
    return keep_one(df, keys, [F.col(sequence)])


def assign_region(df: DataFrame) -> DataFrame:
    """The state is the region; rows without one are dropped."""
    return df.withColumn("region_id", F.col("state")).filter(F.col("region_id").isNotNull())


def status_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_confirmed": flag(F.col("need_status") == "Confirmed"),
        "is_unmet": flag(F.col("need_status") == "Unmet"),
    })


def daily_counts(df: DataFrame) -> DataFrame:
    """Counts per (date, region, category); partial sums are formed before the shuffle."""
    keyed = df.filter(F.col("date").isNotNull() & F.col("region_id").isNotNull() & F.col("category").isNotNull())
    return status_flags(keyed).groupBy("date", "region_id", F.col("category").alias("need_type")).agg(
        F.count("ref_id").alias("daily_need_count"),
        F.sum("is_confirmed").alias("confirmed_count"),
        F.sum("is_unmet").alias("unmet_count"),
    )


def rolling_counts(df: DataFrame, calendar: bool = False) -> DataFrame:
    return add_rolling(df, ROLLING_COUNTS, SERIES, calendar=calendar)
