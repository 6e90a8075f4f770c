"""Key coverage between the needs panel and the weather panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.expressions import round_stable

CELL = ["date", "region_id"]


def shared_keys(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns).intersect(right.select(*columns))


def missing_keys(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys of `left` that `right` does not have."""
    return left.select(*columns).subtract(right.select(*columns))


def unmatched_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of `left` without a partner, written as an anti join rather than NOT IN."""
    return left.join(right.select(*columns), list(columns), "left_anti")


def matched_pairs(needs: DataFrame, weather: DataFrame, columns: Sequence[str] = tuple(CELL)) -> DataFrame:
    """One row: distinct need cells that have weather."""
    held = needs.select(*columns).distinct().join(weather.select(*columns), list(columns), "left_semi")
    return held.agg(F.count(F.lit(1)).alias("matched_pairs"))


IN_NEEDS, IN_WEATHER = 1, 2


def presence(needs: DataFrame, weather: DataFrame, columns: Sequence[str] = tuple(CELL)) -> DataFrame:
    """Distinct cells of either side with a mask of the sides that have them; each side is read once."""
    marked = [df.select(*columns, F.lit(bit).alias("mask")) for df, bit in ((needs, IN_NEEDS), (weather, IN_WEATHER))]
    return marked[0].unionByName(marked[1]).groupBy(*columns).agg(F.bit_or("mask").alias("mask"))


def alignment_report(needs: DataFrame, weather: DataFrame) -> DataFrame:
    """One row with the coverage of regions, dates and (date, region) cells.

    Cells carry a mask of the sides that have them. One pass over the cells groups the masks by region and by date at once;
    the cells of a region are counted on the way. The list of regions without weather is as long as the region dimension.
    """
    both = IN_NEEDS | IN_WEATHER
    keyed = F.col("date").isNotNull() & F.col("region_id").isNotNull()
    masks = presence(needs, weather).groupingSets([["region_id"], ["date"]], "region_id", "date").agg(
        F.grouping("date").alias("by_region"), F.bit_or("mask").alias("mask"),
        F.count_if(F.col("mask").bitwiseAND(IN_NEEDS) > 0).alias("cells"),
        F.count_if((F.col("mask") == both) & keyed).alias("matched"),
    )

    def keys(by_region: int, has: int) -> Column:
        return F.count_if((F.col("by_region") == by_region) & (F.col("mask").bitwiseAND(has) == has))

    region = F.col("by_region") == 1
    report = masks.agg(
        keys(1, IN_NEEDS).alias("social_needs_states"),
        keys(1, IN_WEATHER).alias("weather_states"),
        keys(1, both).alias("matched_states"),
        F.array_sort(F.collect_list(F.when(region & (F.col("mask") == IN_NEEDS), F.col("region_id")))).alias("missing_weather_states"),
        keys(0, IN_NEEDS).alias("social_needs_dates"),
        keys(0, IN_WEATHER).alias("weather_dates"),
        keys(0, both).alias("overlapping_dates"),
        F.coalesce(F.sum(F.when(region, F.col("cells"))), F.lit(0)).alias("social_needs_pairs"),
        F.coalesce(F.sum(F.when(region, F.col("matched"))), F.lit(0)).alias("matched_pairs"),
    )
    share = F.col("matched_pairs") / F.greatest(F.col("social_needs_pairs"), F.lit(1)) * 100
    return report.withColumn("coverage_pct", round_stable(share, 1))
