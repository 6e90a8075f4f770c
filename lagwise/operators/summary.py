"""Summaries and reports over the daily panels and the stored results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.expressions import neg_log10_p, round_stable
from lagwise.functions.moments import PAIR_MOMENTS, PAIR_TYPES, merged_correlations
from lagwise.schemas import EVENT_FLAGS

# Number of equal bins over [0, 1] in the p-value histogram.
HISTOGRAM_BINS = 30


def national_daily(needs: DataFrame, weather: DataFrame, temp: str = "avg_temp") -> DataFrame:
    """Total need count and mean temperature per date, over all dates either side has."""
    counts = needs.groupBy("date").agg(F.sum("daily_need_count").alias("daily_need_count"))
    temps = weather.groupBy("date").agg(round_stable(F.avg(temp), 4).alias(temp))
    columns = ["date", "daily_need_count", temp]
    return (
        counts.withColumn(temp, F.lit(None).cast("double")).select(*columns)
        .unionByName(temps.withColumn("daily_need_count", F.lit(None).cast("long")).select(*columns))
        .groupBy("date")
        .agg(F.max("daily_need_count").alias("daily_need_count"), F.max(temp).alias(temp))
    )


def totals_by(df: DataFrame, key: str, value: str, output: str, ascending: bool = True) -> DataFrame:
    order = F.col(output).asc() if ascending else F.col(output).desc()
    return df.groupBy(key).agg(F.sum(value).alias(output)).orderBy(order, key)


def distinct_counts(df: DataFrame, specs: dict[str, Sequence[str]]) -> DataFrame:
    """One row; `specs` maps output name to the columns of a key.

    Each key is counted by its own distinct, so no row is multiplied by the number of keys.
    """
    parts = {
        name: df.select(*columns).dropna().distinct().agg(F.count(F.lit(1)).alias(name))
        for name, columns in specs.items()
    }
    (first, base), *rest = parts.items()
    return base.select(first, *[part.scalar().alias(name) for name, part in rest])


def describe(df: DataFrame, specs: dict[str, tuple[str, str]], keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Rounded summary values; `specs` maps output name to (function, column)."""
    functions = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count}
    aggregates = []
    for name, (fn, column) in specs.items():
        value = functions[fn](column)
        aggregates.append((value if fn == "count" else round_stable(value.cast("double"), digits)).alias(name))
    return df.groupBy(*keys).agg(*aggregates)


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return counted if top is None else counted.limit(top)


def lag_heatmap(results: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("feature_name",),
                average_first: bool = False, digits: int = 6) -> DataFrame:
    """Mean of −log10 p per feature and lag; with `average_first`, −log10 of the mean p.

    The lags are given, so no extra pass is needed to find the output columns.
    """
    value = F.avg("p_value") if average_first else F.avg(neg_log10_p(F.col("p_value")))
    wide = results.groupBy(*keys).pivot("lag", list(lags)).agg(value)
    finish = neg_log10_p if average_first else (lambda c: c)
    return wide.select(*keys, *[round_stable(finish(F.col(str(k))), digits).alias(f"lag_{k}") for k in lags])


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows (feature, then one value per column), pairwise complete, from a single pass.

    Counts, sums, squares and products over the pairs come from four products of the masked value matrix of each Arrow
    batch, added up per task. Values are taken off the means of the task's first rows, so that no digits are lost; a task
    sends one row of moments per pair of columns.
    """
    k, names = len(columns), list(columns)
    values = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shift = np.zeros((4, k, k)), None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).reshape(-1, k)
            known = ~np.isnan(x)
            if shift is None and len(x):
                shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
            x = np.where(known, x - shift, 0.0)
            mask = known.astype(float)
            sums += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        if shift is None:
            return
        n, total, square, product = sums
        mean = total / np.maximum(n, 1)
        own = square - total * mean
        found = [n.astype(np.int64), mean + shift[:, None], (mean + shift[:, None]).T, own, own.T, product - total * mean.T]
        first, second = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, object)[i.ravel()]) for i in (first, second)] + [pa.array(f.ravel()) for f in found],
            ["feature", "other", *PAIR_MOMENTS])

    pairs = merged_correlations(values.mapInArrow(products, f"feature string, other string, {PAIR_TYPES}"), ["feature", "other"])
    return pairs.groupBy("feature").pivot("other", names).agg(F.max(round_stable(F.col("corr"), digits)))


def p_histogram(results: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Tests per feature and equal-width bin of [0, 1]; the last bin is closed."""
    position = F.least(F.floor(F.col("p_value") * bins) + 1, F.lit(bins)).cast("int")
    return (
        results.filter(F.col("p_value").between(0, 1))
        .groupBy("feature_name", position.alias("bin")).agg(F.count(F.lit(1)).alias("tests"))
    )


def event_counts(weather: DataFrame) -> DataFrame:
    flags = [F.col(c) for c in EVENT_FLAGS]
    return weather.agg(
        F.sum("heatwave_flag").alias("heatwave_days"),
        F.sum("coldwave_flag").alias("coldwave_days"),
        F.sum("heavy_rain_flag").alias("heavy_rain_days"),
        F.sum(1 - F.greatest(*flags)).alias("normal_days"),
    )


def discovery_rate(results: DataFrame) -> DataFrame:
    counted = results.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col("significant_flag") == 1).alias("significant_tests"),
        F.min("p_value").alias("min_p"),
    )
    share = F.col("significant_tests") / F.greatest(F.col("total_tests"), F.lit(1)) * 100
    return counted.select("total_tests", "significant_tests", round_stable(share, 1).alias("discovery_pct"), "min_p")


def headline(needs_raw: DataFrame, weather: DataFrame, needs: DataFrame, features: DataFrame,
             causal: DataFrame, experiments: DataFrame) -> DataFrame:
    """Seven counts over the whole store, each table counted once; stored panels are best, as features are made of them."""
    rows = F.count(F.lit(1))
    tests = causal.agg(F.struct(rows.alias("n"), F.count_if(F.col("significant_flag") == 1).alias("significant"))).scalar()
    return needs_raw.agg(rows.alias("raw_records")).select(
        "raw_records",
        weather.agg(F.countDistinct("region_id")).scalar().alias("states"),
        needs.agg(F.countDistinct("need_type")).scalar().alias("need_categories"),
        features.agg(rows).scalar().alias("feature_rows"),
        tests["n"].alias("granger_tests"),
        tests["significant"].alias("significant_tests"),
        experiments.agg(rows).scalar().alias("experiments"),
    )


def filter_results(results: DataFrame, feature: str | None = None, significant_only: bool = False,
                   max_lag: int | None = None) -> DataFrame:
    """Causal results under optional filters, smallest p first; `max_lag` 0 or None is no limit."""
    if feature:
        results = results.filter(F.col("feature_name") == feature)
    if significant_only:
        results = results.filter("significant_flag = 1")
    if max_lag:
        results = results.filter(F.col("lag") <= max_lag)
    return sort_by_p(results)


def sort_by_p(results: DataFrame) -> DataFrame:
    """Ties are put in order by the remaining columns, so the order is reproducible."""
    return results.orderBy("p_value", *[c for c in results.columns if c != "p_value"])


def smallest_p(results: DataFrame, n: int = 10, below: float | None = None) -> DataFrame:
    if below is not None:
        results = results.filter(F.col("p_value") < below)
    return sort_by_p(results).limit(n)


def series(features: DataFrame, region: str, need_type: str) -> DataFrame:
    return features.filter((F.col("region_id") == region) & (F.col("need_type") == need_type)).orderBy("date")


def regions_only(df: DataFrame, regions: Sequence[str]) -> DataFrame:
    return df.filter(F.col("region_id").isin(list(regions)))


def stability_rating(reports: DataFrame, cv: str = "cv_rmse") -> DataFrame:
    rating = F.when(F.col(cv) < 0.25, "High").when(F.col(cv) < 0.4, "Medium").otherwise("Low")
    return reports.withColumn("stability", rating)




def splits_per_experiment(metrics: DataFrame, experiments: DataFrame, like: str) -> DataFrame:
    """Metric rows per experiment of a kind; counted first, so the join sees one row per experiment."""
    counted = metrics.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("split_count"))
    return counted.join(experiments.filter(F.col("model_type").like(like)), "experiment_id", "left_semi")
