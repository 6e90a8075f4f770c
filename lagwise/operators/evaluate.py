"""Forecast metrics, expanding-window validation, stability and improvement reports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.expressions import complete, round_stable
from lagwise.operators.boosting import fit_splits
from lagwise.operators.gram import column_shift, gather_moments, least_squares, linear_prediction, moment_sums
from lagwise.operators.models import (
    MIN_TEST, MIN_TRAIN, TARGET, TREES, available, prediction_rows,
)
from lagwise.schemas import ALL_WEATHER_FEATURES, BASE_FEATURES, BASELINE_FEATURES
from lagwise.session import cut_lineage

# The splits of the validation.
MIN_TRAIN_DAYS, TEST_DAYS = 45, 14
MIN_TRAIN_ROWS, MIN_TEST_ROWS = 20, 5


def forecast_metrics(predictions: DataFrame, keys: Sequence[str] = ("model_type", "split_index"),
                     min_test: int = 0) -> DataFrame:
    """RMSE, MAE, MAPE over non-zero actuals, NRMSE and the in-model MAPE, per group in one pass."""
    error = F.col("actual") - F.col("predicted")
    squared = F.avg(error * error)
    share = F.avg(F.when(F.col("actual") != 0, F.abs(error / F.col("actual"))))
    model_share = F.avg(F.abs(error / F.greatest(F.col("actual"), F.lit(1.0))))
    grouped = predictions.groupBy(*keys).agg(
        F.sqrt(squared).alias("_rmse"), F.avg(F.abs(error)).alias("_mae"), F.avg("actual").alias("_mean"),
        share.alias("_mape"), model_share.alias("_model_mape"), F.count(F.lit(1)).alias("n_samples"),
    ).filter(F.col("n_samples") >= min_test)
    relative = F.when(F.col("_mean") != 0, F.col("_rmse") / F.col("_mean")).otherwise(0.0)
    return grouped.select(
        *keys,
        round_stable(F.col("_rmse"), 4).alias("rmse"),
        round_stable(F.col("_mae"), 4).alias("mae"),
        round_stable(F.coalesce("_mape", F.lit(0.0)) * 100, 2).alias("mape"),
        round_stable(relative, 4).alias("nrmse"),
        round_stable(F.col("_model_mape") * 100, 2).alias("model_mape"),
        "n_samples",
    )


def stability_report(metrics: DataFrame) -> DataFrame:
    """Per model: mean and population deviation over splits, CV, and the RMSE of each split in order."""
    ordered = F.array_sort(F.collect_list(F.struct("split_index", "rmse")))
    report = metrics.groupBy("model_type").agg(
        round_stable(F.avg("rmse"), 4).alias("mean_rmse"),
        round_stable(F.stddev_pop("rmse"), 4).alias("std_rmse"),
        round_stable(F.avg("mae"), 4).alias("mean_mae"),
        round_stable(F.stddev_pop("mae"), 4).alias("std_mae"),
        round_stable(F.avg("mape"), 2).alias("mean_mape"),
        F.count("rmse").alias("n_splits"),
        F.transform(F.filter(ordered, lambda s: s["rmse"].isNotNull()), lambda s: s["rmse"]).alias("per_split_rmse"),
    )
    cv = F.when(F.col("mean_rmse") == 0, 0.0).otherwise(F.col("std_rmse") / F.col("mean_rmse"))
    return report.withColumns({"stability_score": F.col("std_rmse"), "cv_rmse": round_stable(cv, 4)})


def _bucketed(df: DataFrame, min_train_days: int, test_days: int) -> DataFrame:
    """Add `split_index`, the test window a row falls in, -1 before the first, and `_open`.

    `_open` marks windows that end on or before the last date.
    """
    ends = df.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    bounded = df.withColumn("_ends", ends)
    first = F.date_add(F.col("_ends")["lo"], min_train_days)
    window = F.greatest(F.floor(F.datediff(F.col("date"), first) / F.lit(test_days)), F.lit(-1)).cast("int")
    bounded = bounded.withColumns({"_first": first, "split_index": window})
    end = F.date_add(F.col("_first"), (F.col("split_index") + 1) * test_days)
    return bounded.withColumn("_open", (F.col("split_index") >= 0) & (end <= F.col("_ends")["hi"]))


def temporal_splits(df: DataFrame, min_train_days: int = MIN_TRAIN_DAYS, test_days: int = TEST_DAYS) -> DataFrame:
    """Expanding splits: rows (split_index, test_start, test_end, n_train, n_test).

    Rows are first counted per test window, so the running total passes over at most one row
    per window of the calendar.
    """
    counts = _bucketed(df, min_train_days, test_days).groupBy("split_index").agg(
        F.count(F.lit(1)).alias("n_test"), F.first("_first").alias("_first"), F.first("_open").alias("_open"))
    earlier = Window.orderBy("split_index").rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.withColumn("n_train", F.coalesce(F.sum("n_test").over(earlier), F.lit(0)))
    kept = splits.filter(F.col("_open") & (F.col("n_train") >= MIN_TRAIN_ROWS) & (F.col("n_test") >= MIN_TEST_ROWS))
    start = F.date_add(F.col("_first"), F.col("split_index") * test_days)
    return kept.select(
        "split_index", start.alias("test_start"), F.date_add(start, test_days).alias("test_end"), "n_train", "n_test")


def rolling_linear(df: DataFrame, columns: Sequence[str] = tuple(BASELINE_FEATURES), model: str = "baseline_ar",
                   min_train_days: int = MIN_TRAIN_DAYS, test_days: int = TEST_DAYS, alpha: float = 0.0) -> DataFrame:
    """Predictions of a linear model refitted for every expanding split, in one pass over the rows.

    Sums of products per test window, added up over the windows before each split, are the sums
    of its training rows. There is at most one fit per test window of the calendar, so the
    fits are broadcast to the scored rows.
    """
    columns = available(df, columns)
    bucketed = _bucketed(df, min_train_days, test_days)
    shift = column_shift(df, [TARGET, *columns])
    sums = moment_sums(bucketed, ["split_index"], [TARGET, *columns], shift)
    earlier = Window.partitionBy("pos").orderBy("split_index").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("value", F.sum("value").over(earlier)).filter("split_index >= 0 AND value IS NOT NULL")
    splits = temporal_splits(df, min_train_days, test_days).select("split_index")
    gathered = gather_moments(before, ["split_index"]).join(splits, "split_index")
    fits = gathered.select(
        "split_index", least_squares(F.col("moments"), alpha, shift).alias("coefficients"),
        F.col("moments")[0].alias("n_train"),
    ).filter(F.col("n_train") >= MIN_TRAIN)
    scored = bucketed.filter("_open").filter(complete([*columns, TARGET])).join(F.broadcast(fits), "split_index")
    return prediction_rows(
        scored, model, linear_prediction(F.col("coefficients"), columns), F.col("split_index"), F.col("n_train"))


def rolling_trees(df: DataFrame, models: dict[str, Sequence[str]] | None = None, settings: dict | None = None,
                  min_train_days: int = MIN_TRAIN_DAYS, test_days: int = TEST_DAYS) -> DataFrame:
    """Predictions of boosted trees refitted for every expanding split, all splits of all models at once.

    `models` has the weather features of each model; the base features come first.
    """
    columns = {
        name: available(df, list(dict.fromkeys([*BASE_FEATURES, *features])))
        for name, features in (models or {"var_all_weather": ALL_WEATHER_FEATURES}).items()
    }
    rows = cut_lineage(df)
    splits = [r["split_index"] for r in temporal_splits(rows, min_train_days, test_days).select("split_index").collect()]
    out = fit_splits(
        _bucketed(rows, min_train_days, test_days), splits, columns, TARGET, settings or TREES, prediction_rows, MIN_TRAIN, MIN_TEST)
    return prediction_rows(rows.limit(0), "", F.lit(0.0), F.lit(0), F.lit(0)) if out is None else out


def rolling_validation(df: DataFrame, selected: Sequence[str], settings: dict | None = None,
                       min_train_days: int = MIN_TRAIN_DAYS, test_days: int = TEST_DAYS) -> DataFrame:
    """Metrics per split of the three models: baseline, all weather, selected weather."""
    models = {"var_all_weather": ALL_WEATHER_FEATURES, "granger_selected": selected}
    # The baseline is a few small jobs, which run beside the trees.
    with ThreadPoolExecutor(1) as pool:
        linear = pool.submit(lambda: cut_lineage(forecast_metrics(
            rolling_linear(df, min_train_days=min_train_days, test_days=test_days), min_test=MIN_TEST)))
        trees = rolling_trees(df, models, settings, min_train_days, test_days)
    return linear.result().unionByName(forecast_metrics(trees, min_test=MIN_TEST))


def _gain(base: Column, other: Column, floor: float | None = None) -> Column:
    """Reduction in percent; NULL where the base is zero and no floor is given."""
    below = F.greatest(base, F.lit(floor)) if floor else F.nullif(base, F.lit(0.0))
    return (base - other) / below * 100


def improvements(reports: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """One row of improvements over the baseline, in percent.

    `reports` has one row per model; `drift` has columns `model` and `extreme_rmse`.
    """
    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model_type") == model, F.col(column)))

    wide = reports.agg(
        of("baseline_ar", "mean_rmse").alias("b"), of("granger_selected", "mean_rmse").alias("g"),
        of("var_all_weather", "mean_rmse").alias("v"), of("baseline_ar", "std_rmse").alias("bs"),
        of("granger_selected", "std_rmse").alias("gs"),
    )
    c = F.col
    columns = [
        round_stable(_gain(c("b"), c("g")), 1).alias("granger_vs_baseline_rmse_pct"),
        round_stable(_gain(c("bs"), c("gs"), 1e-6), 1).alias("granger_vs_baseline_stability_pct"),
        round_stable(_gain(c("b"), c("v")), 1).alias("var_vs_baseline_rmse_pct"),
    ]
    if drift is not None:
        both = drift.agg(
            F.max(F.when(F.col("model") == "baseline", F.col("extreme_rmse"))).alias("b"),
            F.max(F.when(F.col("model") == "granger_selected", F.col("extreme_rmse"))).alias("g"),
        )
        gain = both.select(round_stable(_gain(c("b"), c("g")), 1))
        columns.append(gain.scalar().alias("robustness_gain_pct"))
    return wide.select(*columns)


def model_comparison(metrics: DataFrame, base: str = "baseline_ar") -> DataFrame:
    """Metrics per model with the RMSE improvement over the base model; NULL for the base itself."""
    base_rmse = metrics.filter(F.col("model_type") == base).agg(F.max("rmse")).scalar()
    gain = F.when(F.col("model_type") != base, round_stable(_gain(F.col("_base"), F.col("rmse")), 1))
    return metrics.withColumn("_base", base_rmse).withColumn("rmse_improvement_pct", gain).drop("_base")
