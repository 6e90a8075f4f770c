"""The stages as single calls; each is a DataFrame -> DataFrame function."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators import causality, evaluate, models
from lagwise.operators import features as fx
from lagwise.operators import needs as nd
from lagwise.operators import weather as wx
from lagwise.operators.align import alignment_report
from lagwise.operators.features import with_current_weather
from lagwise.schemas import ALL_WEATHER_FEATURES, BASE_FEATURES, NEEDS_DAILY, WEATHER_DAILY
from lagwise.session import cut_lineage
from lagwise.sources import results as stored
from lagwise.sources.tables import write_summary


def clean_weather(raw: DataFrame, calendar: bool = False) -> DataFrame:
    """Raw readings, one per (date, region), to the daily weather panel.

    Every step works on the region's series in date order, so the plan has one shuffle and
    one sort.
    """
    df = wx.fill_gaps(raw)
    df = wx.winsorise(df)
    df = wx.flag_events(df)
    df = wx.rolling_weather(df, calendar=calendar)
    return wx.derived_columns(df).select(*WEATHER_DAILY.fieldNames())


def clean_needs(raw: DataFrame, calendar: bool = False) -> DataFrame:
    """Referral records to the daily need panel."""
    df = nd.normalise_dates(raw)
    df = nd.standardise_categories(df)
    df = nd.deduplicate(df)
    df = nd.assign_region(df)
    df = nd.rolling_counts(nd.daily_counts(df), calendar=calendar)
    return df.select(*NEEDS_DAILY.fieldNames())


def daily_panel(raw_weather: DataFrame, raw_needs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weather panel, need panel and the report on how they line up."""
    weather, needs = clean_weather(raw_weather), clean_needs(raw_needs)
    return weather, needs, alignment_report(needs, weather)


def build_features(weather: DataFrame, needs: DataFrame, calendar: bool = False, strict: bool = False,
                   holidays=fx.HOLIDAYS) -> DataFrame:
    """The feature matrix; lags are taken on the rows that survive the join."""
    df = fx.join_weather(needs, weather)
    df = fx.add_lag_features(df, calendar=calendar)
    df = fx.add_rolling_features(df, calendar=calendar, strict=strict)
    df = fx.add_calendar_features(df, holidays)
    df = fx.add_event_features(df, weather)
    df = fx.add_interactions(df)
    return fx.select_features(fx.drop_incomplete_lags(df))


def causal_report(features: DataFrame, weather: DataFrame, max_lag: int = causality.MAX_LAG,
                  significance: float = causality.SIGNIFICANCE) -> DataFrame:
    """Granger tests of the day's weather on the target, per series.

    The tested panel is read twice, for the unit-root tests and for the lags, so it is checkpointed.
    """
    panel = cut_lineage(with_current_weather(features, weather))
    return causality.granger_tests(panel, max_lag=max_lag, significance=significance)


def selected_features(results: DataFrame) -> list[str]:
    """Names of the selected weather columns: at most the lag columns and the fixed ones."""
    chosen = causality.select_lag_features(causality.significant_lags(results))
    return sorted(r["feature"] for r in chosen.collect())


def fit_models(features: DataFrame, selected: list[str], settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Hold-out predictions of the three models, and the gains of the tree models.

    The feature matrix should be a stored or checkpointed table: each fit reads it several times.
    """
    train, test = models.holdout(features)
    # A fit is many small jobs one after the other, so both run at the same time.
    with ThreadPoolExecutor(2) as pool:
        everything, chosen = pool.map(
            lambda m: models.weather_model(train, test, m[1], m[0], settings),
            [("var_all_weather", ALL_WEATHER_FEATURES), ("granger_selected", selected)])
    predictions = models.baseline(train, test)
    importances = None
    for predicted, gains in (everything, chosen):
        if predicted is not None:
            predictions = predictions.unionByName(predicted)
            importances = gains if importances is None else importances.unionByName(gains)
    return predictions, importances


def store_causal(root: str, results: DataFrame, features: DataFrame, experiment_id: str) -> None:
    """Store the rows of a causal report under one header."""
    span = features.agg(F.min("date").alias("train_start"), F.max("date").alias("train_end"))
    headers = span.select(*stored.header(
        F.lit(experiment_id), F.lit("granger_causality"), F.lit("Granger causality tests of weather on needs"),
        train_start=F.col("train_start"), train_end=F.col("train_end")))
    rows = results.withColumn("experiment_id", F.lit(experiment_id))
    stored.store_experiments(results.sparkSession, root, headers, {"causal_results": rows})


def store_holdout(root: str, predictions: DataFrame, importances: DataFrame | None, train_start: Column, run_id: str) -> None:
    """Store the hold-out metrics, one experiment per model, with its gains as parameters."""
    ids = F.concat_ws("-", F.lit(run_id), "model_type")
    found = predictions.groupBy("model_type").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    gains = F.lit("{}")
    if importances is not None:
        packed = importances.groupBy("model_type").agg(
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "importance"))))).alias("gains"))
        found, gains = found.join(packed, "model_type", "left"), F.coalesce("gains", F.lit("{}"))
    headers = found.select(*stored.header(
        ids, F.col("model_type"), F.concat("model_type", F.lit(" model on the hold-out days")), gains,
        train_start=train_start, train_end=F.date_sub("test_start", 1), test_start=F.col("test_start"), test_end=F.col("test_end")))
    metrics = evaluate.forecast_metrics(predictions, ["model_type"], min_test=models.MIN_TEST)
    metrics = metrics.withColumns({"experiment_id": ids, "split_index": F.lit(0)})
    stored.store_experiments(predictions.sparkSession, root, headers, {"metrics": metrics})


def store_rolling(root: str, metrics: DataFrame, dates: DataFrame, run_id: str) -> None:
    """Store a rolling validation, one experiment per model: the report in its header, its RMSE per split as metrics.

    The other values of a metric row are those of the model's report. `dates` has the first and last date (`train_start`, `train_end`).
    """
    reports = evaluate.stability_report(metrics)
    ids = F.concat_ws("-", F.lit(run_id), "model_type")
    days = dates.select(F.struct("train_start", "train_end")).scalar()
    headers = reports.withColumn("_days", days).select(*stored.header(
        ids, F.concat(F.lit("rolling_"), "model_type"),
        F.concat(F.lit("Rolling validation of "), "model_type", F.lit(", "), "n_splits", F.lit(" splits")),
        F.to_json(F.struct(*reports.columns)), train_start=F.col("_days")["train_start"], train_end=F.col("_days")["train_end"]))
    rows = metrics.select("model_type", "split_index", "rmse", "nrmse").join(
        reports.select("model_type", F.col("mean_mae").alias("mae"), F.col("mean_mape").alias("mape"), "stability_score"), "model_type")
    stored.store_experiments(metrics.sparkSession, root, headers, {"metrics": rows.withColumn("experiment_id", ids)})


def stored_run(root: str, features: DataFrame, weather: DataFrame, run_id: str, settings: dict | None = None) -> DataFrame:
    """Causal report, selection, models and hold-out metrics of one run, stored under ids that begin with `run_id`.

    Returns the comparison of the models. A repeated run replaces what it stored before.
    """
    rows = cut_lineage(features)
    causes = cut_lineage(causal_report(rows, weather))
    store_causal(root, causes, rows, f"{run_id}-causal")
    predictions, importances = fit_models(rows, selected_features(causes), settings)
    predictions = cut_lineage(predictions)
    store_holdout(root, predictions, importances, rows.agg(F.min("date")).scalar(), run_id)
    return holdout_comparison(predictions)


def holdout_comparison(predictions: DataFrame) -> DataFrame:
    """Metrics per model and improvement over the baseline."""
    metrics = evaluate.forecast_metrics(predictions, ["model_type"], min_test=models.MIN_TEST)
    return evaluate.model_comparison(metrics)


def evaluation(features: DataFrame, selected: list[str], settings: dict | None = None, drift_settings: dict | None = None,
               min_train_days: int = evaluate.MIN_TRAIN_DAYS, test_days: int = evaluate.TEST_DAYS) -> DataFrame:
    """One row with the stability reports, both drift analyses and the improvements.

    The feature matrix is checkpointed once, as every model fit reads it again; so are the
    results of the fits, as several parts of the summary read those.
    """
    return _evaluated(cut_lineage(features), selected, settings, drift_settings, min_train_days, test_days)[0]


def _evaluated(rows: DataFrame, selected: list[str], settings: dict | None = None, drift_settings: dict | None = None,
               min_train_days: int = evaluate.MIN_TRAIN_DAYS, test_days: int = evaluate.TEST_DAYS) -> tuple[DataFrame, DataFrame]:
    """The summary and the metrics per split behind it."""
    all_columns = [*BASE_FEATURES, *ALL_WEATHER_FEATURES]

    def extreme(name: str, columns: list[str]) -> DataFrame:
        return cut_lineage(models.extreme_weather(rows, columns, drift_settings).withColumn("model", F.lit(name)))

    # The drift analyses are many small jobs, which run beside the rolling validation.
    with ThreadPoolExecutor(3) as pool:
        extremes = [pool.submit(extreme, "granger_selected", all_columns), pool.submit(extreme, "baseline", BASE_FEATURES)]
        seasonal = pool.submit(lambda: cut_lineage(models.seasonal_drift(rows, all_columns)))
        metrics = cut_lineage(evaluate.rolling_validation(rows, selected, settings, min_train_days, test_days))
    drift = extremes[0].result().unionByName(extremes[1].result())
    reports = evaluate.stability_report(metrics)
    packed = F.array_sort(F.collect_list(F.struct("*")))
    summary = evaluate.improvements(reports, drift).select(
        F.struct("*").alias("improvements"),
        reports.agg(packed).scalar().alias("stability_reports"),
        seasonal.result().agg(packed).scalar().alias("seasonal_drift"),
        drift.select("model", *[c for c in drift.columns if c != "model"]).agg(packed).scalar().alias("extreme_weather_drift"),
    )
    return summary, metrics


def stored_evaluation(root: str, features: DataFrame, selected: list[str], run_id: str, **settings) -> DataFrame:
    """`evaluation`, with the rolling metrics stored as experiments and the summary as JSON under `root`."""
    rows = cut_lineage(features)
    found, metrics = _evaluated(rows, selected, **settings)
    found = cut_lineage(found)
    store_rolling(root, metrics, rows.agg(F.min("date").alias("train_start"), F.max("date").alias("train_end")), run_id)
    write_summary(found, f"{root}/summaries/{run_id}")
    return found
