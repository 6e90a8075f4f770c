"""Causality, models and evaluation against plain numpy."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import causality, evaluate, models
from lagwise.schemas import BASELINE_FEATURES
from test_statistics import brute_granger

START = date(2024, 1, 1)


def panel(spark, n=400, seed=5, series=("Food", "Rent", "Flat", "Short")):
    rng = np.random.default_rng(seed)
    frames = []
    for name in series:
        rows = 40 if name == "Short" else n
        x = rng.normal(60, 8, rows)
        y = rng.normal(20, 2, rows)
        if name == "Food":
            y[3:] += 0.5 * (x[:-3] - 60)
        if name == "Rent":
            x = np.cumsum(rng.normal(size=rows))
        if name == "Flat":
            x = np.full(rows, 5.0)
        frames.append(pd.DataFrame({
            "date": [START + timedelta(days=i) for i in range(rows)], "region_id": "CA", "need_type": name,
            "target_count": y, "max_temp": x, "precip": rng.normal(size=rows)}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf, "date date, region_id string, need_type string, target_count double, max_temp double, precip double"), pdf


def test_granger_equals_refitting(spark):
    df, pdf = panel(spark)
    got = {(r["need_type"], r["feature_name"], r["lag"]): r for r in causality.granger_tests(df).collect()}
    food = pdf[pdf.need_type == "Food"]
    for lag in (1, 3, 15):
        want, _ = brute_granger(food.target_count.to_numpy(), food.max_temp.to_numpy(), lag)
        assert got[("Food", "max_temp", lag)]["f_statistic"] == pytest.approx(want, abs=2e-4, rel=1e-6)
    assert got[("Food", "max_temp", 3)]["significant_flag"] == 1
    assert got[("Food", "max_temp", 1)]["p_value"] > 0.001
    rent = pdf[pdf.need_type == "Rent"]
    want, _ = brute_granger(rent.target_count.to_numpy()[1:], np.diff(rent.max_temp.to_numpy()), 4)
    assert got[("Rent", "max_temp", 4)]["f_statistic"] == pytest.approx(want, abs=2e-4, rel=1e-6)
    assert not any(k[0] == "Short" for k in got)
    assert not any(k[:2] == ("Flat", "max_temp") for k in got)
    assert len([k for k in got if k[:2] == ("Flat", "precip")]) == 15


def test_lag_choice_and_features(spark):
    schema = "feature_name string, lag int, p_value double, significant_flag int"
    some = spark.createDataFrame([("max_temp", 5, 0.01, 1), ("max_temp", 2, 0.02, 1), ("precip", 3, 0.1, 0)], schema)
    assert {r["feature_name"]: r["lags"] for r in causality.significant_lags(some).collect()} == {"max_temp": [2, 5]}
    none = some.filter("significant_flag = 0")
    assert [r["lags"] for r in causality.significant_lags(none).collect()] == [[3]]
    assert [r["lags"] for r in causality.stored_significant_lags(none).collect()] == [[3]]
    assert causality.significant_lags(some.limit(0)).count() == 0
    picked = {r["feature"] for r in causality.select_lag_features(causality.significant_lags(some)).collect()}
    # 2 lies between 1 and 3, 5 between 3 and 7: the smaller wins both times.
    assert {"tmax_lag_1", "tmax_lag_3"} <= picked and len(picked) == 10


@pytest.mark.parametrize("piece", [50_000, 97, 10])
def test_cross_correlation_equals_numpy(spark, piece):
    df, pdf = panel(spark)
    got = {r["lag"]: r for r in causality.cross_correlations(df, max_lag=10, piece=piece).collect()}
    assert sorted(got) == list(range(11))
    for lag in (0, 3, 10):
        corrs = []
        for name, g in pdf.groupby("need_type"):
            if name != "Flat":
                x, y = g.max_temp.to_numpy(), g.target_count.to_numpy()
                corrs.append(np.corrcoef(x[: len(x) - lag], y[lag:])[0, 1])
        assert got[lag]["mean_corr"] == pytest.approx(np.mean(corrs))
        assert got[lag]["std_corr"] == pytest.approx(np.std(corrs, ddof=1))


def test_cross_correlation_with_gaps_and_long_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(START + timedelta(days=i // 3), "R", f"n{i % 3}", *(None if rng.random() < 0.1 else float(v) + 1e6 for v in rng.normal(size=2))) for i in range(900)]
    df = spark.createDataFrame(rows, "date date, region_id string, need_type string, target_count double, max_temp double").repartition(5)
    found = causality.cross_correlations(df, max_lag=7, keys=["region_id"], order=["date", "need_type"], piece=40)
    got = {r["lag"]: r["mean_corr"] for r in found.collect()}
    y, x = (np.array([np.nan if r[i] is None else r[i] for r in rows]) for i in (3, 4))
    for lag in range(8):
        a, b = x[: len(x) - lag], y[lag:]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert got[lag] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)


def features(spark, n=200, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for need in ("Food", "Rent"):
        for i in range(n):
            d = START + timedelta(days=i)
            flags = [int(rng.random() < 0.05) for _ in range(3)]
            lag7 = int(rng.integers(1, 30))
            rows.append((d, "CA", need, int(lag7 * 0.5 + rng.integers(0, 9)), lag7, d.weekday(), d.month,
                         int(d.weekday() >= 5), float(rng.normal(60, 9)), *flags,
                         ["winter", "spring", "summer", "fall"][d.month % 12 // 3]))
    names = ["date", "region_id", "need_type", "target_count", "target_lag_7", "day_of_week", "month", "is_weekend",
             "tmax_lag_1", "heatwave_flag", "coldwave_flag", "heavy_rain_flag", "season"]
    schema = ("date date, region_id string, need_type string, target_count int, target_lag_7 int, day_of_week int, month int, "
              "is_weekend int, tmax_lag_1 double, heatwave_flag int, coldwave_flag int, heavy_rain_flag int, season string")
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=names)


def ols(train, test, columns):
    x = np.column_stack([np.ones(len(train)), train[columns]])
    beta, *_ = np.linalg.lstsq(x, train["target_count"].to_numpy(float), rcond=None)
    return np.maximum(np.column_stack([np.ones(len(test)), test[columns]]) @ beta, 0)


def test_baseline_equals_numpy(spark):
    df, pdf = features(spark)
    train, test = models.holdout(df)
    assert test.count() == 62
    got = models.baseline(train, test).orderBy("need_type", "date").toPandas()
    cut = pdf.date.max() - timedelta(days=30)
    held = pdf[pdf.date >= cut].sort_values(["need_type", "date"])
    assert got.predicted.to_numpy() == pytest.approx(ols(pdf[pdf.date < cut], held, BASELINE_FEATURES))


def test_baseline_needs_ten_rows(spark):
    df, _ = features(spark, n=34)
    train, test = models.holdout(df)
    assert models.baseline(train, test).count() == 0


def brute_splits(pdf, first=45, width=14):
    lo, hi = pdf.date.min(), pdf.date.max()
    start, index = lo + timedelta(days=first), 0
    while start + timedelta(days=width) <= hi:
        end = start + timedelta(days=width)
        train, test = pdf[pdf.date < start], pdf[(pdf.date >= start) & (pdf.date < end)]
        if len(train) >= 20 and len(test) >= 5:
            yield index, train, test
        start, index = end, index + 1


def test_rolling_fits_equal_refitting_each_split(spark):
    df, pdf = features(spark)
    df, pdf = df.filter("date < '2024-04-01' OR date >= '2024-04-20'"), pdf[
        (pdf.date < date(2024, 4, 1)) | (pdf.date >= date(2024, 4, 20))]
    splits = {r["split_index"]: r for r in evaluate.temporal_splits(df).collect()}
    got = {r["split_index"]: r for r in evaluate.forecast_metrics(evaluate.rolling_linear(df)).collect()}
    want = list(brute_splits(pdf))
    assert set(splits) == set(got) == {i for i, *_ in want}
    for i, train, test in want:
        assert (splits[i]["n_train"], splits[i]["n_test"]) == (len(train), len(test))
        error = test["target_count"] - ols(train, test, BASELINE_FEATURES)
        assert got[i]["rmse"] == pytest.approx(float(np.sqrt((error**2).mean())), abs=6e-5)


def test_seasonal_drift_equals_numpy(spark):
    df, pdf = features(spark)
    columns = ["target_lag_7", "tmax_lag_1", "month", "day_of_week", "is_weekend", "heatwave_flag", "coldwave_flag", "heavy_rain_flag"]
    got = {r["train_season"]: r for r in models.seasonal_drift(df, columns).collect()}
    for before, after in (("winter", "spring"), ("spring", "summer")):
        train, test = pdf[pdf.season == before], pdf[pdf.season == after]
        x, y = train[columns].to_numpy(float), train["target_count"].to_numpy(float)
        xc = x - x.mean(0)
        beta = np.linalg.solve(xc.T @ xc + np.eye(len(columns)), xc.T @ (y - y.mean()))
        pred = np.maximum(y.mean() + (test[columns].to_numpy(float) - x.mean(0)) @ beta, 0)
        error = test["target_count"] - pred
        assert got[before]["rmse"] == pytest.approx(float(np.sqrt((error**2).mean())), abs=6e-5)
        assert (got[before]["n_train"], got[before]["n_test"]) == (len(train), len(test))


@pytest.mark.parametrize("width", [2, 9])
def test_sums_keep_null_keys(spark, width):
    from lagwise.operators import gram

    columns = [f"c{i}" for i in range(width)]
    rows = [("k" if i % 2 else None, *[float((i * (j + 3)) % 7) for j in range(width)]) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = {(r["key"], r["pos"]): r["value"] for r in gram.moment_sums(df, ["key"], columns).collect()}
    for key in ("k", None):
        x = np.array([[1.0, *r[1:]] for r in rows if r[0] == key])
        want = (x.T @ x)[np.triu_indices(width + 1)]
        assert [got[(key, p)] for p in range(len(want))] == pytest.approx(want.tolist())


@pytest.mark.parametrize("mean", [0.0, 1e4, 1e6, 1e8])
def test_least_squares_keeps_digits(spark, mean):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    y = 2 * x + rng.normal(size=20_000)
    want = np.polyfit(x, y, 1)[0]
    df = spark.createDataFrame(pd.DataFrame({models.TARGET: y + mean, "x": x + mean})).repartition(4)
    found = models.fit_linear(df, ["x"]).first()["coefficients"]
    assert found[1] == pytest.approx(want, abs=1e-6)
    assert found[0] + found[1] * mean == pytest.approx(mean + np.polyfit(x, y, 1)[1], abs=1e-4)


def test_positions_and_extreme_split(spark):
    df, pdf = features(spark, 60)
    placed = models.with_position(df, ["date", "region_id", "need_type"]).orderBy("position").toPandas()
    assert placed.position.tolist() == list(range(1, 121))
    assert placed[["date", "need_type"]].values.tolist() == pdf.sort_values(["date", "need_type"])[["date", "need_type"]].values.tolist()
    train, normal, extreme = models.extreme_split(df, ["tmax_lag_1"])
    calm = int((pdf[["heatwave_flag", "coldwave_flag", "heavy_rain_flag"]].max(axis=1) == 0).sum())
    assert (train.count(), normal.count(), extreme.count()) == (int(calm * 0.8), calm - int(calm * 0.8), 120 - calm)


def test_extreme_weather_needs_rows(spark):
    df, _ = features(spark, 20)
    assert models.extreme_weather(df, ["tmax_lag_1"]).collect()[0]["normal_rmse"] is None


def test_trees_predict_and_rank(spark):
    df, _ = features(spark)
    train, test = models.holdout(df)
    predicted, gains = models.weather_model(train, test, ["tmax_lag_1"], settings={"maxIter": 3, "maxDepth": 3, "seed": 42})
    assert predicted.filter("predicted < 0").count() == 0 and predicted.count() == test.count()
    assert sum(r["importance"] for r in gains.collect()) == pytest.approx(1.0, abs=0.001)
    assert models.weather_model(train.limit(5), test, ["tmax_lag_1"]) == (None, None)


PREDS = [("a", 0, 0.0, 1.0), ("a", 0, 10.0, 8.0), ("a", 1, 4.0, 4.0), ("b", 0, 0.0, 0.0), ("b", 1, 5.0, 10.0), ("b", 2, 5.0, 5.0)]


def test_metrics_and_reports(spark):
    df = spark.createDataFrame(PREDS, "model_type string, split_index int, actual double, predicted double")
    metrics = evaluate.forecast_metrics(df)
    got = {(r["model_type"], r["split_index"]): r for r in metrics.collect()}
    first = got[("a", 0)]
    assert (first["rmse"], first["mae"], first["mape"], first["nrmse"], first["model_mape"]) == (1.5811, 1.5, 20.0, 0.3162, 60.0)
    assert (got[("b", 0)]["mape"], got[("b", 0)]["nrmse"]) == (0.0, 0.0)
    reports = {r["model_type"]: r for r in evaluate.stability_report(metrics).collect()}
    assert reports["b"]["per_split_rmse"] == [0.0, 5.0, 0.0]
    assert reports["b"]["std_rmse"] == pytest.approx(np.std([0, 5, 0]), abs=1e-4)
    assert reports["b"]["n_splits"] == 3


def test_improvements(spark):
    reports = spark.createDataFrame(
        [("baseline_ar", 10.0, 2.0), ("var_all_weather", 8.0, 1.0), ("granger_selected", 7.5, 0.5)],
        "model_type string, mean_rmse double, std_rmse double")
    drift = spark.createDataFrame([("baseline", 4.0), ("granger_selected", 5.0)], "model string, extreme_rmse double")
    got = evaluate.improvements(reports, drift).collect()[0].asDict()
    assert got == {"granger_vs_baseline_rmse_pct": 25.0, "granger_vs_baseline_stability_pct": 75.0,
                   "var_vs_baseline_rmse_pct": 20.0, "robustness_gain_pct": -25.0}


def test_holdout_models_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    from lagwise.plans import pipelines

    both = threading.Barrier(2)
    seen = {}

    def fit(train, test, columns=(), name="var_all_weather", settings=None):
        both.wait(timeout=20)
        seen[name] = list(columns)
        return None, None

    monkeypatch.setattr(models, "weather_model", fit)
    days = spark.sql("SELECT date_add(DATE'2024-01-01', i) AS date, 'a' AS region_id, 'n' AS need_type, i % 5 AS target_count, "
                     "(i + 3) % 5 AS target_lag_7, i % 7 AS day_of_week FROM (SELECT CAST(id AS INT) AS i FROM range(90))")
    predictions, gains = pipelines.fit_models(days, ["tmax_lag_1"])
    assert gains is None and {r[0] for r in predictions.select("model_type").distinct().collect()} == {"baseline_ar"}
    assert seen["granger_selected"] == ["tmax_lag_1"] and set(seen) == {"var_all_weather", "granger_selected"}
