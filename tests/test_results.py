"""Stored experiments: seen whole or not at all, replaced by a repeated run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lagwise.plans import bindings as b
from lagwise.plans import pipelines
from lagwise.sources import results, tables

SF = "/root/testdata/sf0.01"
SMALL = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3, "seed": 1}
HEADER = "experiment_id string, model_type string, params_json string"
ROW = "experiment_id string, split_index int, rmse double"


def names(folder):
    return sorted(n for n in os.listdir(folder) if "=" in n)


def test_rows_without_header_are_unseen(spark, tmp_path):
    root = str(tmp_path)
    assert results.experiments(spark, root).count() == results.results(spark, root, "metrics").count() == 0
    results.write_rows(root, "metrics", spark.createDataFrame([("a", 0, 1.0)], ROW), "x")
    assert results.results(spark, root, "metrics").count() == 0


def test_a_repeated_run_replaces_the_former(spark, tmp_path):
    root = str(tmp_path)
    odd = "a/b c=1%"
    for value in (1.0, 2.0):
        headers = spark.createDataFrame([(odd, f"m{value}", "{}"), ("b", "m", None)], HEADER)
        rows = spark.createDataFrame([(odd, 0, value), (odd, 1, value), ("b", 0, value)], ROW)
        results.store_experiments(spark, root, headers, {"metrics": rows})
        results.write_rows(root, "metrics", rows, "unfinished")
    results.store_experiments(spark, root, spark.createDataFrame([("c", "m", None)], HEADER), {"metrics": spark.createDataFrame([("c", 0, 9.0)], ROW)})
    got = sorted((r["experiment_id"], r["split_index"], r["rmse"]) for r in results.results(spark, root, "metrics").collect())
    assert got == [(odd, 0, 2.0), (odd, 1, 2.0), ("b", 0, 2.0), ("c", 0, 9.0)]
    heads = {r["experiment_id"]: r for r in results.experiments(spark, root).collect()}
    assert set(heads) == {odd, "b", "c"} and heads[odd]["model_type"] == "m2.0" and heads["b"]["target"] is None
    # What the first attempt and the unfinished ones before the last commit left is gone.
    for folder in names(f"{root}/metrics"):
        assert len(names(f"{root}/metrics/{folder}")) <= 2


@pytest.fixture(scope="module")
def panel(spark):
    from lagwise.session import cut_lineage

    return cut_lineage(b.feature_matrix(spark, SF)), cut_lineage(b.weather_daily(spark, SF))


def test_a_stored_run(spark, panel, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        compared = {r["model_type"]: r for r in pipelines.stored_run(root, *panel, "run", SMALL).collect()}
    heads = {r["experiment_id"]: r for r in results.experiments(spark, root).collect()}
    assert set(heads) == {"run-causal", *(f"run-{m}" for m in compared)}
    metrics = {r["experiment_id"]: r for r in results.results(spark, root, "metrics").collect()}
    for model, row in compared.items():
        assert (metrics[f"run-{model}"]["rmse"], metrics[f"run-{model}"]["mae"]) == (row["rmse"], row["mae"])
        assert heads[f"run-{model}"]["train_end"] < heads[f"run-{model}"]["test_start"]
    gains = json.loads(heads["run-var_all_weather"]["params_json"])
    assert len(gains) > 20 and abs(sum(gains.values()) - 1) < 0.01 and heads["run-baseline_ar"]["params_json"] == "{}"
    causes = pipelines.causal_report(*panel)
    assert results.results(spark, root, "causal_results").count() == causes.count() > 0


def test_a_stored_evaluation(spark, panel, tmp_path):
    root = str(tmp_path)
    found = pipelines.stored_evaluation(
        root, panel[0], ["tmax_lag_3"], "run", settings=SMALL, drift_settings=SMALL, test_days=120).collect()[0]
    reports = {r["model_type"]: r for r in found["stability_reports"]}
    heads = {r["experiment_id"]: r for r in results.experiments(spark, root).collect()}
    assert set(heads) == {f"run-{m}" for m in reports} == {"run-baseline_ar", "run-var_all_weather", "run-granger_selected"}
    for model, report in reports.items():
        rows = results.results(spark, root, "metrics").filter(F.col("experiment_id") == f"run-{model}").orderBy("split_index").collect()
        assert [r["rmse"] for r in rows] == report["per_split_rmse"] and {r["mae"] for r in rows} == {report["mean_mae"]}
        assert json.loads(heads[f"run-{model}"]["params_json"])["mean_rmse"] == report["mean_rmse"]
    again = tables.read_summary(spark, f"{root}/summaries/run", spark.createDataFrame([found]).schema).collect()[0]
    assert {r["model_type"] for r in again["stability_reports"]} == set(reports) and len(again["extreme_weather_drift"]) == 2
