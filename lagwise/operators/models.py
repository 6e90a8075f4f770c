"""Forecast models: hold-out split, least squares, boosted trees, drift analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.expressions import complete, round_half_even, round_stable
from lagwise.operators.boosting import fit_splits
from lagwise.operators.gram import column_shift, gather_moments, least_squares, linear_prediction, moment_sums
from lagwise.schemas import ALL_WEATHER_FEATURES, BASE_FEATURES, BASELINE_FEATURES, EVENT_FLAGS

TARGET = "target_count"
# Model settings and the least numbers of rows.
HOLDOUT_DAYS = 30
TREES = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "seed": 42}
DRIFT_TREES = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
MIN_TRAIN, MIN_TEST = 10, 3
SEASON_STEPS = [("winter", "spring"), ("spring", "summer")]
RIDGE_ALPHA = 1.0


def holdout(df: DataFrame, days: int = HOLDOUT_DAYS) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: test starts `days` before the last date."""
    start = F.date_sub(df.agg(F.max("date")).scalar(), days)
    return df.filter(F.col("date") < start), df.filter(F.col("date") >= start)


def available(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def clamp(prediction: Column) -> Column:
    """Counts cannot be negative."""
    return F.greatest(prediction, F.lit(0.0))


def fit_linear(train: DataFrame, columns: Sequence[str], alpha: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row (keys, coefficients, n_train) per group, from sums of products."""
    if not keys:
        train, keys = train.withColumn("_all", F.lit(0)), ["_all"]
    shift = column_shift(train, [TARGET, *columns])
    gathered = gather_moments(moment_sums(train, keys, [TARGET, *columns], shift), keys)
    return gathered.select(
        *keys, least_squares(F.col("moments"), alpha, shift).alias("coefficients"),
        F.col("moments")[0].cast("long").alias("n_train"),
    )


def prediction_rows(scored: DataFrame, model: str | Column, prediction: Column, split: Column, n_train: Column) -> DataFrame:
    return scored.select(
        (F.lit(model) if isinstance(model, str) else model).alias("model_type"), split.cast("int").alias("split_index"), "date", "region_id", "need_type",
        F.col(TARGET).cast("double").alias("actual"), clamp(prediction).alias("predicted"),
        n_train.cast("long").alias("n_train"),
    )


def baseline(train: DataFrame, test: DataFrame, columns: Sequence[str] = tuple(BASELINE_FEATURES),
             model: str = "baseline_ar") -> DataFrame:
    """Least squares on the week-old target and the calendar; predictions for the test rows.

    The coefficients are one row and enter the test scan as a scalar subquery.
    """
    columns = available(train, columns)
    fitted = fit_linear(train, columns).filter(F.col("n_train") >= MIN_TRAIN)
    scored = test.filter(complete([*columns, TARGET])).withColumn(
        "_fit", fitted.select(F.struct("coefficients", "n_train")).scalar()).filter(F.col("_fit").isNotNull())
    fit = F.col("_fit")
    return prediction_rows(scored, model, linear_prediction(fit["coefficients"], columns), F.lit(0), fit["n_train"])


def fit_trees(train: DataFrame, columns: Sequence[str], settings: dict | None = None) -> GBTRegressionModel:
    """Boosted regression trees on complete rows."""
    rows = train.filter(complete([*columns, TARGET]))
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    labelled = assembled.select("features", F.col(TARGET).cast("double").alias("label"))
    return GBTRegressor(featuresCol="features", labelCol="label", **(settings or TREES)).fit(labelled)


def tree_predictions(model: GBTRegressionModel, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    whole = rows.filter(complete([*columns, TARGET]))
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(whole)
    return model.transform(assembled).drop("features")


def weather_model(train: DataFrame, test: DataFrame, weather_features: Sequence[str] = tuple(ALL_WEATHER_FEATURES),
                  model: str = "var_all_weather", settings: dict | None = None, split: int = 0
                  ) -> tuple[DataFrame | None, DataFrame | None]:
    """Trees on the base and weather features: (predictions, gain importances).

    (None, None) when there are too few complete rows. The columns are taken in a fixed order,
    so equal inputs give equal trees.
    """
    columns = available(train, list(dict.fromkeys([*BASE_FEATURES, *weather_features])))
    whole = complete([*columns, TARGET])
    sides = train.filter(whole).select(F.lit(True).alias("t")).unionByName(test.filter(whole).select(F.lit(False).alias("t")))
    n_train, n_test = sides.agg(F.count_if("t"), F.count_if(~F.col("t"))).first()
    if n_train < MIN_TRAIN or n_test < MIN_TEST:
        return None, None
    fitted = fit_trees(train, columns, settings)
    scored = tree_predictions(fitted, test, columns)
    predictions = prediction_rows(scored, model, F.col("prediction"), F.lit(split), F.lit(n_train))
    gains = [(model, c, float(g)) for c, g in zip(columns, fitted.featureImportances.toArray())]
    importances = train.sparkSession.createDataFrame(gains, "model_type string, feature string, importance double")
    return predictions, importances.withColumn("importance", round_half_even(F.col("importance"), 4))


def seasonal_drift(df: DataFrame, columns: Sequence[str] = (*BASE_FEATURES, *ALL_WEATHER_FEATURES)) -> DataFrame:
    """Ridge fitted on one season and scored on the next; rows per transition.

    All seasons' sums come from one pass. The fits are joined to the scored rows by season, and
    there are two of them.
    """
    columns = available(df, columns)
    seasonal = df.filter(complete([*columns, TARGET]))
    fits = fit_linear(seasonal, columns, RIDGE_ALPHA, keys=["season"]).withColumnRenamed("season", "train_season")
    step = F.lit(None).cast("string")
    for before, after in SEASON_STEPS:
        step = F.when(F.col("train_season") == before, after).otherwise(step)
    fits = fits.withColumn("season", step).filter("season IS NOT NULL AND n_train >= 10")
    scored = seasonal.join(F.broadcast(fits), "season")
    error = F.col(TARGET) - clamp(linear_prediction(F.col("coefficients"), columns))
    return scored.groupBy("train_season", F.col("season").alias("test_season")).agg(
        round_stable(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        round_stable(F.avg(F.abs(error)), 4).alias("mae"),
        F.first("n_train").alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
    ).filter("n_test >= 5")


def with_position(df: DataFrame, levels: Sequence[str], output: str = "position") -> DataFrame:
    """1-based place of each row in the order of `levels`, without sorting all rows in one task.

    Counts per first level are added up over that level, counts per second level within the
    first, and so on; only the last level is numbered row by row, inside its parent. No window
    is longer than the number of values of one level.
    """
    placed = df
    offset = F.lit(0)
    for depth in range(1, len(levels)):
        group, parent = list(levels[:depth]), list(levels[: depth - 1])
        counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*parent).orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select(*group, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(f"_before{depth}"))
        placed = placed.join(before, group)
        offset = offset + F.col(f"_before{depth}")
    inner = Window.partitionBy(*levels[:-1]).orderBy(levels[-1])
    placed = placed.withColumn(output, offset + F.row_number().over(inner))
    return placed.drop(*[f"_before{d}" for d in range(1, len(levels))])


EXTREME = "heatwave_flag = 1 OR coldwave_flag = 1 OR heavy_rain_flag = 1"
EXTREME_SCHEMA = (
    "normal_rmse double, extreme_rmse double, relative_increase_pct double, n_normal_test long, n_extreme long"
)


def extreme_split(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("date", "region_id", "need_type"),
                  share: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, normal test, extreme) rows; train is the first share of the normal rows in order."""
    whole = df.filter(complete([*columns, TARGET]))
    normal = whole.filter(f"NOT ({EXTREME})")
    cut = F.floor(normal.agg(F.count(F.lit(1))).scalar() * F.lit(share))
    placed = with_position(normal, order)
    return (
        placed.filter(F.col("position") <= cut).drop("position"),
        placed.filter(F.col("position") > cut).drop("position"),
        whole.filter(EXTREME),
    )


def extreme_weather(df: DataFrame, columns: Sequence[str] = (*BASE_FEATURES, *ALL_WEATHER_FEATURES),
                    settings: dict | None = None) -> DataFrame:
    """One row: error on normal and on extreme days of trees fitted on normal days.

    All values are NULL with fewer than 50 normal or 10 extreme rows.
    """
    columns = available(df, columns)
    empty = df.sparkSession.createDataFrame([(None,) * 5], EXTREME_SCHEMA)
    if any(c not in df.columns for c in EVENT_FLAGS[:2]):
        return empty
    kind = F.when(F.expr(EXTREME), "extreme").otherwise("normal").alias("kind")
    sizes = {r["kind"]: r["count"] for r in df.filter(complete([*columns, TARGET])).groupBy(kind).count().collect()}
    if sizes.get("normal", 0) < 50 or sizes.get("extreme", 0) < 10:
        return empty
    train, normal_test, extreme = extreme_split(df, columns)
    # Window 0 is what is scored, by trees fitted to what stands before it.
    parts = [
        rows.select(F.lit(window).alias("split_index"), F.lit(kind).alias("kind"), TARGET, *columns)
        for rows, window, kind in ((train, -1, "train"), (normal_test, 0, "normal"), (extreme, 0, "extreme"))
    ]
    both = fit_splits(
        parts[0].unionByName(parts[1]).unionByName(parts[2]), [0], {"trees": columns}, TARGET, settings or DRIFT_TREES,
        lambda rows, model, prediction, split, n: rows.select("kind", (F.col(TARGET) - clamp(prediction)).alias("error")),
        min_train=1, min_test=1, keys=["kind"],
    )

    def rmse(name: str) -> Column:
        return F.sqrt(F.avg(F.when(F.col("kind") == name, F.col("error") * F.col("error"))))

    out = both.agg(
        rmse("normal").alias("n"), rmse("extreme").alias("e"),
        F.count_if(F.col("kind") == "normal").alias("n_normal_test"),
        F.count_if(F.col("kind") == "extreme").alias("n_extreme"),
    )
    growth = (F.col("e") - F.col("n")) / F.greatest(F.col("n"), F.lit(1e-6)) * 100
    return out.select(
        round_stable(F.col("n"), 4).alias("normal_rmse"), round_stable(F.col("e"), 4).alias("extreme_rmse"),
        round_stable(growth, 2).alias("relative_increase_pct"), "n_normal_test", "n_extreme",
    )
