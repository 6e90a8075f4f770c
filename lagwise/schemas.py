"""Table schemas and the fixed value sets of the panel model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(required: dict, optional: dict) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in optional.items()])


# Column names of the stored tables and of the referral feed.
WEATHER_VALUES = ["tmax", "tmin", "tavg", "prcp", "snow", "awnd"]
EVENT_FLAGS = ["heatwave_flag", "coldwave_flag", "heavy_rain_flag"]
WEATHER_LAGS = [1, 3, 7, 14, 30]
TARGET_LAGS = [1, 7]

REFERRAL_TEXT = {
    "REF_ID": "ref_id",
    "REF_STATUS": "ref_status",
    "GENDER": "gender",
    "AGE_GROUP": "age_group",
    "LANGUAGE": "language",
    "REF_TYPE": "ref_type",
    "LOB": "lob",
    "COHORT": "cohort",
    "CATEGORY_ID": "category_id",
    "NEED_ID": "need_id",
    "SUBCATEGORY": "subcategory",
    "TERM_NEED": "term_need",
    "NEED_SOURCE": "need_source",
    "NEED_STATUS": "need_status",
    "NEED_CREATED_DATE": "need_created_date",
    "CONFIRMATION_DATE": "confirmation_date",
    "PROGRAM_ID": "program_id",
    "PROGRAM": "program",
    "PROGRAM_STATUS": "program_status",
    "PROGRAM_CREATED_DATE": "program_created_date",
}
REFERRAL_OTHER = [
    "REF_CODE", "REF_CODE_x", "REF_DATE", "ZIPCODE", "STATE", "CATEGORY",
    "Age", "RISK_SCORE", "DAYS_TO_CONFIRM",
]

WEATHER_DAILY = _schema(
    {"date": T.DateType(), "region_id": _S},
    {
        **{c: _D for c in ["avg_temp", "max_temp", "min_temp", "temp_range", "precip", "snow", "wind_speed"]},
        **{c: _I for c in EVENT_FLAGS},
        **{c: _D for c in ["rolling_7d_temp", "rolling_14d_temp", "rolling_7d_precip", "rolling_30d_precip"]},
    },
)
NEEDS_DAILY = _schema(
    {"date": T.DateType(), "region_id": _S, "need_type": _S, "daily_need_count": _L},
    {
        "confirmed_count": _L, "unmet_count": _L,
        "rolling_7d_count": _D, "rolling_14d_count": _D, "rolling_30d_count": _D,
    },
)

# The feature matrix, in output order.
FEATURE_COLUMNS = [
    "date", "region_id", "need_type", "target_count",
    *[f"tmax_lag_{k}" for k in WEATHER_LAGS],
    *[f"prcp_lag_{k}" for k in WEATHER_LAGS],
    "temp_rollmean_7", "temp_rollmean_14", "precip_rollsum_7", "precip_rollsum_30",
    "temp_precip_interact", "temp_target_interact", "temp_trend_7d",
    "target_lag_1", "target_lag_7", "target_rollmean_7", "target_rollmean_14",
    *EVENT_FLAGS,
    "day_of_week", "month", "season", "holiday_flag", "is_weekend",
]
FEATURE_INTS = [
    "target_count", "target_lag_1", "target_lag_7", *EVENT_FLAGS,
    "day_of_week", "month", "holiday_flag", "is_weekend",
]
BASELINE_FEATURES = ["target_lag_7", "day_of_week", "month", "is_weekend"]
BASE_FEATURES = [
    "target_lag_1", "target_lag_7", "target_rollmean_7", "target_rollmean_14",
    "day_of_week", "month", "is_weekend",
]
ALL_WEATHER_FEATURES = [
    *[f"tmax_lag_{k}" for k in WEATHER_LAGS],
    *[f"prcp_lag_{k}" for k in WEATHER_LAGS],
    "temp_rollmean_7", "temp_rollmean_14", "precip_rollsum_7", "precip_rollsum_30",
    "temp_precip_interact", "temp_target_interact", "temp_trend_7d",
    *EVENT_FLAGS,
]
ALWAYS_SELECTED = [
    "temp_rollmean_7", "precip_rollsum_7", *EVENT_FLAGS,
    "temp_precip_interact", "temp_target_interact", "temp_trend_7d",
]

EXPERIMENTS = _schema(
    {"experiment_id": _S, "model_type": _S, "target": _S},
    {
        "region_scope": _S, "train_start": T.DateType(), "train_end": T.DateType(),
        "test_start": T.DateType(), "test_end": T.DateType(), "params_json": _S, "description": _S,
    },
)
METRICS = _schema(
    {"experiment_id": _S},
    {"split_index": _I, **{c: _D for c in ["rmse", "mae", "mape", "nrmse", "stability_score", "forecast_error", "variance"]}},
)
CAUSAL_RESULTS = _schema(
    {"experiment_id": _S, "feature_name": _S, "lag": _I},
    {"p_value": _D, "f_statistic": _D, "effect_strength": _D, "significant_flag": _I, "need_type": _S, "region_id": _S},
)
