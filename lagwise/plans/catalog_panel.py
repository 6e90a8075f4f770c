"""Checked queries: weather, needs, features, joins, alignment, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.functions import expressions as ex
from lagwise.operators import align, needs, quality, summary, weather
from lagwise.operators import features as fx
from lagwise.operators import windows as win
from lagwise.plans import bindings as b
from lagwise.plans import pipelines
from lagwise.plans.bindings import exact, stable, table, trailing, with_inputs
from lagwise.schemas import EVENT_FLAGS, WEATHER_VALUES
from lagwise.sources import tables

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- scans and tables -------------------------------------------------------------------

@query("s5_projected_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def s5(spark, sf):
    return tables.scan(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("s6_full_scan", "SELECT * FROM customer")
def s6(spark, sf):
    return tables.scan(spark, f"{sf}/customer.parquet")


_KEYED = """
SELECT c_custkey AS key, c_mktsegment AS segment, c_acctbal AS amount, 0 AS seq FROM customer
"""
_UPDATES = """
SELECT o_custkey AS key, o_orderpriority AS segment, o_totalprice AS amount, o_orderkey AS seq FROM orders
"""


def _keyed(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("amount"), F.lit(0).cast("long").alias("seq"))


def _updates(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("segment"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))


@query("s8_upsert", f"""
SELECT * FROM ({_KEYED} UNION ALL {_UPDATES})
QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
""")
def s8(spark, sf):
    return tables.merge_last(_keyed(spark, sf), _updates(spark, sf), ["key"], "seq")


@query("s9_insert_or_ignore", f"""
SELECT * FROM ({_KEYED}) UNION ALL
SELECT * FROM (SELECT * FROM (SELECT o_custkey + o_orderkey AS key, segment, amount, seq FROM
      (SELECT *, key AS o_custkey, seq AS o_orderkey FROM ({_UPDATES})))
      WHERE key NOT IN (SELECT key FROM ({_KEYED}))
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1)
""")
def s9(spark, sf):
    base = _keyed(spark, sf)
    new = _updates(spark, sf).withColumn("key", F.col("key") + F.col("seq"))
    return base.unionByName(tables.insert_new(base, new, ["key"], [F.col("seq")]))


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query("s13_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in _TABLES))
def s13(spark, sf):
    return tables.row_counts({t: table(spark, sf, t) for t in _TABLES})


# --- needs ------------------------------------------------------------------------------

@query("p1_required_fields", with_inputs("""
SELECT ref_id, ref_date, category FROM
  (SELECT ref_id, CASE WHEN ref_date = 'unknown' THEN '  ' ELSE ref_date END AS ref_date, category FROM referral_feed)
WHERE length(trim(ref_date)) > 0 AND length(trim(category)) > 0
""", "referral_feed"))
def p1(spark, sf):
    feed = b.referral_feed(spark, sf).withColumn(
        "ref_date", F.when(F.col("ref_date") == "unknown", "  ").otherwise(F.col("ref_date")))
    return needs.require_fields(feed).select("ref_id", "ref_date", "category")


@query("p2_trim_blank", with_inputs("""
SELECT ref_id, row_seq, nullif(trim(category), '') AS category, nullif(trim(CASE WHEN state = 'ASIA' THEN ' ' ELSE state END), '') AS state
FROM referral_feed
""", "referral_feed"))
def p2(spark, sf):
    blanked = F.when(F.col("state") == "ASIA", " ").otherwise(F.col("state"))
    return b.referral_feed(spark, sf).select(
        "ref_id", "row_seq", ex.blank_to_null(F.col("category")).alias("category"), ex.blank_to_null(blanked).alias("state"))


_NUMBER_TEXT = """CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS VARCHAR) || '.7'
            WHEN 'O' THEN 'n/a' ELSE '' END"""


@query("p3_tolerant_numbers", f"""
SELECT o_orderkey, TRY_CAST({_NUMBER_TEXT} AS DOUBLE) AS as_double,
       CAST(trunc(TRY_CAST({_NUMBER_TEXT} AS DOUBLE)) AS INTEGER) AS as_int FROM orders
""")
def p3(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderkey").cast("string"), F.lit(".7"))).when(
        F.col("o_orderstatus") == "O", "n/a").otherwise("")
    return table(spark, sf, "orders").select(
        "o_orderkey", ex.tolerant_double(text).alias("as_double"), ex.tolerant_int(text).alias("as_int"))


@query("p7_normalise_dates", with_inputs("SELECT ref_id, row_seq, date FROM needs_dated", "needs_dated"))
def p7(spark, sf):
    return needs.normalise_dates(b.referral_feed(spark, sf)).select("ref_id", "row_seq", "date")


_READABLE = f"o_orderkey % {len(b.WRITTEN_DATES)} < {len(b.WRITTEN_DATES) - 3}"


@query("p7_date_formats", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE {_READABLE}")
def p7_formats(spark, sf):
    return needs.normalise_dates(b.written_dates(spark, sf)).select("o_orderkey", "date")


@query("p7_rejected_dates", f"""
SELECT o_orderpriority AS source_file, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE NOT ({_READABLE})) AS n_rejected
FROM orders GROUP BY 1
""")
def p7_rejected(spark, sf):
    return needs.rejected_dates(b.written_dates(spark, sf))


@query("p8_standard_categories", with_inputs("""
SELECT CASE WHEN trim(category) = 'Other' THEN 'Other Assistance' ELSE trim(category) END AS category, COUNT(*) AS n
FROM referral_feed GROUP BY 1
""", "referral_feed"))
def p8(spark, sf):
    named = needs.standardise_categories(b.referral_feed(spark, sf))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("w8_deduplicate", with_inputs(
    "SELECT ref_id, need_id, source_file, category, need_status, row_seq FROM needs_unique", "needs_unique"))
def w8(spark, sf):
    named = needs.standardise_categories(needs.normalise_dates(b.referral_feed(spark, sf)))
    return needs.deduplicate(named).select("ref_id", "need_id", "source_file", "category", "need_status", "row_seq")


@query("w8_deduplicate_null_keys", with_inputs("""
SELECT * FROM (SELECT CASE WHEN need_status = 'Confirmed' THEN NULL ELSE ref_id END AS ref_id,
                      CASE WHEN need_status = 'Confirmed' THEN NULL ELSE need_id END AS need_id,
                      source_file, need_status, row_seq FROM referrals)
QUALIFY row_number() OVER (PARTITION BY ref_id, need_id, source_file ORDER BY row_seq) = 1
""", "referrals"))
def w8_null(spark, sf):
    open_case = F.col("need_status") != "Confirmed"
    anonymous = b.referrals(spark, sf).select(
        F.when(open_case, F.col("ref_id")).alias("ref_id"), F.when(open_case, F.col("need_id")).alias("need_id"),
        "source_file", "need_status", "row_seq")
    return needs.deduplicate(anonymous)


@query("p9_region_filter", with_inputs("""
SELECT ref_id, row_seq, state AS region_id FROM referral_feed WHERE state IS NOT NULL
""", "referral_feed"))
def p9(spark, sf):
    return needs.assign_region(b.referral_feed(spark, sf)).select("ref_id", "row_seq", "region_id")


@query("p10_status_flags", with_inputs("""
SELECT ref_id, row_seq, CASE WHEN need_status = 'Confirmed' THEN 1 ELSE 0 END AS is_confirmed,
       CASE WHEN need_status = 'Unmet' THEN 1 ELSE 0 END AS is_unmet FROM referral_feed
""", "referral_feed"))
def p10(spark, sf):
    return needs.status_flags(b.referral_feed(spark, sf)).select("ref_id", "row_seq", "is_confirmed", "is_unmet")


@query("a1_daily_rollup", with_inputs("SELECT * FROM needs_counts", "needs_counts"))
def a1(spark, sf):
    df = needs.standardise_categories(needs.normalise_dates(b.referral_feed(spark, sf)))
    return needs.daily_counts(needs.assign_region(needs.deduplicate(df)))


@query("w5_rolling_counts", with_inputs("SELECT * FROM needs_daily", "needs_daily"))
def w5(spark, sf):
    return b.needs_daily(spark, sf)


@query("w5_rolling_counts_by_calendar", with_inputs(f"""
SELECT date, region_id, need_type, {stable('AVG(daily_need_count) OVER w7', 2)} AS rolling_7d_count,
       {stable('AVG(daily_need_count) OVER w14', 2)} AS rolling_14d_count,
       {stable('AVG(daily_need_count) OVER w30', 2)} AS rolling_30d_count
FROM needs_counts
WINDOW w7 AS (PARTITION BY region_id, need_type ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
       w14 AS (PARTITION BY region_id, need_type ORDER BY date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY region_id, need_type ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)
""", "needs_counts"))
def w5_calendar(spark, sf):
    return needs.rolling_counts(a1(spark, sf), calendar=True).drop("daily_need_count", "confirmed_count", "unmet_count")


# --- weather ----------------------------------------------------------------------------

@query("w1_gap_fill", with_inputs(
    "SELECT date, region_id, tmax, tmin, tavg, prcp, snow, awnd FROM wx_filled", "wx_filled"))
def w1(spark, sf):
    return weather.fill_gaps(b.raw_weather(spark, sf))


def _interpolated(column: str) -> str:
    past = "OVER (PARTITION BY region_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    future = "OVER (PARTITION BY region_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    known = f"CASE WHEN {column} IS NOT NULL THEN date END"
    pv, nv = f"last_value({column} IGNORE NULLS) {past}", f"first_value({column} IGNORE NULLS) {future}"
    pd, nd = f"last_value({known} IGNORE NULLS) {past}", f"first_value({known} IGNORE NULLS) {future}"
    line = f"{pv} + ({nv} - {pv}) * (date_diff('day', {pd}, date)::DOUBLE / nullif(date_diff('day', {pd}, {nd}), 0))"
    return stable(f"""CASE WHEN {column} IS NOT NULL THEN {column}
        WHEN {pd} IS NOT NULL AND {nd} IS NOT NULL THEN {line} ELSE COALESCE({pv}, {nv}) END""", 6) + f" AS {column}"


_WEATHER_COLUMNS = ["tmax", "tmin", "tavg", "prcp", "snow", "awnd"]


@query("w1b_interpolate", with_inputs(
    f"SELECT date, region_id, {', '.join(map(_interpolated, _WEATHER_COLUMNS))} FROM raw_weather", "raw_weather"))
def w1b(spark, sf):
    filled = weather.interpolate_gaps(b.raw_weather(spark, sf), _WEATHER_COLUMNS)
    return filled.select("date", "region_id", *[ex.round_stable(F.col(c), 6).alias(c) for c in _WEATHER_COLUMNS])


@query("p21_missing_report", with_inputs(
    "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in WEATHER_VALUES) + " FROM raw_weather",
    "raw_weather"))
def p21(spark, sf):
    return weather.missing_report(b.raw_weather(spark, sf))


@query("a8_percentiles", f"""
SELECT event_type, {stable('quantile_cont(value, 0.01)', 6)} AS p01, {stable('quantile_cont(value, 0.05)', 6)} AS p05,
       {stable('quantile_cont(value, 0.95)', 6)} AS p95, {stable('quantile_cont(value, 0.99)', 6)} AS p99
FROM events GROUP BY event_type
""")
def a8(spark, sf):
    shares = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}
    out = weather.group_percentiles(table(spark, sf, "events"), ["event_type"], "value", shares)
    return out.select("event_type", *[ex.round_stable(F.col(n), 6).alias(n) for n in shares])


@query("a9_rain_threshold", with_inputs(f"""
SELECT region_id, {stable('COALESCE(quantile_cont(prcp, 0.95) FILTER (WHERE prcp > 0), 999)', 6)} AS threshold
FROM wx_filled GROUP BY region_id
""", "wx_filled"))
def a9(spark, sf):
    filled = weather.fill_gaps(b.raw_weather(spark, sf))
    return filled.groupBy("region_id").agg(ex.round_stable(weather.rain_threshold(), 6).alias("threshold"))


@query("p12_winsorise", with_inputs(
    "SELECT date, region_id, " + ", ".join(f"{stable(c, 6)} AS {c}" for c in WEATHER_VALUES[:3]) + " FROM wx_clipped",
    "wx_clipped"))
def p12(spark, sf):
    clipped = weather.winsorise(weather.fill_gaps(b.raw_weather(spark, sf)))
    return clipped.select("date", "region_id", *[ex.round_stable(F.col(c), 6).alias(c) for c in WEATHER_VALUES[:3]])


@query("w2_w3_event_flags", with_inputs(
    "SELECT date, region_id, heatwave_flag, coldwave_flag, heavy_rain_flag FROM wx_flagged", "wx_flagged"))
def w2(spark, sf):
    clipped = weather.winsorise(weather.fill_gaps(b.raw_weather(spark, sf)))
    return weather.flag_events(clipped).select("date", "region_id", *EVENT_FLAGS)


@query("w4_rolling_weather", with_inputs(
    "SELECT date, region_id, " + ", ".join(
        f"{stable(trailing(fn.upper(), c, k, 'region_id'), 2)} AS {n}"
        for n, (fn, c, k) in weather.ROLLING_WEATHER.items()) + " FROM wx_filled", "wx_filled"))
def w4(spark, sf):
    rolled = weather.rolling_weather(weather.fill_gaps(b.raw_weather(spark, sf)))
    return rolled.select("date", "region_id", *weather.ROLLING_WEATHER)


@query("p11_derived_weather", with_inputs(f"""
SELECT date, region_id, {exact('tavg', 2)} AS avg_temp, {exact('tmax', 2)} AS max_temp, {exact('tmin', 2)} AS min_temp,
       {exact('tmax - tmin', 2)} AS temp_range, {exact('prcp', 2)} AS precip, {exact('awnd', 2)} AS wind_speed
FROM wx_filled
""", "wx_filled"))
def p11(spark, sf):
    derived = weather.derived_columns(weather.fill_gaps(b.raw_weather(spark, sf)))
    return derived.select("date", "region_id", "avg_temp", "max_temp", "min_temp", "temp_range", "precip", "wind_speed")


@query("l1_clean_weather", with_inputs("SELECT * FROM weather_daily", "weather_daily"))
def l1(spark, sf):
    return b.weather_daily(spark, sf)


@query("l2_clean_needs", with_inputs("SELECT * FROM needs_daily", "needs_daily"))
def l2(spark, sf):
    return b.needs_daily(spark, sf)


# --- joins and alignment ----------------------------------------------------------------

@query("j1_join_weather", with_inputs("SELECT * FROM joined_panel", "joined_panel"))
def j1(spark, sf):
    return b.joined_panel(spark, sf)


@query("j2_event_flags", with_inputs("""
SELECT n.date, n.region_id, n.need_type, COALESCE(w.heatwave_flag, 0) AS heatwave_flag,
       COALESCE(w.coldwave_flag, 0) AS coldwave_flag, COALESCE(w.heavy_rain_flag, 0) AS heavy_rain_flag
FROM needs_counts n LEFT JOIN weather_daily w ON n.date = w.date AND n.region_id = w.region_id
""", "needs_counts", "weather_daily"))
def j2(spark, sf):
    cells = a1(spark, sf).select("date", "region_id", "need_type")
    return fx.add_event_features(cells, b.weather_daily(spark, sf)).select("date", "region_id", "need_type", *EVENT_FLAGS)


@query("j3_current_weather", with_inputs("""
SELECT f.date, f.region_id, f.need_type, f.target_count, w.max_temp, w.precip
FROM feature_matrix f LEFT JOIN weather_daily w ON f.date = w.date AND f.region_id = w.region_id
""", "feature_matrix"))
def j3(spark, sf):
    wx_panel = b.weather_daily(spark, sf)
    features = pipelines.build_features(wx_panel, b.needs_daily(spark, sf))
    return fx.with_current_weather(features, wx_panel).select(
        "date", "region_id", "need_type", "target_count", "max_temp", "precip")


@query("j5_matched_pairs", with_inputs("""
SELECT COUNT(*) AS matched_pairs FROM (
  SELECT DISTINCT n.date, n.region_id FROM needs_counts n JOIN raw_weather w ON n.date = w.date AND n.region_id = w.region_id)
""", "needs_counts", "raw_weather"))
def j5(spark, sf):
    return align.matched_pairs(a1(spark, sf), b.raw_weather(spark, sf))


@query("j6_unmatched_cells", with_inputs("""
SELECT n.* FROM needs_counts n
WHERE NOT EXISTS (SELECT 1 FROM raw_weather w WHERE w.date = n.date AND w.region_id = n.region_id)
""", "needs_counts", "raw_weather"))
def j6(spark, sf):
    return align.unmatched_rows(a1(spark, sf), b.raw_weather(spark, sf), ["date", "region_id"])


@query("j7_rolling_experiments", with_inputs("""
SELECT m.experiment_id, COUNT(*) AS split_count FROM metrics m JOIN experiments e ON m.experiment_id = e.experiment_id
WHERE e.model_type LIKE 'rolling_%' GROUP BY m.experiment_id
""", "metrics", "experiments"))
def j7(spark, sf):
    return summary.splits_per_experiment(b.metrics(spark, sf), b.experiments(spark, sf), "rolling_%")


@query("u1_shared_dates", with_inputs(
    "SELECT date FROM referrals_d INTERSECT SELECT date FROM raw_weather", "raw_weather", "referrals",
    referrals_d="SELECT ref_date AS date FROM referrals"))
def u1(spark, sf):
    return align.shared_keys(
        b.referrals(spark, sf).withColumnRenamed("ref_date", "date"), b.raw_weather(spark, sf), ["date"])


@query("u2_missing_dates", with_inputs(
    "SELECT date FROM raw_weather EXCEPT SELECT ref_date AS date FROM referrals", "raw_weather", "referrals"))
def u2(spark, sf):
    return align.missing_keys(
        b.raw_weather(spark, sf), b.referrals(spark, sf).withColumnRenamed("ref_date", "date"), ["date"])


@query("u3_union_of_feeds", """
SELECT o_orderkey AS key, 'orders' AS source_file, o_orderpriority AS label FROM orders
UNION ALL SELECT l_orderkey, 'lineitem', NULL FROM lineitem
""")
def u3(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.lit("orders").alias("source_file"), F.col("o_orderpriority").alias("label"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("lineitem").alias("source_file"))
    return orders.unionByName(lines, allowMissingColumns=True)


ALIGNMENT = f"""
SELECT (SELECT COUNT(DISTINCT region_id) FROM needs_counts) AS social_needs_states,
       (SELECT COUNT(DISTINCT region_id) FROM weather_side) AS weather_states,
       (SELECT COUNT(*) FROM (SELECT region_id FROM needs_counts INTERSECT SELECT region_id FROM weather_side)) AS matched_states,
       COALESCE((SELECT string_agg(region_id, ',' ORDER BY region_id) FROM
          (SELECT region_id FROM needs_counts EXCEPT SELECT region_id FROM weather_side)), '') AS missing_weather_states,
       (SELECT COUNT(DISTINCT date) FROM needs_counts) AS social_needs_dates,
       (SELECT COUNT(DISTINCT date) FROM weather_side) AS weather_dates,
       (SELECT COUNT(*) FROM (SELECT date FROM needs_counts INTERSECT SELECT date FROM weather_side)) AS overlapping_dates,
       pairs AS social_needs_pairs, matched AS matched_pairs, {stable('matched::DOUBLE / greatest(pairs, 1) * 100', 1)} AS coverage_pct
FROM (SELECT COUNT(*) AS pairs, COUNT(*) FILTER (WHERE hit) AS matched FROM (
        SELECT DISTINCT n.date, n.region_id, EXISTS (SELECT 1 FROM weather_side w WHERE w.date = n.date AND w.region_id = n.region_id) AS hit
        FROM needs_counts n))
"""


@query("v1_alignment_report", with_inputs(
    ALIGNMENT, "needs_counts", "raw_weather",
    weather_side="SELECT date, CASE region_id WHEN 'ASIA' THEN 'OCEANIA' ELSE region_id END AS region_id FROM raw_weather"))
def v1(spark, sf):
    # One region's weather comes under another name, so that both sides have regions of their own.
    side = b.raw_weather(spark, sf).replace("ASIA", "OCEANIA", "region_id")
    report = align.alignment_report(a1(spark, sf), side)
    return report.withColumn("missing_weather_states", F.array_join("missing_weather_states", ","))


# --- features ---------------------------------------------------------------------------

@query("w6_lag_features", with_inputs("SELECT date, region_id, need_type, " + ", ".join(
    [f"tmax_lag_{k}, prcp_lag_{k}" for k in (1, 3, 7, 14, 30)] + ["target_lag_1, target_lag_7"]) + " FROM lagged_panel",
    "lagged_panel"))
def w6(spark, sf):
    lagged = fx.add_lag_features(b.joined_panel(spark, sf))
    return lagged.select("date", "region_id", "need_type", *[c for c in lagged.columns if "_lag_" in c])


_CALENDAR_LAGS = {f"{p}_lag_{k}": (c, k) for p, c, ks in (
    ("tmax", "max_temp", (1, 3, 7, 14, 30)), ("prcp", "precip", (1, 3, 7, 14, 30)), ("target", "target_count", (1, 7))) for k in ks}


@query("w6_lag_features_by_calendar", with_inputs(
    "SELECT n.date, n.region_id, n.need_type, " + ", ".join(f"p{k}.{c} AS {name}" for name, (c, k) in _CALENDAR_LAGS.items())
    + " FROM joined_panel n " + " ".join(
        f"LEFT JOIN joined_panel p{k} ON p{k}.date = n.date - {k} AND p{k}.region_id = n.region_id AND p{k}.need_type = n.need_type"
        for k in (1, 3, 7, 14, 30)), "joined_panel"))
def w6_calendar(spark, sf):
    lagged = fx.add_lag_features(b.joined_panel(spark, sf), calendar=True)
    return lagged.select("date", "region_id", "need_type", *_CALENDAR_LAGS)


@query("w7_rolling_features", with_inputs("""
SELECT date, region_id, need_type, temp_rollmean_7, temp_rollmean_14, precip_rollsum_7, precip_rollsum_30,
       target_rollmean_7, target_rollmean_14 FROM rolled_panel
""", "rolled_panel"))
def w7(spark, sf):
    rolled = fx.add_rolling_features(b.joined_panel(spark, sf))
    return rolled.select("date", "region_id", "need_type", *fx.WEATHER_ROLLING, *fx.TARGET_ROLLING)


@query("w7_rolling_features_strict", with_inputs(f"""
SELECT date, region_id, need_type, {stable('AVG(target_count) OVER w7', 2)} AS target_rollmean_7,
       {stable('AVG(target_count) OVER w14', 2)} AS target_rollmean_14
FROM joined_panel
WINDOW w7 AS (PARTITION BY region_id, need_type ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS (PARTITION BY region_id, need_type ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)
""", "joined_panel"))
def w7_strict(spark, sf):
    rolled = fx.add_rolling_features(b.joined_panel(spark, sf), strict=True)
    return rolled.select("date", "region_id", "need_type", *fx.TARGET_ROLLING)


@query("w9_first_difference", with_inputs("""
SELECT date, region_id, need_type,
       target_count - lag(target_count) OVER (PARTITION BY region_id, need_type ORDER BY date) AS change FROM joined_panel
""", "joined_panel"))
def w9(spark, sf):
    diffed = win.first_difference(b.joined_panel(spark, sf), "target_count", "change", needs.SERIES)
    return diffed.select("date", "region_id", "need_type", "change")


@query("c1_c4_calendar", f"""
SELECT o_orderkey, {b.CALENDAR_SQL}
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)
""")
def c1(spark, sf):
    dated = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return fx.add_calendar_features(dated).drop("date")


@query("c4_holiday_table", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 25 THEN 1 ELSE 0 END AS holiday_flag FROM orders
""")
def c4(spark, sf):
    dated = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    christmas = dated.filter((F.month("date") == 12) & (F.dayofmonth("date") == 25)).select("date")
    return fx.add_calendar_features(dated, christmas).select("o_orderkey", "holiday_flag")


@query("p13_interactions", with_inputs(f"""
SELECT date, region_id, need_type, {stable('temp_rollmean_7 * precip_rollsum_7', 4)} AS temp_precip_interact,
       {stable('temp_rollmean_7 * target_rollmean_7', 4)} AS temp_target_interact,
       {stable('max_temp - tmax_lag_7', 4)} AS temp_trend_7d FROM rolled_panel
""", "rolled_panel"))
def p13(spark, sf):
    df = fx.add_rolling_features(fx.add_lag_features(b.joined_panel(spark, sf)))
    names = ["temp_precip_interact", "temp_target_interact", "temp_trend_7d"]
    return fx.add_interactions(df).select(
        "date", "region_id", "need_type", *[ex.round_stable(F.col(c), 4).alias(c) for c in names])


@query("p14_complete_lags", with_inputs("""
SELECT date, region_id, need_type, target_count FROM lagged_panel
WHERE tmax_lag_30 IS NOT NULL AND prcp_lag_30 IS NOT NULL AND target_lag_7 IS NOT NULL
""", "lagged_panel"))
def p14(spark, sf):
    complete = fx.drop_incomplete_lags(fx.add_lag_features(b.joined_panel(spark, sf)))
    return complete.select("date", "region_id", "need_type", "target_count")


_DERIVED = ["temp_precip_interact", "temp_target_interact", "temp_trend_7d"]
_FEATURES = "SELECT * REPLACE (" + ", ".join(f"{stable(c, 4)} AS {c}" for c in _DERIVED) + ") FROM feature_matrix"


@query("l4_build_features", with_inputs(_FEATURES, "feature_matrix"))
def l4(spark, sf):
    return b.feature_matrix(spark, sf).withColumns({c: ex.round_stable(F.col(c), 4) for c in _DERIVED})


@query("p15_final_projection", with_inputs("""
SELECT strftime(date, '%Y-%m-%d') AS date, region_id, need_type, CAST(target_count AS INTEGER) AS target_count,
       heatwave_flag, coldwave_flag, heavy_rain_flag FROM joined_panel
""", "joined_panel"))
def p15(spark, sf):
    return fx.select_features(b.joined_panel(spark, sf), text_dates=True)


# --- data quality -----------------------------------------------------------------------

@query("d1_duplicate_keys", with_inputs("""
SELECT ref_id, need_id, source_file, COUNT(*) AS n FROM referral_feed GROUP BY ALL HAVING COUNT(*) > 1
""", "referral_feed"))
def d1(spark, sf):
    return quality.duplicate_keys(b.referral_feed(spark, sf), needs.DEDUP_KEY)


@query("d2_rule_violations", with_inputs("""
SELECT 'tmax_missing' AS rule, COUNT(*) FILTER (WHERE tmax IS NULL) AS violations FROM raw_weather
UNION ALL SELECT 'tmax_below_tmin', COUNT(*) FILTER (WHERE tmax < tmin) FROM raw_weather
UNION ALL SELECT 'prcp_negative', COUNT(*) FILTER (WHERE prcp < 0) FROM raw_weather
UNION ALL SELECT 'tmax_out_of_range', COUNT(*) FILTER (WHERE tmax < 2 OR tmax > 49) FROM raw_weather
UNION ALL SELECT 'snow_when_warm', COUNT(*) FILTER (WHERE snow > 0 AND tmin > 40) FROM raw_weather
""", "raw_weather"))
def d2(spark, sf):
    return quality.rule_violations(b.raw_weather(spark, sf), {
        "tmax_missing": quality.missing("tmax"),
        "tmax_below_tmin": F.col("tmax") < F.col("tmin"),
        "prcp_negative": F.col("prcp") < 0,
        "tmax_out_of_range": quality.outside("tmax", 2, 49),
        "snow_when_warm": (F.col("snow") > 0) & (F.col("tmin") > 40),
    })


@query("d3_orphans", """
SELECT COUNT(*) AS orphans FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def d3(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return quality.orphan_count(table(spark, sf, "customer"), orders, "c_custkey")


@query("d4_unexpected_values", """
SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
""")
def d4(spark, sf):
    return quality.unexpected_values(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
