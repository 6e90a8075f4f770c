"""Panel inputs drawn from the star-schema test tables, in Spark and as SQL common table expressions.

The tables hold no weather and no referrals. Orders stand in for referral records, line items
for weather readings, test results and forecasts; every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.features import join_weather
from lagwise.plans import pipelines
from lagwise.session import cut_lineage

LATE = 10**12


_schemas: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once and reused, which saves a job per read."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "Confirmed").when(F.col("o_orderstatus") == "O", "Unmet")
    category = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Other").otherwise(F.col("o_orderpriority"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("ref_id"),
            F.col("o_custkey").cast("string").alias("need_id"),
            F.lit("orders").alias("source_file"),
            F.col("o_orderdate").cast("date").alias("ref_date"),
            F.col("r_name").alias("state"),
            category.alias("category"),
            status.otherwise("InProcess").alias("need_status"),
            F.col("o_orderkey").alias("row_seq"),
        )
    )


def referral_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a feed would deliver them, with what cleaning has to remove.

    Confirmed records come a second time with a padded category and another status; records
    in process come again with an unreadable date; one region's come again without a state.
    """
    text = F.date_format("ref_date", "yyyy-MM-dd")

    def variant(**changes):
        base = {
            "ref_id": F.col("ref_id"), "need_id": F.col("need_id"), "source_file": F.col("source_file"),
            "ref_date": text, "state": F.col("state"), "category": F.col("category"),
            "need_status": F.col("need_status"), "row_seq": F.col("row_seq"),
        }
        return F.struct(*[c.alias(n) for n, c in (base | changes).items()])

    late = F.col("row_seq") + F.lit(LATE)
    again = variant(
        ref_date=F.concat(text, F.lit(" 08:30:00")), category=F.concat(F.lit(" "), F.col("category"), F.lit(" ")),
        need_status=F.lit("Unmet"), row_seq=late,
    )
    undated = variant(ref_id=F.concat(F.lit("u"), F.col("ref_id")), ref_date=F.lit("unknown"), row_seq=late)
    stateless = variant(ref_id=F.concat(F.lit("s"), F.col("ref_id")), state=F.lit(None).cast("string"), row_seq=late)
    rows = F.array_compact(F.array(
        variant(),
        F.when(F.col("need_status") == "Confirmed", again),
        F.when(F.col("need_status") == "InProcess", undated),
        F.when(F.col("state") == "AFRICA", stateless),
    ))
    return referrals(spark, sf_dir).select(F.inline(rows))


# The ways in which feeds write a date; the last three have no readable one.
WRITTEN_DATES = [
    "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "M/d/yyyy", "MM/dd/yyyy HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a", "M-d-yyyy", "yyyy/M/d", "yyyy/MM/dd H:mm", "yyyy/M/d H:mm:ss", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy", "M/d/yy", "HH:mm", "'soon'", "MM/32/yyyy",
]


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order; its key decides how the date, with a time of day, is written."""
    orders = table(spark, sf_dir, "orders")
    minute = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=F.col("o_orderkey") % 1440)
    way = F.col("o_orderkey") % len(WRITTEN_DATES)
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(WRITTEN_DATES):
        text = F.when(way == i, F.date_format(minute, pattern)).otherwise(text)
    return orders.select("o_orderkey", F.col("o_orderpriority").alias("source_file"), text.alias("ref_date"))


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per (ship date, region); sums run over whole hundredths and so are exact."""
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")

    def hundredths(c: str):
        return F.round(F.col(c) * 100).cast("long")

    kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    return (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("r_name").alias("region_id"))
        .agg(
            F.max(kept).alias("tmax"),
            F.min(kept).alias("tmin"),
            F.avg(kept).alias("tavg"),
            (F.sum(F.greatest(hundredths("l_discount") - 7, F.lit(0))).cast("double") / 100).alias("prcp"),
            (F.sum(hundredths("l_tax")).cast("double") / 100).alias("snow"),
            (F.sum(hundredths("l_extendedprice")).cast("double") / 100 / F.count(F.lit(1))).alias("awnd"),
        )
    )


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.clean_weather(raw_weather(spark, sf_dir))


def needs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.clean_needs(referral_feed(spark, sf_dir))


def joined_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_weather(needs_daily(spark, sf_dir), weather_daily(spark, sf_dir))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.build_features(weather_daily(spark, sf_dir), needs_daily(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix as the models read it: computed once, in reliable storage."""
    return cut_lineage(feature_matrix(spark, sf_dir))


def causal_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test result per line item: the line number is the lag, p is spread over [0, 1)."""
    lineitem, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    p = F.pmod(F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_suppkey") * 31, F.lit(1000003))
    p = F.floor(p) / 1000003.0
    p = F.rint(p * 1e6) / 1e6
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("experiment_id"),
            F.when(F.col("l_linestatus") == "O", "max_temp").otherwise("precip").alias("feature_name"),
            F.col("l_linenumber").alias("lag"),
            p.alias("p_value"),
            F.col("l_quantity").alias("f_statistic"),
            F.when(p < 0.05, 1).otherwise(0).alias("significant_flag"),
            F.col("o_orderpriority").alias("need_type"),
            F.col("r_name").alias("region_id"),
            F.col("l_partkey").alias("part"),
        )
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment per order."""
    kind = F.when(F.col("o_orderstatus") == "F", "rolling_baseline_ar").when(
        F.col("o_orderstatus") == "O", "rolling_var_all_weather").otherwise("baseline_ar")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("experiment_id"), kind.alias("model_type"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric row per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("experiment_id"),
        F.col("l_linenumber").alias("split_index"),
        F.col("l_quantity").alias("rmse"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by three models over yearly splits; the discount is the error."""
    model = F.when(F.col("l_returnflag") == "A", "baseline_ar").when(
        F.col("l_returnflag") == "N", "var_all_weather").otherwise("granger_selected")
    return table(spark, sf_dir, "lineitem").select(
        model.alias("model_type"),
        F.year("l_shipdate").alias("split_index"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_quantity") - 1).alias("actual"),
        (F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("predicted"),
    )


# --- the same inputs as SQL -------------------------------------------------------------

SQL = {}

SQL["referrals"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS ref_id, CAST(o_custkey AS VARCHAR) AS need_id, 'orders' AS source_file,
       CAST(o_orderdate AS DATE) AS ref_date, r_name AS state,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Other' ELSE o_orderpriority END AS category,
       CASE o_orderstatus WHEN 'F' THEN 'Confirmed' WHEN 'O' THEN 'Unmet' ELSE 'InProcess' END AS need_status,
       o_orderkey AS row_seq
FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

SQL["referral_feed"] = """
SELECT ref_id, need_id, source_file, strftime(ref_date, '%Y-%m-%d') AS ref_date, state, category, need_status, row_seq
FROM referrals
UNION ALL
SELECT ref_id, need_id, source_file, strftime(ref_date, '%Y-%m-%d') || ' 08:30:00', state, ' ' || category || ' ',
       'Unmet', row_seq + 1000000000000 FROM referrals WHERE need_status = 'Confirmed'
UNION ALL
SELECT 'u' || ref_id, need_id, source_file, 'unknown', state, category, need_status, row_seq + 1000000000000
FROM referrals WHERE need_status = 'InProcess'
UNION ALL
SELECT 's' || ref_id, need_id, source_file, strftime(ref_date, '%Y-%m-%d'), NULL, category, need_status,
       row_seq + 1000000000000 FROM referrals WHERE state = 'AFRICA'
"""

SQL["raw_weather"] = """
SELECT CAST(l_shipdate AS DATE) AS date, r_name AS region_id,
       MAX(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS tmax,
       MIN(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS tmin,
       AVG(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS tavg,
       CAST(SUM(GREATEST(CAST(ROUND(l_discount * 100) AS BIGINT) - 7, 0)) AS DOUBLE) / 100 AS prcp,
       CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS snow,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS awnd
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
              JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
"""

VALUES = ["tmax", "tmin", "tavg", "prcp", "snow", "awnd"]

SQL["wx_filled"] = (
    "SELECT date, region_id, "
    + ", ".join(
        f"COALESCE(last_value({c} IGNORE NULLS) OVER past, first_value({c} IGNORE NULLS) OVER future, 0) AS {c}"
        for c in VALUES
    )
    + """
FROM raw_weather
WINDOW past AS (PARTITION BY region_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       future AS (PARTITION BY region_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
"""
)

SQL["wx_bounds"] = (
    "SELECT region_id, "
    + ", ".join(
        f"round(quantile_cont({c}, 0.01), 9) AS lo_{c}, round(quantile_cont({c}, 0.99), 9) AS hi_{c}"
        for c in VALUES[:3]
    )
    + " FROM wx_filled GROUP BY region_id"
)

SQL["wx_clipped"] = (
    "SELECT f.date, f.region_id, "
    + ", ".join(f"greatest(least(f.{c}, b.hi_{c}), b.lo_{c}) AS {c}" for c in VALUES[:3])
    + ", f.prcp, f.snow, f.awnd FROM wx_filled f JOIN wx_bounds b ON f.region_id = b.region_id"
)

SQL["wx_limits"] = """
SELECT region_id, round(quantile_cont(tmax, 0.95), 9) AS hot, round(quantile_cont(tmin, 0.05), 9) AS cold,
       COALESCE(round(quantile_cont(prcp, 0.95) FILTER (WHERE prcp > 0), 9), 999) AS wet
FROM wx_clipped GROUP BY region_id
"""

SQL["wx_flagged"] = """
SELECT c.*,
       CASE WHEN SUM(CASE WHEN c.tmax >= l.hot THEN 1 ELSE 0 END) OVER run >= 3 THEN 1 ELSE 0 END AS heatwave_flag,
       CASE WHEN SUM(CASE WHEN c.tmin <= l.cold THEN 1 ELSE 0 END) OVER run >= 3 THEN 1 ELSE 0 END AS coldwave_flag,
       CASE WHEN c.prcp >= l.wet THEN 1 ELSE 0 END AS heavy_rain_flag
FROM wx_clipped c JOIN wx_limits l ON c.region_id = l.region_id
WINDOW run AS (PARTITION BY c.region_id ORDER BY c.date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
"""


def exact(x: str, digits: int) -> str:
    """SQL twin of round_half_even."""
    return f"(round_even(({x}) * {10**digits}.0::DOUBLE, 0) / {10**digits}.0::DOUBLE + 0.0)"


def stable(x: str, digits: int) -> str:
    """SQL twin of round_stable."""
    return (
        f"(round_even(round_even(({x}) * {10 ** (digits + 8)}.0::DOUBLE, 0) / 100000000.0::DOUBLE, 0)"
        f" / {10**digits}.0::DOUBLE + 0.0)"
    )


def trailing(fn: str, column: str, width: int, keys: str) -> str:
    return (
        f"{fn}({column}) OVER (PARTITION BY {keys} ORDER BY date "
        f"ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    )


SQL["weather_daily"] = f"""
SELECT date, region_id, {exact('tavg', 2)} AS avg_temp, {exact('tmax', 2)} AS max_temp, {exact('tmin', 2)} AS min_temp,
       {exact('tmax - tmin', 2)} AS temp_range, {exact('prcp', 2)} AS precip, snow, {exact('awnd', 2)} AS wind_speed,
       heatwave_flag, coldwave_flag, heavy_rain_flag,
       {stable(trailing('AVG', 'tavg', 7, 'region_id'), 2)} AS rolling_7d_temp,
       {stable(trailing('AVG', 'tavg', 14, 'region_id'), 2)} AS rolling_14d_temp,
       {stable(trailing('SUM', 'prcp', 7, 'region_id'), 2)} AS rolling_7d_precip,
       {stable(trailing('SUM', 'prcp', 30, 'region_id'), 2)} AS rolling_30d_precip
FROM wx_flagged
"""

SQL["needs_dated"] = """
SELECT *, CAST(TRY_CAST(trim(ref_date) AS TIMESTAMP) AS DATE) AS date FROM referral_feed
WHERE TRY_CAST(trim(ref_date) AS TIMESTAMP) IS NOT NULL
"""

SQL["needs_named"] = """
SELECT * EXCLUDE (category), CASE WHEN trim(category) = 'Other' THEN 'Other Assistance' ELSE trim(category) END AS category
FROM needs_dated
"""

SQL["needs_unique"] = """
SELECT * FROM needs_named
QUALIFY row_number() OVER (PARTITION BY ref_id, need_id, source_file ORDER BY row_seq) = 1
"""

SQL["needs_counts"] = """
SELECT date, state AS region_id, category AS need_type, COUNT(ref_id) AS daily_need_count,
       CAST(SUM(CASE WHEN need_status = 'Confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS confirmed_count,
       CAST(SUM(CASE WHEN need_status = 'Unmet' THEN 1 ELSE 0 END) AS BIGINT) AS unmet_count
FROM needs_unique WHERE state IS NOT NULL GROUP BY ALL
"""

SQL["needs_daily"] = f"""
SELECT *, {stable(trailing('AVG', 'daily_need_count', 7, 'region_id, need_type'), 2)} AS rolling_7d_count,
       {stable(trailing('AVG', 'daily_need_count', 14, 'region_id, need_type'), 2)} AS rolling_14d_count,
       {stable(trailing('AVG', 'daily_need_count', 30, 'region_id, need_type'), 2)} AS rolling_30d_count
FROM needs_counts
"""

SQL["joined_panel"] = """
SELECT n.date, n.region_id, n.need_type, n.daily_need_count AS target_count, n.confirmed_count, n.unmet_count,
       n.rolling_7d_count, n.rolling_14d_count, n.rolling_30d_count,
       w.* EXCLUDE (date, region_id)
FROM needs_daily n JOIN weather_daily w ON n.date = w.date AND n.region_id = w.region_id
"""


def lagged(column: str, k: int) -> str:
    return f"lag({column}, {k}) OVER (PARTITION BY region_id, need_type ORDER BY date)"


SQL["lagged_panel"] = (
    "SELECT *, "
    + ", ".join(
        [f"{lagged('max_temp', k)} AS tmax_lag_{k}, {lagged('precip', k)} AS prcp_lag_{k}" for k in (1, 3, 7, 14, 30)]
        + [f"{lagged('target_count', k)} AS target_lag_{k}" for k in (1, 7)]
    )
    + " FROM joined_panel"
)

SERIES = "region_id, need_type"
SQL["rolled_panel"] = f"""
SELECT *, {stable(trailing('AVG', 'max_temp', 7, SERIES), 2)} AS temp_rollmean_7,
       {stable(trailing('AVG', 'max_temp', 14, SERIES), 2)} AS temp_rollmean_14,
       {stable(trailing('SUM', 'precip', 7, SERIES), 2)} AS precip_rollsum_7,
       {stable(trailing('SUM', 'precip', 30, SERIES), 2)} AS precip_rollsum_30,
       {stable(trailing('AVG', 'target_count', 7, SERIES), 2)} AS target_rollmean_7,
       {stable(trailing('AVG', 'target_count', 14, SERIES), 2)} AS target_rollmean_14
FROM lagged_panel
"""

SEASON_SQL = (
    "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' "
    "WHEN month(date) <= 8 THEN 'summer' ELSE 'fall' END"
)
CALENDAR_SQL = f"""CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
       {SEASON_SQL} AS season,
       CASE WHEN date IN ('2025-01-01', '2025-01-20', '2025-02-17', '2025-05-26', '2025-06-19', '2025-07-04')
            THEN 1 ELSE 0 END AS holiday_flag,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend"""

SQL["feature_matrix"] = f"""
SELECT date, region_id, need_type, CAST(target_count AS INTEGER) AS target_count,
       tmax_lag_1, tmax_lag_3, tmax_lag_7, tmax_lag_14, tmax_lag_30,
       prcp_lag_1, prcp_lag_3, prcp_lag_7, prcp_lag_14, prcp_lag_30,
       temp_rollmean_7, temp_rollmean_14, precip_rollsum_7, precip_rollsum_30,
       temp_rollmean_7 * precip_rollsum_7 AS temp_precip_interact,
       temp_rollmean_7 * target_rollmean_7 AS temp_target_interact,
       max_temp - tmax_lag_7 AS temp_trend_7d,
       CAST(target_lag_1 AS INTEGER) AS target_lag_1, CAST(target_lag_7 AS INTEGER) AS target_lag_7,
       target_rollmean_7, target_rollmean_14, heatwave_flag, coldwave_flag, heavy_rain_flag,
       {CALENDAR_SQL}
FROM rolled_panel
WHERE tmax_lag_30 IS NOT NULL AND prcp_lag_30 IS NOT NULL AND target_lag_7 IS NOT NULL
"""

SQL["causal_results"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS experiment_id,
       CASE WHEN l_linestatus = 'O' THEN 'max_temp' ELSE 'precip' END AS feature_name, l_linenumber AS lag,
       p AS p_value, l_quantity AS f_statistic, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS significant_flag,
       o_orderpriority AS need_type, r_name AS region_id, l_partkey AS part
FROM (SELECT *, round_even((l_partkey * 7919 + l_orderkey * 104729 + l_suppkey * 31) % 1000003
                           / 1000003.0::DOUBLE * 1e6, 0) / 1e6::DOUBLE AS p FROM lineitem)
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

SQL["experiments"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id,
       CASE o_orderstatus WHEN 'F' THEN 'rolling_baseline_ar' WHEN 'O' THEN 'rolling_var_all_weather'
            ELSE 'baseline_ar' END AS model_type FROM orders
"""

SQL["metrics"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS experiment_id, l_linenumber AS split_index, l_quantity AS rmse FROM lineitem
"""

SQL["predictions"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'baseline_ar' WHEN 'N' THEN 'var_all_weather' ELSE 'granger_selected' END AS model_type,
       CAST(year(l_shipdate) AS INTEGER) AS split_index, CAST(l_shipdate AS DATE) AS date, l_quantity - 1 AS actual,
       l_quantity * (1 + l_discount - l_tax) AS predicted FROM lineitem
"""

_NEEDS_OF = {
    "referral_feed": ["referrals"],
    "wx_filled": ["raw_weather"],
    "wx_bounds": ["wx_filled"],
    "wx_clipped": ["wx_filled", "wx_bounds"],
    "wx_limits": ["wx_clipped"],
    "wx_flagged": ["wx_clipped", "wx_limits"],
    "weather_daily": ["wx_flagged"],
    "needs_dated": ["referral_feed"],
    "needs_named": ["needs_dated"],
    "needs_unique": ["needs_named"],
    "needs_counts": ["needs_unique"],
    "needs_daily": ["needs_counts"],
    "joined_panel": ["needs_daily", "weather_daily"],
    "lagged_panel": ["joined_panel"],
    "rolled_panel": ["lagged_panel"],
    "feature_matrix": ["rolled_panel"],
}


def with_inputs(body: str, *names: str, **extra: str) -> str:
    """`body` preceded by the common table expressions it names and those they build on.

    `extra` adds further expressions after them, in the given order.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS_OF.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n].strip()})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({sql.strip()})" for n, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()
