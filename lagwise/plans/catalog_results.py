"""Checked queries: ingest, summaries, causality, models, evaluation."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lagwise.functions import expressions as ex
from lagwise.operators import causality, evaluate, models, summary
from lagwise.operators.features import with_current_weather
from lagwise.plans import bindings as b
from lagwise.plans import pipelines
from lagwise.plans.bindings import stable, table, with_inputs
from lagwise.plans.catalog_panel import ALIGNMENT
from lagwise.schemas import WEATHER_LAGS
from lagwise.session import cut_lineage, cut_lineages, shared_dir
from lagwise.sources import referrals, tables
from lagwise.sources import results as stored

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- referral files ---------------------------------------------------------------------

def _headers(spark, sf):
    """Orders under the headers of the referral feed, with gaps, padding and unreadable numbers."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = F.col
    text = {
        "REF_ID": c("o_orderkey").cast("string"),
        "REF_CODE": F.when(c("o_orderstatus") == "F", F.concat(F.lit(" C"), c("o_custkey").cast("string"))).otherwise(""),
        "REF_CODE_x": F.when(c("o_orderstatus") != "F", F.concat(F.lit("X"), c("o_custkey").cast("string"))),
        "REF_DATE": F.when(c("o_orderstatus") == "P", "  ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "ZIPCODE": c("c_nationkey").cast("string"),
        "STATE": F.when(c("o_orderpriority") == "1-URGENT", "").otherwise(F.concat(F.lit("S"), c("c_nationkey").cast("string"))),
        "CATEGORY": c("o_orderpriority"),
        "Age": F.when(c("o_orderpriority") == "5-LOW", "x").otherwise(F.concat(c("c_nationkey").cast("string"), F.lit(".7"))),
        "RISK_SCORE": F.concat((c("o_custkey") + 0).cast("string"), F.lit(".25")),
        "SUBCATEGORY": F.concat(F.lit('line one\nline "two" of '), c("o_orderpriority")),
    }
    return orders.select(*[v.alias(h) for h, v in text.items()], F.col("o_orderkey").alias("row_seq"))


_HEADERS = """
SELECT o_orderkey, o_custkey, c_nationkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'S' || c_nationkey END AS state
FROM orders JOIN customer ON o_custkey = c_custkey
"""
_PARSED = """
SELECT CAST(o_orderkey AS VARCHAR) AS ref_id,
       CASE WHEN o_orderstatus = 'F' THEN 'C' || o_custkey ELSE 'X' || o_custkey END AS ref_code,
       strftime(d, '%Y-%m-%d') AS ref_date, CAST(c_nationkey AS VARCHAR) AS zipcode, state,
       COALESCE(state, z.zip_state) AS region_id, o_orderpriority AS category,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE c_nationkey END AS age,
       CAST(o_custkey AS DOUBLE) + 0.25 AS risk_score, 'line one' || chr(10) || 'line "two" of ' || o_orderpriority AS subcategory
FROM headers LEFT JOIN (SELECT c_nationkey AS zip, MIN(state) AS zip_state FROM headers WHERE state IS NOT NULL GROUP BY 1) z
     ON z.zip = c_nationkey
WHERE o_orderstatus <> 'P'
"""
_PARSED_COLUMNS = [
    "ref_id", "ref_code", "ref_date", "zipcode", "state", "region_id", "category", "age", "risk_score", "subcategory"]


def _complete_headers(df):
    missing = [h for h in referrals.HEADERS if h not in df.columns]
    return df.withColumns({h: F.lit(None).cast("string") for h in missing}).withColumn("source_file", F.lit("orders"))


@query("p4_p6_parse_referrals", with_inputs(_PARSED, headers=_HEADERS))
def parse(spark, sf):
    raw = _complete_headers(_headers(spark, sf))
    return referrals.parse_referrals(raw, referrals.region_lookup(raw)).select(*_PARSED_COLUMNS)


# Orders of one file of the feed, about 40 MB, since a task writes it.
FILE_ROWS = 250_000


def _csv_feed(spark, sf, files: int = 2) -> list[str]:
    """The feed as files of two kinds of headers, at least `files` of each, and a file that is not there."""
    full, core = _scratch(spark, "feed-full"), _scratch(spark, "feed-core")
    files = max(files, -(-table(spark, sf, "orders").count() // FILE_ROWS))
    rows = _headers(spark, sf).drop("row_seq").repartition(files, "REF_ID")
    first = F.col("REF_CODE") != ""
    rows.filter(first).drop("REF_CODE_x").write.csv(full, header=True, escape='"', quoteAll=True)
    rows.filter(~first).drop("REF_CODE").write.csv(core, header=True, escape='"', quoteAll=True)
    return [full, f"{full}-absent", core]


@query("s1_s2_csv_ingest", with_inputs(_PARSED, headers=_HEADERS))
def csv_ingest(spark, sf):
    return referrals.ingest_referrals(spark, _csv_feed(spark, sf)).select(*_PARSED_COLUMNS)


@query("s2_many_files", with_inputs(_PARSED, headers=_HEADERS))
def many_files(spark, sf):
    return referrals.ingest_referrals(spark, _csv_feed(spark, sf, files=100)).select(*_PARSED_COLUMNS)


@query("s1_ingest_report", with_inputs("""
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS ingested,
       COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS skipped, 2 AS kinds FROM headers
""", headers=_HEADERS))
def ingest_report(spark, sf):
    """The reports of the files written, added up, since their names are Spark's, and how many kinds of headers they have."""
    feed = _csv_feed(spark, sf, files=1)
    report = referrals.ingest_report(referrals.scan_files(spark, feed))
    heads = spark.createDataFrame(
        [(uri.rpartition("/")[2], line) for _, uri, line, _ in referrals.listed_files(spark, feed)], "filename string, header string")
    return report.join(F.broadcast(heads), "filename").agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "ingested", "skipped")], F.count_distinct("header").cast("int").alias("kinds"))


_ZIPS = """
SELECT CAST(o_custkey AS VARCHAR) AS zipcode, o_orderpriority AS state FROM orders WHERE o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
"""


def _zip_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("ZIPCODE"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("STATE"),
        F.col("o_orderkey").alias("row_seq"))


@query("s3_region_lookup", f"SELECT zipcode AS region_id, zipcode, state FROM ({_ZIPS})")
def region_lookup(spark, sf):
    return referrals.region_lookup(_zip_rows(spark, sf)).select("region_id", "zipcode", "state")


@query("s4_zip_to_state", f"SELECT zipcode, state AS zip_state FROM ({_ZIPS})")
def zip_to_state(spark, sf):
    return referrals.zip_to_state(referrals.region_lookup(_zip_rows(spark, sf)))


@query("j4_zip_lookup_join", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS state,
       COALESCE(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END, z.state) AS region_id
FROM orders LEFT JOIN ({_ZIPS}) z ON z.zipcode = CAST(o_custkey AS VARCHAR)
""")
def zip_join(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("zipcode"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("state"),
        F.col("o_orderkey").cast("string").alias("ref_id"), F.col("o_custkey").cast("string").alias("need_id"))
    joined = referrals.add_region(rows, referrals.region_lookup(_zip_rows(spark, sf)))
    return joined.select("o_orderkey", "state", "region_id")


# --- sinks ------------------------------------------------------------------------------

@query("s7_full_refresh", with_inputs("SELECT * FROM needs_counts WHERE region_id = 'ASIA'", "needs_counts"))
def full_refresh(spark, sf):
    path = _scratch(spark, "needs")
    cells = b.needs_daily(spark, sf).drop("rolling_7d_count", "rolling_14d_count", "rolling_30d_count")
    tables.replace_table(cells, path)
    tables.replace_table(cells.filter("region_id = 'ASIA'"), path)
    return tables.scan(spark, path)


@query("s8_upsert_table", """
SELECT o_custkey AS key, o_orderstatus AS part, o_totalprice AS amount, o_orderkey AS seq FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1
""")
def upsert_table(spark, sf):
    path = _scratch(spark, "upsert")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("part"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    tables.upsert_table(spark, path, rows.filter("part <> 'P'"), ["key", "part"], "seq", ["part"])
    tables.upsert_table(spark, path, rows.filter("part <> 'F'"), ["key", "part"], "seq", ["part"])
    return tables.scan(spark, path)


@query("s10_store_results", with_inputs("""
SELECT feature_name, lag, p_value, part, experiment_id FROM (
  SELECT feature_name, lag, p_value, part, 'run-' || feature_name AS experiment_id FROM causal_results)
""", "causal_results"))
def store_results(spark, sf):
    path = _scratch(spark, "results")
    rows = b.causal_results(spark, sf).select("feature_name", "lag", "p_value", "part")
    for feature in ("max_temp", "precip", "max_temp"):
        tables.store_results(rows.filter(F.col("feature_name") == feature), path, f"run-{feature}")
    return tables.scan(spark, path)


@query("s11_feature_export", with_inputs(
    "SELECT date, need_type, target_count, season, region_id FROM feature_matrix", "feature_matrix"))
def feature_export(spark, sf):
    path = _scratch(spark, "features")
    tables.export_features(b.feature_matrix(spark, sf), path)
    return tables.scan(spark, path, ["date", "need_type", "target_count", "season", "region_id"])


@query("s12_json_summary", with_inputs("""
SELECT COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE significant_flag = 1) AS significant_tests FROM causal_results
""", "causal_results"))
def json_summary(spark, sf):
    path = _scratch(spark, "summary")
    found = summary.discovery_rate(b.causal_results(spark, sf)).select("total_tests", "significant_tests")
    tables.write_summary(found, path)
    return tables.read_summary(spark, path, found.schema)


# --- summaries --------------------------------------------------------------------------

@query("a2_national_daily", with_inputs(f"""
SELECT COALESCE(n.date, w.date) AS date, n.daily_need_count, w.avg_temp FROM
 (SELECT date, CAST(SUM(daily_need_count) AS BIGINT) AS daily_need_count FROM needs_counts GROUP BY date) n FULL JOIN
 (SELECT date, {stable('AVG(avg_temp)', 4)} AS avg_temp FROM weather_daily GROUP BY date) w ON n.date = w.date
""", "needs_counts", "weather_daily"))
def a2(spark, sf):
    return summary.national_daily(b.needs_daily(spark, sf), b.weather_daily(spark, sf))


@query("a3_totals_by_category", with_inputs("""
SELECT need_type, CAST(SUM(daily_need_count) AS BIGINT) AS total_needs FROM needs_counts GROUP BY need_type
""", "needs_counts"))
def a3(spark, sf):
    return summary.totals_by(b.needs_daily(spark, sf), "need_type", "daily_need_count", "total_needs")


@query("a4_totals_by_region", with_inputs("""
SELECT region_id, CAST(SUM(daily_need_count) AS BIGINT) AS total_needs FROM needs_counts GROUP BY region_id
""", "needs_counts"))
def a4(spark, sf):
    return summary.totals_by(b.needs_daily(spark, sf), "region_id", "daily_need_count", "total_needs")


@query("a5_distinct_counts", """
SELECT COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_suppkey) AS suppliers,
       (SELECT COUNT(*) FROM (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem)) AS supplier_days
FROM lineitem
""")
def a5(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return summary.distinct_counts(
        lines, {"orders": ["l_orderkey"], "suppliers": ["l_suppkey"], "supplier_days": ["l_suppkey", "day"]})


@query("a6_region_summary", with_inputs(f"""
SELECT region_id, {stable('AVG(avg_temp)', 1)} AS mean_temp, {stable('MIN(min_temp)', 1)} AS coldest,
       {stable('MAX(max_temp)', 1)} AS hottest, {stable('SUM(precip)', 2)} AS rain, COUNT(*) AS days
FROM weather_daily GROUP BY region_id
""", "weather_daily"))
def a6(spark, sf):
    columns = {"mean_temp": ("avg", "avg_temp"), "coldest": ("min", "min_temp"), "hottest": ("max", "max_temp")}
    panel = b.weather_daily(spark, sf)
    rain = summary.describe(panel, {"rain": ("sum", "precip"), "days": ("count", "date")}, ["region_id"])
    return summary.describe(panel, columns, ["region_id"], 1).join(rain, "region_id")


@query("a7_frequencies", """
SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10
""")
def a7(spark, sf):
    return summary.frequencies(table(spark, sf, "orders"), "o_custkey", 10)


_LAGS = [1, 2, 3, 4, 5, 6, 7]


def _heat(keys: str, value: str) -> str:
    cells = ", ".join(f"{stable(value.format(where=f'FILTER (WHERE lag = {k})'), 6)} AS lag_{k}" for k in _LAGS)
    return with_inputs(f"SELECT {keys}, {cells} FROM causal_results GROUP BY {keys}", "causal_results")


@query("a10_lag_heatmap", _heat("feature_name", "AVG(-log10(greatest(p_value, 1e-10))) {where}"))
def a10(spark, sf):
    return summary.lag_heatmap(b.causal_results(spark, sf), _LAGS)


@query("a10_lag_heatmap_by_need", _heat("feature_name, need_type", "AVG(-log10(greatest(p_value, 1e-10))) {where}"))
def a10_need(spark, sf):
    return summary.lag_heatmap(b.causal_results(spark, sf), _LAGS, ["feature_name", "need_type"])


@query("a10_lag_heatmap_mean_first", _heat("feature_name", "-log10(greatest(AVG(p_value) {where}, 1e-10))"))
def a10_mean(spark, sf):
    return summary.lag_heatmap(b.causal_results(spark, sf), _LAGS, average_first=True)


_CORR = ["target_count", "tmax_lag_1", "tmax_lag_7", "prcp_lag_1", "prcp_lag_7", "target_lag_1", "target_lag_7",
         "temp_rollmean_7", "precip_rollsum_7", "heatwave_flag", "is_weekend"]


def _corr_sql() -> str:
    def cell(x: str, y: str) -> str:
        return f"{stable(f'CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END', 6)} AS {y}"

    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, {', '.join(cell(x, y) for y in _CORR)} FROM feature_matrix" for x in _CORR)


@query("a11_correlations", with_inputs(_corr_sql(), "feature_matrix"))
def a11(spark, sf):
    return summary.correlation_matrix(b.feature_matrix(spark, sf), _CORR)


@query("a12_p_histogram", with_inputs("""
SELECT feature_name, CAST(least(floor(p_value * 30) + 1, 30) AS INTEGER) AS bin, COUNT(*) AS tests
FROM causal_results GROUP BY ALL
""", "causal_results"))
def a12(spark, sf):
    return summary.p_histogram(b.causal_results(spark, sf))


@query("a13_event_counts", with_inputs("""
SELECT CAST(SUM(heatwave_flag) AS BIGINT) AS heatwave_days, CAST(SUM(coldwave_flag) AS BIGINT) AS coldwave_days,
       CAST(SUM(heavy_rain_flag) AS BIGINT) AS heavy_rain_days,
       CAST(SUM(1 - greatest(heatwave_flag, coldwave_flag, heavy_rain_flag)) AS BIGINT) AS normal_days FROM weather_daily
""", "weather_daily"))
def a13(spark, sf):
    return summary.event_counts(b.weather_daily(spark, sf))


@query("a14_discovery_rate", with_inputs(f"""
SELECT COUNT(*) AS total_tests, COUNT(*) FILTER (WHERE significant_flag = 1) AS significant_tests,
       {stable('COUNT(*) FILTER (WHERE significant_flag = 1)::DOUBLE / greatest(COUNT(*), 1) * 100', 1)} AS discovery_pct,
       MIN(p_value) AS min_p FROM causal_results
""", "causal_results"))
def a14(spark, sf):
    return summary.discovery_rate(b.causal_results(spark, sf))


@query("a15_headline", with_inputs("""
SELECT (SELECT COUNT(*) FROM referral_feed) AS raw_records, (SELECT COUNT(DISTINCT region_id) FROM weather_daily) AS states,
       (SELECT COUNT(DISTINCT need_type) FROM needs_counts) AS need_categories,
       (SELECT COUNT(*) FROM feature_matrix) AS feature_rows, (SELECT COUNT(*) FROM causal_results) AS granger_tests,
       (SELECT COUNT(*) FROM causal_results WHERE significant_flag = 1) AS significant_tests,
       (SELECT COUNT(*) FROM experiments) AS experiments
""", "referral_feed", "feature_matrix", "causal_results", "experiments"))
def a15(spark, sf):
    # The panels are stored, as they are in a store: each is made once, and all counts are taken from there.
    wx, nd = cut_lineages(b.weather_daily(spark, sf), b.needs_daily(spark, sf))
    return summary.headline(
        b.referral_feed(spark, sf), wx, nd, pipelines.build_features(wx, nd),
        b.causal_results(spark, sf), b.experiments(spark, sf))


_RESULT = "experiment_id, feature_name, lag, p_value, f_statistic, significant_flag, need_type, region_id, part"
_BY_P = "p_value, experiment_id, feature_name, lag, f_statistic, significant_flag, need_type, region_id, part"


@query("p16_neg_log_p", with_inputs(
    f"SELECT experiment_id, lag, part, {stable('-log10(greatest(p_value, 1e-10))', 6)} AS neg_log_p FROM causal_results",
    "causal_results"))
def p16(spark, sf):
    return b.causal_results(spark, sf).select(
        "experiment_id", "lag", "part", ex.round_stable(ex.neg_log10_p(F.col("p_value")), 6).alias("neg_log_p"))


@query("p18_filtered_results", with_inputs(f"""
SELECT {_RESULT} FROM causal_results WHERE feature_name = 'max_temp' AND significant_flag = 1 AND lag <= 5
""", "causal_results"))
def p18(spark, sf):
    return summary.filter_results(b.causal_results(spark, sf), "max_temp", True, 5)


@query("p19_series_lookup", with_inputs(
    "SELECT * FROM needs_daily WHERE region_id = 'ASIA' AND need_type = '1-URGENT'", "needs_daily"))
def p19(spark, sf):
    return summary.series(b.needs_daily(spark, sf), "ASIA", "1-URGENT")


@query("p20_region_filter", with_inputs(
    "SELECT * FROM weather_daily WHERE region_id IN ('ASIA', 'EUROPE')", "weather_daily"))
def p20(spark, sf):
    return summary.regions_only(b.weather_daily(spark, sf), ["ASIA", "EUROPE"])


@query("o1_sorted_results", with_inputs(f"SELECT {_RESULT} FROM causal_results ORDER BY {_BY_P}", "causal_results"))
def o1(spark, sf):
    return summary.sort_by_p(b.causal_results(spark, sf))


@query("o2_smallest_ten", with_inputs(
    f"SELECT {_RESULT} FROM causal_results ORDER BY {_BY_P} LIMIT 10", "causal_results"))
def o2(spark, sf):
    return summary.smallest_p(b.causal_results(spark, sf), 10)


@query("o3_top_twenty_filtered", with_inputs(
    f"SELECT {_RESULT} FROM causal_results WHERE p_value < 0.2 ORDER BY {_BY_P} LIMIT 20", "causal_results"))
def o3(spark, sf):
    return summary.smallest_p(b.causal_results(spark, sf), 20, below=0.2)


# --- causality --------------------------------------------------------------------------

def _tested_panel(spark, sf):
    wx = b.weather_daily(spark, sf)
    return cut_lineage(with_current_weather(pipelines.build_features(wx, b.needs_daily(spark, sf)), wx))


_TESTED = """
SELECT f.date, f.region_id, f.need_type, f.target_count::DOUBLE AS y, w.max_temp, w.precip
FROM feature_matrix f LEFT JOIN weather_daily w ON f.date = w.date AND f.region_id = w.region_id
"""


@query("g1_unit_root_tests")
def g1(spark, sf):
    return causality.unit_root_tests(_tested_panel(spark, sf), ["target_count", "max_temp", "precip"])


_STEPS = " UNION ALL ".join(
    f"""SELECT region_id, need_type, '{name}' AS variable, {column} - lag({column}) OVER w AS step, lag({column}) OVER w AS before,
        COUNT(*) OVER (PARTITION BY region_id, need_type) AS n FROM tested WHERE {column} IS NOT NULL
        WINDOW w AS (PARTITION BY region_id, need_type ORDER BY date)"""
    for name, column in (("target_count", "y"), ("max_temp", "max_temp"), ("precip", "precip")))


@query("g1_unit_root_no_lags", with_inputs(f"""
SELECT region_id, need_type, variable, {stable('slope / sqrt((syy - slope * slope * sxx) / (m - 2) / sxx)', 3)} AS adf_stat FROM (
  SELECT region_id, need_type, variable, regr_slope(step, before) AS slope, regr_sxx(step, before) AS sxx,
         regr_syy(step, before) AS syy, regr_count(step, before) AS m
  FROM steps WHERE n >= 4 GROUP BY ALL) WHERE sxx > 0 AND syy > 0 AND m > 2
""", "feature_matrix", "weather_daily", tested=_TESTED, steps=_STEPS))
def g1_plain(spark, sf):
    tested = causality.unit_root_tests(_tested_panel(spark, sf), ["target_count", "max_temp", "precip"], lags=0, digits=12)
    return tested.filter("adf_stat IS NOT NULL").select(
        "region_id", "need_type", "variable", ex.round_stable(F.col("adf_stat"), 3).alias("adf_stat"))


@query("g2_pairs_as_they_are", with_inputs("""
SELECT region_id, need_type, feature_name, date, y, x FROM (
  SELECT region_id, need_type, date, y, COUNT(*) OVER (PARTITION BY region_id, need_type) AS n,
         unnest(['max_temp', 'precip']) AS feature_name, unnest([max_temp, precip]) AS x
  FROM (SELECT * FROM tested))
WHERE n >= 50 AND y IS NOT NULL AND x IS NOT NULL
""", "feature_matrix", "weather_daily", tested=_TESTED))
def g2_plain(spark, sf):
    return causality.stationary_pairs(_tested_panel(spark, sf), make_stationary=False, min_rows=25)


@query("g2_stationary_pairs")
def g2(spark, sf):
    return causality.stationary_pairs(_tested_panel(spark, sf), min_rows=causality.MAX_LAG + 10)


@query("g3_granger_tests")
def g3(spark, sf):
    return causality.granger_tests(_tested_panel(spark, sf))


_LAG_ONE = f"""
SELECT region_id, need_type, feature_name, 1 AS lag, {stable('r2 * (n - 4) / (1 - r2)', 4)} AS f_statistic FROM (
  SELECT *, power(yx - yl * xl, 2) / ((1 - yl * yl) * (1 - xl * xl)) AS r2 FROM (
    SELECT region_id, need_type, feature_name, COUNT(*) + 1 AS n, corr(y, x1) AS yx, corr(y, y1) AS yl, corr(x1, y1) AS xl
    FROM (SELECT region_id, need_type, feature_name, y,
                 lag(y) OVER s AS y1, lag(x) OVER s AS x1
          FROM (SELECT region_id, need_type, date, y, 'max_temp' AS feature_name, max_temp AS x FROM tested
                UNION ALL SELECT region_id, need_type, date, y, 'precip', precip FROM tested)
          WINDOW s AS (PARTITION BY region_id, need_type, feature_name ORDER BY date))
    WHERE y1 IS NOT NULL GROUP BY ALL))
WHERE n > 46
"""


@query("g3_granger_first_lag", with_inputs(_LAG_ONE, "feature_matrix", "weather_daily", tested=_TESTED))
def g3_first(spark, sf):
    tested = causality.granger_tests(_tested_panel(spark, sf), make_stationary=False)
    return tested.filter("lag = 1").select("region_id", "need_type", "feature_name", "lag", "f_statistic")


_SIGNIFICANT = """
SELECT feature_name, string_agg(DISTINCT lag::VARCHAR, ',' ORDER BY lag::VARCHAR) AS lags
FROM causal_results WHERE significant_flag = 1 GROUP BY feature_name
"""


def _joined(df):
    return df.withColumn("lags", F.array_join(F.col("lags").cast("array<string>"), ","))


@query("g4_significant_lags", with_inputs(_SIGNIFICANT, "causal_results"))
def g4(spark, sf):
    return _joined(causality.significant_lags(b.causal_results(spark, sf)))


@query("g4_significant_lags_relaxed", with_inputs(
    _SIGNIFICANT.replace("significant_flag = 1", "p_value >= 0.05 AND p_value < 0.20"), "causal_results"))
def g4_relaxed(spark, sf):
    return _joined(causality.significant_lags(b.causal_results(spark, sf).filter("significant_flag = 0")))


@query("g5_stored_lags", with_inputs(_SIGNIFICANT, "causal_results"))
def g5(spark, sf):
    return _joined(causality.stored_significant_lags(b.causal_results(spark, sf)))


@query("g5_stored_lags_fallback", with_inputs("""
SELECT feature_name, string_agg(lag::VARCHAR, ',' ORDER BY p_value, lag) AS lags FROM (
  SELECT feature_name, lag, p_value FROM causal_results WHERE p_value >= 0.05 AND p_value < 0.2
  ORDER BY p_value, feature_name, lag LIMIT 20) GROUP BY feature_name
""", "causal_results"))
def g5_fallback(spark, sf):
    return _joined(causality.stored_significant_lags(b.causal_results(spark, sf).filter("significant_flag = 0")))


def _cross_sql(keys: str, order: str) -> str:
    same = " AND ".join(f"s.{k} = t.{k}" for k in keys.split(", "))
    return f"""
SELECT lag, {stable('AVG(r)', 6)} AS mean_corr, {stable('stddev_samp(r)', 6)} AS std_corr FROM (
  SELECT lag, {keys}, corr(x, y) AS r FROM (
    SELECT k AS lag, {", ".join("t." + k for k in keys.split(", "))}, t.y, s.max_temp AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS at,
                 COUNT(*) OVER (PARTITION BY {keys}) AS n FROM tested) t,
         range(0, 31) AS lags(k),
         (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS at FROM tested) s
    WHERE {same} AND s.at = t.at - k AND t.n >= 35)
  GROUP BY ALL) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY lag
"""


def _rounded_cross(found):
    return found.select(F.col("lag").cast("bigint").alias("lag"), *[
        ex.round_stable(F.col(c), 6).alias(c) for c in ("mean_corr", "std_corr")])


@query("g6_cross_correlations", with_inputs(
    _cross_sql("region_id, need_type", "date"), "feature_matrix", "weather_daily", tested=_TESTED))
def g6(spark, sf):
    return _rounded_cross(causality.cross_correlations(_tested_panel(spark, sf)))


@query("g6_cross_correlations_by_region", with_inputs(
    _cross_sql("region_id", "date, need_type"), "feature_matrix", "weather_daily", tested=_TESTED))
def g6_region(spark, sf):
    return _rounded_cross(causality.cross_correlations(
        _tested_panel(spark, sf), keys=["region_id"], order=["date", "need_type"], piece=500))


_NEAREST = ", ".join(f"({k})" for k in WEATHER_LAGS)


@query("g7_selected_features", with_inputs(f"""
SELECT DISTINCT CASE feature_name WHEN 'max_temp' THEN 'tmax' ELSE 'prcp' END || '_lag_' || nearest AS feature FROM (
  SELECT feature_name, lag, arg_min(a, abs(a - lag) * 1000 + a) AS nearest
  FROM (SELECT DISTINCT feature_name, lag FROM causal_results WHERE significant_flag = 1), (VALUES {_NEAREST}) AS v(a)
  GROUP BY feature_name, lag)
UNION SELECT * FROM (VALUES ('temp_rollmean_7'), ('precip_rollsum_7'), ('heatwave_flag'), ('coldwave_flag'),
  ('heavy_rain_flag'), ('temp_precip_interact'), ('temp_target_interact'), ('temp_trend_7d'))
""", "causal_results"))
def g7(spark, sf):
    return causality.select_lag_features(causality.significant_lags(b.causal_results(spark, sf)))


# --- models -----------------------------------------------------------------------------

@query("m1_holdout", with_inputs("""
SELECT COUNT(*) FILTER (WHERE date < (SELECT MAX(date) - 30 FROM feature_matrix)) AS n_train,
       COUNT(*) FILTER (WHERE date >= (SELECT MAX(date) - 30 FROM feature_matrix)) AS n_test,
       MIN(date) FILTER (WHERE date >= (SELECT MAX(date) - 30 FROM feature_matrix)) AS test_start FROM feature_matrix
""", "feature_matrix"))
def m1(spark, sf):
    train, test = models.holdout(b.stored_features(spark, sf))
    counted = train.agg(F.count(F.lit(1)).alias("n_train"))
    return counted.select(
        "n_train", test.agg(F.count(F.lit(1))).scalar().alias("n_test"), test.agg(F.min("date")).scalar().alias("test_start"))


@query("m2_baseline")
def m2(spark, sf):
    return models.baseline(*models.holdout(b.stored_features(spark, sf)))


@query("m2_p17_single_regressor", with_inputs(f"""
SELECT date, region_id, need_type, target_count::DOUBLE AS actual,
       {stable('greatest(a + s * target_lag_7, 0)', 6)} AS predicted, n AS n_train
FROM feature_matrix, (SELECT regr_intercept(target_count, target_lag_7) AS a, regr_slope(target_count, target_lag_7) AS s,
        COUNT(*) AS n FROM feature_matrix WHERE date < (SELECT MAX(date) - 30 FROM feature_matrix))
WHERE date >= (SELECT MAX(date) - 30 FROM feature_matrix) AND n >= 10
""", "feature_matrix"))
def m2_single(spark, sf):
    found = models.baseline(*models.holdout(b.stored_features(spark, sf)), columns=["target_lag_7"])
    return found.drop("model_type", "split_index").withColumn("predicted", ex.round_stable(F.col("predicted"), 6))


@query("m3_weather_trees")
def m3(spark, sf):
    train, test = models.holdout(b.stored_features(spark, sf))
    return models.weather_model(train, test)[0]


@query("m4_selected_trees")
def m4(spark, sf):
    selected = pipelines.selected_features(b.causal_results(spark, sf))
    train, test = models.holdout(b.stored_features(spark, sf))
    return models.weather_model(train, test, selected, "granger_selected")[1]


@query("m5_seasonal_drift")
def m5(spark, sf):
    return models.seasonal_drift(b.stored_features(spark, sf))


@query("m5_seasonal_drift_single", with_inputs(f"""
SELECT train_season, test_season, {stable('sqrt(AVG(e * e))', 4)} AS rmse, {stable('AVG(abs(e))', 4)} AS mae,
       MAX(n) AS n_train, COUNT(*) AS n_test
FROM (SELECT fit.season AS train_season, f.season AS test_season, fit.n,
             f.target_count - greatest(fit.my + fit.s * (f.tmax_lag_1 - fit.mx), 0) AS e
      FROM feature_matrix f JOIN (
        SELECT season, COUNT(*) AS n, AVG(target_count) AS my, AVG(tmax_lag_1) AS mx,
               regr_sxy(target_count, tmax_lag_1) / (regr_sxx(target_count, tmax_lag_1) + 1) AS s
        FROM feature_matrix GROUP BY season) fit
      ON ((fit.season = 'winter' AND f.season = 'spring') OR (fit.season = 'spring' AND f.season = 'summer')) AND fit.n >= 10)
GROUP BY ALL HAVING COUNT(*) >= 5
""", "feature_matrix"))
def m5_single(spark, sf):
    return models.seasonal_drift(b.stored_features(spark, sf), ["tmax_lag_1"])


@query("m6_extreme_split", with_inputs("""
SELECT 'train' AS part, date, region_id, need_type FROM normal WHERE place <= floor(n * 0.8)
UNION ALL SELECT 'normal', date, region_id, need_type FROM normal WHERE place > floor(n * 0.8)
UNION ALL SELECT 'extreme', date, region_id, need_type FROM feature_matrix
WHERE heatwave_flag = 1 OR coldwave_flag = 1 OR heavy_rain_flag = 1
""", "feature_matrix", normal="""
SELECT *, row_number() OVER (ORDER BY date, region_id, need_type) AS place, COUNT(*) OVER () AS n FROM feature_matrix
WHERE NOT (heatwave_flag = 1 OR coldwave_flag = 1 OR heavy_rain_flag = 1)
"""))
def m6_split(spark, sf):
    parts = models.extreme_split(b.stored_features(spark, sf), ["tmax_lag_1"])
    named = [
        df.select(F.lit(name).alias("part"), "date", "region_id", "need_type")
        for name, df in zip(("train", "normal", "extreme"), parts)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("m6_extreme_weather")
def m6(spark, sf):
    return models.extreme_weather(b.stored_features(spark, sf))


# --- evaluation -------------------------------------------------------------------------

_METRICS = f"""
SELECT model_type, split_index, {stable('sqrt(AVG(e * e))', 4)} AS rmse, {stable('AVG(abs(e))', 4)} AS mae,
       {stable('COALESCE(AVG(abs(e / actual)) FILTER (WHERE actual <> 0), 0) * 100', 2)} AS mape,
       {stable('CASE WHEN AVG(actual) <> 0 THEN sqrt(AVG(e * e)) / AVG(actual) ELSE 0 END', 4)} AS nrmse,
       {stable('AVG(abs(e / greatest(actual, 1))) * 100', 2)} AS model_mape, COUNT(*) AS n_samples
FROM (SELECT *, actual - predicted AS e FROM predictions) GROUP BY model_type, split_index
"""
_REPORT = f"""
SELECT model_type, {stable('AVG(rmse)', 4)} AS mean_rmse, {stable('stddev_pop(rmse)', 4)} AS std_rmse,
       {stable('AVG(mae)', 4)} AS mean_mae, {stable('stddev_pop(mae)', 4)} AS std_mae, {stable('AVG(mape)', 2)} AS mean_mape,
       COUNT(rmse) AS n_splits, {stable('stddev_pop(rmse)', 4)} AS stability_score FROM scores GROUP BY model_type
"""


@query("e1_e2_forecast_metrics", with_inputs(_METRICS, "predictions"))
def e1(spark, sf):
    return evaluate.forecast_metrics(b.predictions(spark, sf))


def _reports(spark, sf):
    return evaluate.stability_report(evaluate.forecast_metrics(b.predictions(spark, sf)))


@query("e3_stability_report", with_inputs(
    f"SELECT *, {stable('CASE WHEN mean_rmse = 0 THEN 0 ELSE std_rmse / mean_rmse END', 4)} AS cv_rmse FROM reports",
    "predictions", scores=_METRICS, reports=_REPORT))
def e3(spark, sf):
    return _reports(spark, sf).drop("per_split_rmse")


@query("e3_rmse_per_split", with_inputs("""
SELECT model_type, CAST(row_number() OVER (PARTITION BY model_type ORDER BY split_index) - 1 AS INTEGER) AS place, rmse FROM scores
""", "predictions", scores=_METRICS))
def e3_splits(spark, sf):
    return _reports(spark, sf).select("model_type", F.posexplode("per_split_rmse").alias("place", "rmse"))


@query("e8_stability_rating", with_inputs("""
SELECT model_type, CASE WHEN cv < 0.25 THEN 'High' WHEN cv < 0.4 THEN 'Medium' ELSE 'Low' END AS stability
FROM (SELECT model_type, std_rmse / mean_rmse AS cv FROM reports)
""", "predictions", scores=_METRICS, reports=_REPORT))
def e8(spark, sf):
    return summary.stability_rating(_reports(spark, sf)).select("model_type", "stability")


def _of(model: str, column: str) -> str:
    return f"MAX({column}) FILTER (WHERE model_type = '{model}')"


_B, _G, _V = (_of(m, "mean_rmse") for m in ("baseline_ar", "granger_selected", "var_all_weather"))
_BS, _GS = (_of(m, "std_rmse") for m in ("baseline_ar", "granger_selected"))


@query("e6_improvements", with_inputs(f"""
SELECT {stable(f'({_B} - {_G}) / nullif({_B}, 0) * 100', 1)} AS granger_vs_baseline_rmse_pct,
       {stable(f'({_BS} - {_GS}) / greatest({_BS}, 1e-6) * 100', 1)} AS granger_vs_baseline_stability_pct,
       {stable(f'({_B} - {_V}) / nullif({_B}, 0) * 100', 1)} AS var_vs_baseline_rmse_pct FROM reports
""", "predictions", scores=_METRICS, reports=_REPORT))
def e6(spark, sf):
    return evaluate.improvements(_reports(spark, sf))


@query("e7_model_comparison", with_inputs(f"""
SELECT model_type, rmse, mae, mape, nrmse, model_mape, n_samples,
       CASE WHEN model_type <> 'baseline_ar' THEN {stable('(base - rmse) / nullif(base, 0) * 100', 1)} END AS rmse_improvement_pct
FROM overall, (SELECT MAX(rmse) AS base FROM overall WHERE model_type = 'baseline_ar')
""", "predictions", overall=_METRICS.replace("model_type, split_index, ", "model_type, ").replace(
    "model_type, split_index", "model_type")))
def e7(spark, sf):
    return evaluate.model_comparison(evaluate.forecast_metrics(b.predictions(spark, sf), ["model_type"]))


_SPLITS = """
SELECT i AS split_index, start AS test_start, start + 14 AS test_end,
       (SELECT COUNT(*) FROM feature_matrix f WHERE f.date < start) AS n_train,
       (SELECT COUNT(*) FROM feature_matrix f WHERE f.date >= start AND f.date < start + 14) AS n_test
FROM (SELECT CAST(i AS INTEGER) AS i, lo + 45 + CAST(14 * i AS INTEGER) AS start, hi
      FROM (SELECT MIN(date) AS lo, MAX(date) AS hi FROM feature_matrix), range(0, 2000) AS r(i))
WHERE start + 14 <= hi
"""


@query("e4_temporal_splits", with_inputs(
    "SELECT * FROM splits WHERE n_train >= 20 AND n_test >= 5", "feature_matrix", splits=_SPLITS))
def e4(spark, sf):
    return evaluate.temporal_splits(b.feature_matrix(spark, sf))


@query("e5_rolling_baseline")
def e5(spark, sf):
    return evaluate.forecast_metrics(evaluate.rolling_linear(b.stored_features(spark, sf)), min_test=3)


@query("e5_rolling_single_regressor", with_inputs(f"""
SELECT split_index, COUNT(*) AS n_test, {stable('sqrt(AVG(e * e))', 4)} AS rmse
FROM (SELECT s.split_index, f.target_count - greatest(s.a + s.s * f.target_lag_7, 0) AS e
      FROM fits s JOIN feature_matrix f ON f.date >= s.test_start AND f.date < s.test_end)
GROUP BY split_index
""", "feature_matrix", splits=_SPLITS, fits="""
SELECT s.split_index, s.test_start, s.test_end, regr_intercept(f.target_count, f.target_lag_7) AS a,
       regr_slope(f.target_count, f.target_lag_7) AS s
FROM splits s JOIN feature_matrix f ON f.date < s.test_start
WHERE s.n_train >= 20 AND s.n_test >= 5 GROUP BY ALL
"""))
def e5_single(spark, sf):
    predicted = evaluate.rolling_linear(b.stored_features(spark, sf), ["target_lag_7"])
    return evaluate.forecast_metrics(predicted, ["split_index"]).select(
        "split_index", F.col("n_samples").alias("n_test"), "rmse")


@query("e5_rolling_trees")
def e5_trees(spark, sf):
    predicted = evaluate.rolling_trees(b.stored_features(spark, sf))
    return evaluate.forecast_metrics(predicted, min_test=3)


# --- pipelines --------------------------------------------------------------------------

@query("l3_daily_panel", with_inputs(
    ALIGNMENT, "needs_counts", "raw_weather", weather_side="SELECT * FROM raw_weather"))
def l3(spark, sf):
    report = pipelines.daily_panel(b.raw_weather(spark, sf), b.referral_feed(spark, sf))[2]
    return report.withColumn("missing_weather_states", F.array_join("missing_weather_states", ","))


@query("l5_model_comparison")
def l5(spark, sf):
    wx = b.weather_daily(spark, sf)
    features = cut_lineage(pipelines.build_features(wx, b.needs_daily(spark, sf)))
    selected = pipelines.selected_features(pipelines.causal_report(features, wx))
    return pipelines.holdout_comparison(pipelines.fit_models(features, selected)[0])


@query("l6_evaluation")
def l6(spark, sf):
    # The selection and the feature matrix read the records apart from each other.
    with ThreadPoolExecutor(1) as pool:
        selected = pool.submit(lambda: pipelines.selected_features(b.causal_results(spark, sf)))
        features = b.stored_features(spark, sf)
    found = pipelines.evaluation(features, selected.result())
    return found.select(*[F.to_json(c).alias(c) for c in found.columns])


# --- stored runs ------------------------------------------------------------------------

def _stored(spark, store, name: str):
    """Headers and rows after a run, its repetition, and an attempt that ended before its header."""
    root = _scratch(spark, "store")
    store(root)
    stored.write_rows(root, name, stored.results(spark, root, name), "unfinished")
    store(root)
    stored.write_rows(root, name, stored.results(spark, root, name), "unfinished")
    return stored.experiments(spark, root).drop("description").join(stored.results(spark, root, name), "experiment_id")


@query("l5_stored_experiments", with_inputs("""
SELECT 'run-' || o.model_type AS experiment_id, o.model_type, DATE '1990-01-01' AS train_start, test_start - 1 AS train_end,
       test_start, test_end, 0 AS split_index, rmse, mae, mape, nrmse
FROM overall o JOIN (SELECT model_type, MIN(date) AS test_start, MAX(date) AS test_end FROM predictions GROUP BY 1) d
  ON d.model_type = o.model_type
""", "predictions", overall=_METRICS.replace("model_type, split_index, ", "model_type, ").replace(
    "model_type, split_index", "model_type")))
def l5_stored(spark, sf):
    start = F.lit("1990-01-01").cast("date")
    rows = _stored(spark, lambda root: pipelines.store_holdout(root, b.predictions(spark, sf), None, start, "run"), "metrics")
    return rows.select(
        "experiment_id", "model_type", "train_start", "train_end", "test_start", "test_end", "split_index", "rmse", "mae", "mape", "nrmse")


@query("l5_stored_causal", with_inputs("""
SELECT 'run-causal' AS experiment_id, 'granger_causality' AS model_type, lo AS train_start, hi AS train_end, feature_name, lag,
       p_value, f_statistic, significant_flag, need_type, region_id
FROM causal_results, (SELECT MIN(date) AS lo, MAX(date) AS hi FROM needs_counts)
""", "causal_results", "needs_counts"))
def l5_causal(spark, sf):
    days = b.needs_daily(spark, sf)
    rows = _stored(spark, lambda root: pipelines.store_causal(root, b.causal_results(spark, sf), days, "run-causal"), "causal_results")
    return rows.select(
        "experiment_id", "model_type", "train_start", "train_end", "feature_name", "lag", "p_value", "f_statistic",
        "significant_flag", "need_type", "region_id")


@query("l6_stored_metrics", with_inputs("""
SELECT 'run-' || s.model_type AS experiment_id, 'rolling_' || s.model_type AS model_type, lo AS train_start, hi AS train_end,
       split_index, rmse, mean_mae AS mae, mean_mape AS mape, nrmse, stability_score
FROM scores s JOIN reports r ON r.model_type = s.model_type, (SELECT MIN(date) AS lo, MAX(date) AS hi FROM predictions)
""", "predictions", scores=_METRICS, reports=_REPORT))
def l6_stored(spark, sf):
    predicted = b.predictions(spark, sf)
    days = predicted.agg(F.min("date").alias("train_start"), F.max("date").alias("train_end"))
    rows = _stored(spark, lambda root: pipelines.store_rolling(root, evaluate.forecast_metrics(predicted), days, "run"), "metrics")
    return rows.select(
        "experiment_id", "model_type", "train_start", "train_end", "split_index", "rmse", "mae", "mape", "nrmse", "stability_score")


@query("s12_evaluation_summary", with_inputs(f"""
SELECT model_type, mean_rmse, std_rmse, mean_mae, std_mae, mean_mape, n_splits, stability_score,
       {stable('CASE WHEN mean_rmse = 0 THEN 0 ELSE std_rmse / mean_rmse END', 4)} AS cv_rmse, first_split,
       (SELECT {stable(f'({_B} - {_G}) / nullif({_B}, 0) * 100', 1)} FROM reports) AS granger_vs_baseline_rmse_pct
FROM reports JOIN (SELECT model_type AS m, arg_min(rmse, split_index) AS first_split FROM scores GROUP BY 1) ON m = model_type
""", "predictions", scores=_METRICS, reports=_REPORT))
def evaluation_summary(spark, sf):
    """The improvements and reports of an evaluation, written as JSON and read again."""
    reports = _reports(spark, sf)
    packed = reports.agg(F.array_sort(F.collect_list(F.struct("*")))).scalar()
    found = evaluate.improvements(reports).select(F.struct("*").alias("improvements"), packed.alias("stability_reports"))
    path = _scratch(spark, "summary")
    tables.write_summary(found, path)
    back = tables.read_summary(spark, path, found.schema)
    rows = back.select("improvements", F.inline("stability_reports"))
    return rows.withColumn("first_split", F.col("per_split_rmse")[0]).withColumn(
        "granger_vs_baseline_rmse_pct", F.col("improvements")["granger_vs_baseline_rmse_pct"]).drop("improvements", "per_split_rmse", "std_rmse").withColumn("std_rmse", F.col("stability_score"))
