"""Stationarity, Granger causality and cross-correlation per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.expressions import round_half_even
from lagwise.functions.moments import PAIR_MOMENTS, PAIR_TYPES, merged_correlations
from lagwise.functions.statistics import lag_moments, nested_f_test, unit_root_test
from lagwise.operators.needs import SERIES
from lagwise.operators.summary import smallest_p
from lagwise.schemas import ALWAYS_SELECTED, WEATHER_LAGS

# Test horizon, level, and the level used when nothing is significant.
MAX_LAG = 15
SIGNIFICANCE = 0.05
RELAXED = 0.20
FALLBACK_ROWS = 20
# Rows of a group that one task looks at.
PIECE_ROWS = 50_000
VARIABLES = ["max_temp", "precip"]
LAG_PREFIX = {"max_temp": "tmax", "precip": "prcp"}


def unit_root_tests(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = tuple(SERIES), order: str = "date",
                    significance: float = SIGNIFICANCE, lags: int | None = None, digits: int = 4) -> DataFrame:
    """Augmented Dickey–Fuller test per series and column, with a given number of lags or the best by AIC.

    A group is one daily series, at most one row per date. A test that cannot be carried out
    counts as not stationary.
    """
    key_names, fixed = list(keys), lags
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(*keys, order, F.inline(F.array(*pairs)))

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        result = unit_root_test(rows.sort_values(order)["value"].to_numpy(), fixed)
        statistic, p, used = result if result else (None, None, 0)
        outcome = (statistic, p, p is not None and p < significance, used)
        return pd.DataFrame([(*key, *outcome)], columns=[*key_names, "variable", *names])

    names = ["adf_stat", "p_value", "is_stationary", "n_lags_used"]
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in key_names)
    schema = f"{key_types}, variable string, adf_stat double, p_value double, is_stationary boolean, n_lags_used int"
    tested = long.groupBy(*keys, "variable").applyInPandas(test, schema)
    return tested.withColumns({
        "adf_stat": round_half_even(F.col("adf_stat"), digits), "p_value": round_half_even(F.col("p_value"), 6),
    })


def stationary_pairs(df: DataFrame, variables: Sequence[str] = tuple(VARIABLES), target: str = "target_count",
                     keys: Sequence[str] = tuple(SERIES), make_stationary: bool = True, min_rows: int = 0) -> DataFrame:
    """Rows (keys, feature_name, date, y, x): target and predictor, differenced where needed.

    Both are cut to the rows they share. Series with fewer than `min_rows` rows are left out.
    """
    series = Window.partitionBy(*keys)
    df = df.withColumn("_n", F.count(F.lit(1)).over(series)).filter(F.col("_n") >= min_rows)
    level = {c: F.col(c).cast("double") for c in [target, *variables]}
    value = level
    if make_stationary:
        tested = unit_root_tests(df, [target, *variables], keys)
        known = F.map_from_entries(F.collect_list(F.struct("variable", "is_stationary")))
        df = df.join(tested.groupBy(*keys).agg(known.alias("_stationary")), list(keys))
        w = series.orderBy("date")
        value = {
            c: F.when(F.col("_stationary")[c], level[c]).otherwise(level[c] - F.lag(level[c], 1).over(w)) for c in level
        }
    wide = df.select(*keys, "date", *[v.alias(f"_v_{c}") for c, v in value.items()])
    pairs = [
        F.struct(F.lit(c).alias("feature_name"), F.col(f"_v_{target}").alias("y"), F.col(f"_v_{c}").alias("x"))
        for c in variables
    ]
    return wide.select(*keys, "date", F.inline(F.array(*pairs))).filter("y IS NOT NULL AND x IS NOT NULL")


def lag_products(pairs: DataFrame, keys: Sequence[str], max_lag: int) -> DataFrame:
    """One row per series: sums of lagged products, and the first and last `max_lag` values.

    These determine the moment matrix of every lag length up to `max_lag`. The columns are
    centred first; windows and sums share the partitioning by series.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("date")
    centred = pairs.withColumns({
        "n": F.count(F.lit(1)).over(whole), "at": F.row_number().over(w),
        "y": F.col("y") - F.avg("y").over(whole), "x": F.col("x") - F.avg("x").over(whole),
    })
    # Enough rows for the longest lag: the test needs more than three per lag and some spare.
    enough = centred.filter((F.col("n") >= max_lag + 10) & (F.col("n") > 3 * max_lag + 1))
    lagged = enough.withColumns({
        f"{c}{k}": F.lag(c, k).over(w) for c in "yx" for k in range(1, max_lag + 1)
    }).withColumnsRenamed({"y": "y0", "x": "x0"})
    products = {
        f"{a}{b}": F.array(*[F.sum(F.col(f"{a}0") * F.col(f"{b}{k}")) for k in range(max_lag + 1)])
        for a in "yx" for b in "yx"
    }
    recent = {c: F.array(*[F.col(f"{c}{k}") for k in reversed(range(max_lag))]) for c in "yx"}
    return lagged.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[p.alias(name) for name, p in products.items()],
        *[F.sum(f"{c}0").alias(f"sum_{c}") for c in "yx"],
        *[F.max(F.when(F.col("at") == max_lag, recent[c])).alias(f"head_{c}") for c in "yx"],
        *[F.max(F.when(F.col("at") == F.col("n"), recent[c])).alias(f"tail_{c}") for c in "yx"],
    )


def granger_tests(df: DataFrame, variables: Sequence[str] = tuple(VARIABLES), max_lag: int = MAX_LAG,
                  significance: float = SIGNIFICANCE, target: str = "target_count",
                  keys: Sequence[str] = tuple(SERIES), make_stationary: bool = True) -> DataFrame:
    """F-test, per series, variable and lag, of whether the variable's past helps to predict the target.

    The rows are reduced to lagged sums inside Spark; only one summary row per series reaches
    Python, for solves of at most 2 * max_lag + 1 columns.
    """
    pairs = stationary_pairs(df, variables, target, keys, make_stationary, min_rows=max_lag + 10)
    key_names = [*keys, "feature_name"]
    summaries = lag_products(pairs, key_names, max_lag)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                products = {a + b: np.asarray(getattr(row, a + b)) for a in "yx" for b in "yx"}
                head = {c: np.asarray(getattr(row, f"head_{c}")) for c in "yx"}
                tail = {c: np.asarray(getattr(row, f"tail_{c}")) for c in "yx"}
                sums = {c: getattr(row, f"sum_{c}") for c in "yx"}
                key = tuple(getattr(row, k) for k in key_names)
                for lag in range(1, max_lag + 1):
                    short = {c: head[c][:lag] for c in head}
                    moments, rows = lag_moments(products, short, tail, sums, int(row.n), lag)
                    tested = nested_f_test(moments, rows, lag)
                    if tested:
                        out.append((*key, lag, *tested))
            yield pd.DataFrame(out, columns=[*key_names, "lag", "f", "p"])

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summaries.schema if f.name in key_names)
    tested = summaries.mapInPandas(solve, f"{key_types}, lag int, f double, p double")
    return tested.select(
        *key_names, "lag",
        round_half_even(F.col("p"), 6).alias("p_value"),
        round_half_even(F.col("f"), 4).alias("f_statistic"),
        round_half_even(1 - F.col("p"), 4).alias("effect_strength"),
        F.when(F.col("p") < significance, 1).otherwise(0).alias("significant_flag"),
    )


def _any_significant(results: DataFrame):
    return F.coalesce(results.agg(F.max("significant_flag")).scalar(), F.lit(0)) == 1


def significant_lags(results: DataFrame, relaxed: float = RELAXED) -> DataFrame:
    """Rows (feature_name, lags): significant lags in order, or those below the relaxed level if none is."""
    some = _any_significant(results)
    chosen = results.filter((some & (F.col("significant_flag") == 1)) | (~some & (F.col("p_value") < relaxed)))
    return chosen.groupBy("feature_name").agg(F.array_sort(F.collect_set("lag")).alias("lags"))


def stored_significant_lags(results: DataFrame, relaxed: float = RELAXED, top: int = FALLBACK_ROWS) -> DataFrame:
    """The same from stored results: distinct significant lags, else those of the smallest p-values.

    The fallback keeps the order of p and repeats a lag as often as it appears.
    """
    flagged = results.filter("significant_flag = 1").select("feature_name", "lag").distinct()
    flagged = flagged.select("feature_name", "lag", F.col("lag").cast("double").alias("place"))
    best = smallest_p(results.select("p_value", "feature_name", "lag"), top, below=relaxed)
    best = best.filter(~_any_significant(results)).select("feature_name", "lag", F.col("p_value").alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "lag")))
    return flagged.unionByName(best).groupBy("feature_name").agg(
        F.transform(ordered, lambda s: s["lag"]).alias("lags"))


def select_lag_features(lags: DataFrame, available: Sequence[int] = tuple(WEATHER_LAGS),
                        always: Sequence[str] = tuple(ALWAYS_SELECTED)) -> DataFrame:
    """Rows (feature): each lag's nearest available lag column, the smaller at a tie, and the fixed ones."""
    wanted = lags.filter(F.col("feature_name").isin(list(LAG_PREFIX))).select(
        "feature_name", F.explode("lags").alias("lag"))
    distances = F.transform(
        F.array(*[F.lit(a) for a in available]), lambda a: F.struct(F.abs(a - F.col("lag")).alias("d"), a.alias("a")))
    prefix = F.when(F.col("feature_name") == "max_temp", LAG_PREFIX["max_temp"]).otherwise(LAG_PREFIX["precip"])
    nearest = F.concat(prefix, F.lit("_lag_"), F.array_min(distances)["a"].cast("string"))
    fixed = lags.sparkSession.createDataFrame([(f,) for f in always], "feature string")
    return wanted.select(nearest.alias("feature")).unionByName(fixed).distinct()


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, halo: int) -> DataFrame:
    """Rows with `_n` (rows of the group), `_at` (place in it, from 0) and `_piece`, each piece with the `halo` rows before it.

    Rows are counted per group and first order column; only the counts of a group are added up in order, so a group
    may be longer than one task. `size` is at least `halo`, so a halo never reaches beyond the piece before.
    """
    first, rest = order[0], list(order[1:])
    counts = df.groupBy(*keys, first).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*keys, first, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n"))
    inner = Window.partitionBy(*keys, first).orderBy(*(rest or [first]))
    rows = df.withColumn("_at", F.row_number().over(inner) - 1).join(placed, [*keys, first])
    rows = rows.withColumn("_at", F.col("_at") + F.col("_before")).drop("_before")
    own = F.floor(F.col("_at") / size).cast("int")
    feeds = F.when((F.col("_at") % size >= size - halo) & ((own + 1) * size < F.col("_n")), F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_piece", F.explode(feeds))


def cross_correlations(df: DataFrame, variable: str = "max_temp", target: str = "target_count", max_lag: int = 30,
                       keys: Sequence[str] = tuple(SERIES), order: Sequence[str] = ("date",), piece: int = PIECE_ROWS) -> DataFrame:
    """Rows (lag, mean_corr, std_corr): correlation of the lagged variable with the target, over groups.

    Lags count rows in the given order. A group is cut into pieces that bring the `max_lag` rows before them along; each piece gives
    sums of products per lag, which add up to those of the group. Groups shorter than `max_lag` + 5 rows and
    undefined correlations are left out.
    """
    names, size = list(keys), max(piece, max_lag)
    values = df.select(*keys, *order, F.col(target).cast("double").alias("_y"), F.col(variable).cast("double").alias("_x"))
    long_enough = in_pieces(values, names, order, size, max_lag).filter(F.col("_n") >= max_lag + 5)

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        x, y, at = (rows[c].to_numpy() for c in ("_x", "_y", "_at"))
        begin = int(np.searchsorted(at, key[-1] * size))  # the halo stands before
        out = []
        for lag in range(max_lag + 1):
            here = np.arange(max(begin, lag), len(x))
            a, b = x[here - lag], y[here]
            both = ~(np.isnan(a) | np.isnan(b))
            a, b = a[both], b[both]
            # Moments about the piece's own means; merging them needs no large sums.
            n, ma, mb = len(a), a.mean() if len(a) else 0.0, b.mean() if len(a) else 0.0
            out.append((*key[:-1], lag, n, ma, mb, ((a - ma) ** 2).sum(), ((b - mb) ** 2).sum(), ((a - ma) * (b - mb)).sum()))
        return pd.DataFrame(out, columns=[*names, "lag", *PAIR_MOMENTS])

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in names)
    pieces = long_enough.groupBy(*keys, "_piece").applyInPandas(sums, f"{key_types}, lag int, {PAIR_TYPES}")
    groups = merged_correlations(pieces, [*names, "lag"]).filter("corr IS NOT NULL")
    return groups.groupBy("lag").agg(F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("std_corr"))
