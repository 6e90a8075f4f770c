"""Parquet tables: scans, full refresh, keep-last merge, insert-or-ignore, result appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.windows import keep_one
from lagwise.session import cut_lineage


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, or the columns of it that are wanted; order belongs to windows, not to scans."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def merge_last(base: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Rows of both, keeping per key the one with the highest sequence."""
    return keep_one(base.unionByName(new), keys, [F.col(sequence).desc()])


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], sequence: str,
                 partition_by: Sequence[str] = ()) -> None:
    """Merge new rows into a stored table, last row per key wins.

    The result is checkpointed before the table it was read from is overwritten. With
    partition columns only the partitions that receive rows are read and rewritten, unless a key
    moves to another partition: then the whole table is, so that its old row goes.
    """
    base = scan_if_present(spark, path)
    if base is None:
        replace_table(keep_one(new, keys, [F.col(sequence).desc()]), path, partition_by)
        return
    some = bool(partition_by) and not _moves(base, new, keys, partition_by)
    if some:
        touched = new.select(*partition_by).distinct()
        base = base.join(touched, list(partition_by), "left_semi")
    merged = cut_lineage(merge_last(base, new.select(*base.columns), keys, sequence))
    writer = merged.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic" if some else "static").partitionBy(*partition_by)
    writer.parquet(path)


def _moves(base: DataFrame, new: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> bool:
    """Whether a stored key comes in for another partition; impossible where the partition is part of the key."""
    outside = [c for c in partition_by if c not in keys]
    if not outside:
        return False
    incoming = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in outside]).distinct()
    other = [~F.col(c).cast("string").eqNullSafe(F.col(f"_new_{c}").cast("string")) for c in outside]
    pairs = base.select(*keys, *outside).join(incoming, list(keys))
    return not pairs.filter(reduce(lambda a, b: a | b, other)).isEmpty()


def insert_new(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The rows to append: the first per key among those whose key is not stored yet."""
    return keep_one(new, keys, order).join(base.select(*keys), list(keys), "left_anti")


def insert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: Sequence) -> None:
    base = scan_if_present(spark, path)
    rows = keep_one(new, keys, order) if base is None else insert_new(base, new, keys, order)
    rows.write.mode("append").parquet(path)


def store_results(rows: DataFrame, path: str, experiment_id: str) -> None:
    """Add the rows of one experiment.

    The table is partitioned by experiment and only that partition is replaced, so a
    retried write with the caller's same id does not double the rows.
    """
    (
        rows.withColumn("experiment_id", F.lit(experiment_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("experiment_id").parquet(path)
    )


def experiment_header(spark: SparkSession, experiment_id: str, model_type: str, train_start, train_end,
                      test_start=None, test_end=None, params_json: str | None = None,
                      description: str | None = None) -> DataFrame:
    row = (experiment_id, model_type, "all_need_types", "all_states", train_start, train_end,
           test_start, test_end, params_json, description)
    return spark.createDataFrame(
        [row],
        "experiment_id string, model_type string, target string, region_scope string, train_start date, "
        "train_end date, test_start date, test_end date, params_json string, description string",
    )


def export_features(df: DataFrame, path: str) -> None:
    """Feature export laid out by region, so a series lookup reads one folder.

    Rows are spread by region and month before the write: a region with many rows is
    written by many tasks.
    """
    spread = df.repartition("region_id", F.trunc(F.col("date").cast("date"), "month"))
    spread.write.mode("overwrite").partitionBy("region_id").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.repartition(1).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, n_rows) for every table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out
