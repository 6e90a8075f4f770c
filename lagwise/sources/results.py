"""Stored experiments: headers, and the rows that belong to them, visible as a whole or not at all.

Rows are written first, in folders of their experiment and attempt. The header comes last and names the attempt; readers take
only rows whose attempt a header names. So a run that ends half-way leaves nothing that is seen, a repeated run
replaces the one before at the moment its header is written, and what older attempts left is then removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.schemas import CAUSAL_RESULTS, EXPERIMENTS, METRICS
from lagwise.session import cut_lineage, exists, remove

PARTS = {"causal_results": CAUSAL_RESULTS, "metrics": METRICS}
OWNER = ["experiment_id", "attempt"]


def shaped(rows: DataFrame, schema) -> DataFrame:
    """The columns of a stored table; those that `rows` lacks are NULL."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_rows(root: str, name: str, rows: DataFrame, attempt: str) -> None:
    """Rows of one stored table, unseen until a header names the attempt."""
    marked = shaped(rows, PARTS[name]).withColumn("attempt", F.lit(attempt))
    marked.write.mode("append").partitionBy(*OWNER).parquet(f"{root}/{name}")


def store_experiments(spark: SparkSession, root: str, headers: DataFrame, parts: dict[str, DataFrame]) -> None:
    """Store experiments, one header row each, with the rows that carry their ids."""
    attempt = uuid4().hex
    headers = cut_lineage(shaped(headers, EXPERIMENTS).withColumn("attempt", F.lit(attempt)))
    for name, rows in parts.items():
        write_rows(root, name, rows, attempt)
    # Only the folders of these experiments are replaced.
    headers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(f"{root}/experiments")
    _remove_older(spark, root, [r["experiment_id"] for r in headers.select("experiment_id").collect()], attempt)


def _remove_older(spark: SparkSession, root: str, ids: Sequence[str], attempt: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in PARTS:
        for experiment in ids:
            folder = hadoop.Path(f"{root}/{name}/experiment_id={_escaped(spark, experiment)}")
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for held in files.listStatus(folder) if files.exists(folder) else []:
                if held.getPath().getName() != f"attempt={attempt}":
                    remove(spark, held.getPath().toString())


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _read(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", attempt string"
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(f"{root}/{name}")


def experiments(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "experiments", EXPERIMENTS).drop("attempt")


def results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of committed experiments; the headers prune the folders that are read."""
    named = _read(spark, root, "experiments", EXPERIMENTS).select(*OWNER)
    return _read(spark, root, name, PARTS[name]).join(named, OWNER, "left_semi").drop("attempt")


def header(ids: Column, model_type: Column, description: Column, params: Column | None = None, **dates: Column) -> list[Column]:
    """Columns of a header row; the scope is all categories in all regions."""
    return [
        ids.alias("experiment_id"), model_type.alias("model_type"), F.lit("all_need_types").alias("target"),
        F.lit("all_states").alias("region_scope"), *[c.alias(n) for n, c in dates.items()],
        (F.lit(None).cast("string") if params is None else params).alias("params_json"), description.alias("description"),
    ]
