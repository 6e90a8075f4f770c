"""Referral CSV feeds: header-keyed scan, typed rows, region lookup."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions.expressions import blank_to_null, strip, tolerant_double, tolerant_int
from lagwise.operators.needs import require_fields
from lagwise.operators.windows import keep_one
from lagwise.schemas import REFERRAL_OTHER, REFERRAL_TEXT
from lagwise.sources.records import large_records

HEADERS = [*REFERRAL_TEXT, *REFERRAL_OTHER]
# Bytes of a file that one task may read.
WHOLE_BYTES = 128 << 20


def listed_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, str, int]]:
    """(file, its URI, first line, bytes) of every file named or lying in a folder named, in list order; what is absent or empty is left out.

    Spark's file systems list the files and read the one line; only that comes to the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(conf)
        if not files.exists(place):
            continue
        for status in sorted(files.listStatus(place), key=lambda s: s.getPath().getName()):
            if status.isFile() and status.getLen() and status.getPath().getName()[0] not in "._":
                stream = files.open(status.getPath())
                try:
                    line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
                finally:
                    stream.close()
                found.append((status.getPath().toString(), status.getPath().toUri().toString(), line, status.getLen()))
    return found


def _one_slash(path: str) -> str:
    """A URI as both listings and Spark's metadata can be brought to write it."""
    return re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", path)


def _with_one_slash() -> Column:
    return F.regexp_replace(F.col("path"), "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _read(spark: SparkSession, group: list[str], columns: int, multi_line: bool) -> DataFrame:
    """Text columns `_0`, `_1` and so on by place, with source_file, path, block and row."""
    schema = ", ".join(f"_{i} string" for i in range(columns))
    raw = spark.read.schema(schema).csv(group, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8")
    return raw.select(
        *[f"_{i}" for i in range(columns)], F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _read_large(spark: SparkSession, group: dict[str, str], columns: int) -> DataFrame:
    """The same of files, with their names, that are too large for one task."""
    schema = ", ".join(f"_{i} string" for i in range(columns))
    parsed = large_records(spark, list(group)).withColumn("_c", F.from_csv("record", schema, {"quote": '"', "escape": '"'}))
    named = spark.createDataFrame([(_one_slash(uri), uri.rpartition("/")[2]) for uri in group.values()], "path string, source_file string")
    return parsed.withColumn("path", _with_one_slash()).join(F.broadcast(named), "path").select(
        "_c.*", "source_file", "path", "block", "row")


def scan_files(spark: SparkSession, paths: Sequence[str], multi_line: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """All files that exist, as text columns.

    Only the known headers are taken, so names, organisations and birth dates never enter the plan; headers that a file
    lacks become NULL. Files of equal headers are one read, however many they are. `row_seq` orders rows as they were listed:
    file, block, position. Quoted line breaks need `multi_line`: Spark then reads each file in one task, and those above
    `whole_bytes` are cut into records by `large_records`. Feeds known to have no such breaks can switch it off.
    """
    files = listed_files(spark, paths)
    if not files:
        raise FileNotFoundError(f"none of the files exists: {list(paths)}")
    alike: dict[tuple[bool, tuple[str, ...]], dict[str, str]] = {}
    for path, uri, line, size in files:
        large = multi_line and size > whole_bytes
        alike.setdefault((large, tuple(next(csv.reader([line.lstrip("\ufeff")])))), {})[path] = uri
    ranks = spark.createDataFrame([(_one_slash(uri), i) for i, (_, uri, _, _) in enumerate(files)], "path string, file_rank int")
    out = None
    for (large, names), group in alike.items():
        # Names by place, since headers may repeat; the first of equal ones counts.
        raw = _read_large(spark, group, len(names)) if large else _read(spark, list(group), len(names), multi_line)
        wanted = [(F.col(f"_{names.index(h)}") if h in names else F.lit(None).cast("string")).alias(h) for h in HEADERS]
        part = raw.select(*wanted, "source_file", _with_one_slash().alias("path"), "block", "row")
        out = part if out is None else out.unionByName(part)
    # The files were listed here, so their ranks can be sent to every task; a shuffle would bring all rows of a file together.
    return out.join(F.broadcast(ranks), "path").select(*HEADERS, "source_file", F.struct("file_rank", "block", "row").alias("row_seq"))


def region_lookup(raw: DataFrame) -> DataFrame:
    """One state per zip code: the first seen, in file and row order."""
    pairs = raw.select(
        blank_to_null(F.col("ZIPCODE")).alias("zipcode"), blank_to_null(F.col("STATE")).alias("state"), "row_seq"
    ).dropna(subset=["zipcode", "state"])
    nothing = F.lit(None).cast("string")
    return keep_one(pairs, ["zipcode"], [F.col("row_seq")]).select(
        F.col("zipcode").alias("region_id"), "zipcode", nothing.alias("county_fips"),
        nothing.alias("county_name"), "state", F.lit("").alias("city"),
    )


def zip_to_state(lookup: DataFrame) -> DataFrame:
    return lookup.select("zipcode", F.col("state").alias("zip_state"))


def add_region(df: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """Region is the state, else the state of the zip code, else NULL.

    Rows with a state are not shuffled. Of the others only those with a zip code are joined; whether
    the lookup is small enough to broadcast is left to Spark to judge.
    """
    if lookup is None:
        return df.withColumn("region_id", F.col("state"))
    wanted = F.col("state").isNull() & F.col("zipcode").isNotNull()
    plain = df.filter(~wanted).withColumn("region_id", F.col("state"))
    joined = df.filter(wanted).join(zip_to_state(lookup), "zipcode", "left")
    return plain.unionByName(joined.withColumn("region_id", F.col("zip_state")).drop("zip_state"))


def parse_referrals(raw: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Typed referral rows; rows without a date or a category are left out."""
    rows = require_fields(raw, ["REF_DATE", "CATEGORY"]).select(
        *[blank_to_null(F.col(h)).alias(name) for h, name in REFERRAL_TEXT.items()],
        blank_to_null(
            F.when(F.length("REF_CODE") > 0, F.col("REF_CODE")).otherwise(F.col("REF_CODE_x"))
        ).alias("ref_code"),
        strip(F.col("REF_DATE")).alias("ref_date"),
        blank_to_null(F.col("ZIPCODE")).alias("zipcode"),
        blank_to_null(F.col("STATE")).alias("state"),
        strip(F.col("CATEGORY")).alias("category"),
        tolerant_int(F.col("Age")).alias("age"),
        tolerant_double(F.col("RISK_SCORE")).alias("risk_score"),
        tolerant_double(F.col("DAYS_TO_CONFIRM")).alias("days_to_confirm"),
        "source_file",
        "row_seq",
    )
    return add_region(rows, lookup)


def ingest_report(raw: DataFrame) -> DataFrame:
    """Per file: rows read, rows taken, rows left out."""
    good = (F.length(strip(F.col("REF_DATE"))) > 0) & (F.length(strip(F.col("CATEGORY"))) > 0)
    return raw.groupBy(F.col("source_file").alias("filename")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(good).alias("ingested"),
        (F.count(F.lit(1)) - F.count_if(good)).alias("skipped"),
    )


def ingest_referrals(spark: SparkSession, paths: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Region lookup and typed rows of a list of files."""
    raw = scan_files(spark, paths, multi_line)
    return parse_referrals(raw, region_lookup(raw))
