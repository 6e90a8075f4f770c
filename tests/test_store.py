"""Referral files, table writes, results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lagwise.sources import referrals, tables

FULL = (
    "﻿REF_ID,REF_CODE,REF_DATE,ZIPCODE,STATE,CATEGORY,Age,RISK_SCORE,SUBCATEGORY,DOB,ASSESSING_ORG,DAYS_TO_CONFIRM\n"
    "1, C1 ,2025-01-02 03:04:05,90001,CA,Food,12.7,3.5,\"two\nlines, \"\"quoted\"\"\",1990-01-01,Org,4\n"
    "2,,2025-01-03,90001,,Other,x,,plain,1990-01-01,Org,\n"
    "3,C3,,90001,CA,Food,5,,no date,,,\n"
    "4,C4,2025-01-04,10001,NY,  ,5,,blank category,,,\n"
)
CORE = "REF_ID,REF_CODE_x,REF_DATE,ZIPCODE,STATE,CATEGORY\n5,X5,2025-01-05,90001,NV,Food\n6,X6,2025-01-06,77777,,Food\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    (folder / "full.csv").write_text(FULL, encoding="utf-8")
    (folder / "core.csv").write_text(CORE, encoding="utf-8")
    return [str(folder / n) for n in ("full.csv", "absent.csv", "core.csv")]


def test_ingest(spark, files):
    df = referrals.ingest_referrals(spark, files)
    assert not {"dob", "assessing_org"} & {c.lower() for c in df.columns}
    rows = {r["ref_id"]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "5", "6"}
    assert rows["1"]["subcategory"] == 'two\nlines, "quoted"'
    assert (rows["1"]["age"], rows["1"]["risk_score"], rows["1"]["ref_code"]) == (12, 3.5, "C1")
    assert (rows["2"]["age"], rows["2"]["ref_code"], rows["2"]["region_id"]) == (None, None, "CA")
    assert (rows["5"]["ref_code"], rows["5"]["region_id"], rows["5"]["age"]) == ("X5", "NV", None)
    assert rows["6"]["region_id"] is None
    assert rows["5"]["source_file"] == "core.csv"


def test_first_state_per_zip_wins(spark, files):
    lookup = {r["zipcode"]: r["state"] for r in referrals.region_lookup(referrals.scan_files(spark, files)).collect()}
    assert lookup == {"90001": "CA", "10001": "NY"}


def test_report(spark, files):
    got = {r["filename"]: tuple(r)[1:] for r in referrals.ingest_report(referrals.scan_files(spark, files)).collect()}
    assert got == {"full.csv": (4, 2, 2), "core.csv": (2, 2, 0)}


def test_splittable_read_gives_the_same_rows(spark, files):
    a = referrals.ingest_referrals(spark, files[2:], multi_line=True).drop("row_seq").collect()
    b = referrals.ingest_referrals(spark, files[2:], multi_line=False).drop("row_seq").collect()
    assert sorted(a) == sorted(b)


def test_many_files_are_few_jobs(spark, tmp_path):
    for i in range(60):
        name = "REF_CODE" if i % 3 else "REF_CODE_x"
        (tmp_path / f"f{i:02d} .csv").write_text(f"REF_ID,{name},REF_DATE,ZIPCODE,STATE,CATEGORY,REF_ID\n{i},c{i},2025-01-01,{i % 5},S{i},Food,again\n")
    (tmp_path / "empty.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("many", "many")
    try:
        paths = [str(tmp_path / f"f{i:02d} .csv") for i in reversed(range(60))] + [str(tmp_path / "empty.csv")]
        df = referrals.scan_files(spark, paths)
        assert len(sc.statusTracker().getJobIdsForGroup("many")) <= 2
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    rows = df.orderBy("row_seq").collect()
    assert [r["REF_ID"] for r in rows] == [str(i) for i in reversed(range(60))]
    assert all((r["REF_CODE"] or r["REF_CODE_x"]) == f"c{r['REF_ID']}" for r in rows)
    # The file listed first decides the state of a zip code, and a folder counts in the order of its names.
    assert {r["zipcode"]: r["state"] for r in referrals.region_lookup(df).collect()} == {str(k): f"S{55 + k}" for k in range(5)}
    folder = referrals.region_lookup(referrals.scan_files(spark, [str(tmp_path)])).collect()
    assert {r["zipcode"]: r["state"] for r in folder} == {str(k): f"S{k}" for k in range(5)}


def test_no_file_at_all(spark):
    with pytest.raises(FileNotFoundError):
        referrals.scan_files(spark, ["/tmp/absent-a.csv"])


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "k int, part string, v string, seq long")
    tables.upsert_table(spark, path, rows([(1, "a", "old", 1), (2, "b", "old", 1), (1, "a", "older", 0)]), ["k"], "seq", ["part"])
    before = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).where("part = 'b'").collect()}
    tables.upsert_table(spark, path, rows([(1, "a", "new", 2), (3, "a", "new", 2)]), ["k"], "seq", ["part"])
    stored = spark.read.parquet(path)
    assert {(r["k"], r["v"]) for r in stored.collect()} == {(1, "new"), (2, "old"), (3, "new")}
    assert {r[0] for r in stored.select(F.input_file_name()).where("part = 'b'").collect()} == before


def test_insert_ignores_existing_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "k int, v string, seq long")
    tables.insert_table(spark, path, rows([(1, "a", 2), (1, "b", 1)]), ["k"], [F.col("seq")])
    tables.insert_table(spark, path, rows([(1, "c", 3), (2, "d", 5), (2, "e", 4)]), ["k"], [F.col("seq")])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "b"), (2, "e")}


def test_retried_result_write_does_not_double(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("max_temp", 3, 0.01)], "feature_name string, lag int, p_value double")
    for run in ("one", "two", "one"):
        tables.store_results(rows, path, run)
    assert spark.read.parquet(path).count() == 2
    header = tables.experiment_header(spark, "one", "granger_causality", date(2025, 1, 1), date(2025, 7, 31))
    assert header.columns[0] == "experiment_id" and header.count() == 1


def test_json_summary_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 1.5D AS a, array(1, 2) AS b, named_struct('c', 'x') AS d")
    tables.write_summary(df, str(tmp_path / "s"))
    assert tables.read_summary(spark, str(tmp_path / "s"), df.schema).collect() == df.collect()


def test_partitioned_export_is_pruned(spark, tmp_path):
    df = spark.range(20).select(
        F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.when(F.col("id") % 2 == 0, "CA").otherwise("NY").alias("region_id"))
    path = str(tmp_path / "f")
    tables.export_features(df, path)
    one = spark.read.parquet(path).filter("region_id = 'CA'")
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(region_id" in one._jdf.queryExecution().executedPlan().toString()


def test_upsert_moves_a_key_to_another_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "k int, part string, v string, seq long")
    tables.upsert_table(spark, path, rows([(1, "x", "old", 1), (2, "z", "old", 1)]), ["k"], "seq", ["part"])
    tables.upsert_table(spark, path, rows([(1, "y", "new", 2)]), ["k"], "seq", ["part"])
    stored = {(r["k"], r["part"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert stored == {(1, "y", "new"), (2, "z", "old")}


def test_rows_of_a_file_are_not_brought_together(spark, files):
    plan = referrals.scan_files(spark, files)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_large_feed_is_many_files_of_two_kinds(spark, tmp_path, monkeypatch):
    from lagwise.plans import catalog_results as catalog

    orders = [(i, i % 7, "FOP"[i % 3], f"{1 + i % 5}-X", date(2025, 1, 1 + i % 28)) for i in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, i % 3) for i in range(7)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(catalog, "FILE_ROWS", 100, raising=False)
    per_kind = {}
    for name, _, line, _ in referrals.listed_files(spark, catalog._csv_feed(spark, str(tmp_path), files=1)):
        per_kind.setdefault(line, []).append(name)
    assert [len(names) for names in per_kind.values()] == [4, 4]
    got = catalog.QUERIES["s1_ingest_report"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(400, 267, 133, 2)]


HARD = [
    '1,C1,2025-01-02,90001,CA,Food,1,2,"two\nlines, ""quoted""\n\n",x', '2,C2,2025-01-03,90002,"NV",Food,1,2,"",', "",
    '3,"",2025-01-03,9"0"3,CA,5" pipe,1,2,a "b" c,', '4,C4,2025-01-04,90004,CA,"Food"" and\n""more""",1,2,"' + "long\n,\"\"" * 40 + '",end',
    '5,"C\n5",2025-01-05', '6,C6,2025-01-06,90006,CA,Food,1,2,é ü "x\ny",', '"7",C7,"2025-01-07",90007,CA,Food,1,2,"""\n""",more,than,there',
]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", ["16", "61", "1m"])
def test_large_files_are_read_by_many_tasks(spark, tmp_path, end, block):
    """Files cut at any place give the rows that Spark's reader of whole files gives, in order, whatever their fields hold."""
    from lagwise.sources.records import large_records

    head = "REF_ID,REF_CODE,REF_DATE,ZIPCODE,STATE,CATEGORY,Age,RISK_SCORE,SUBCATEGORY,LOB"
    paths = []
    for i in range(2):
        paths.append(str(tmp_path / f"big {i}.csv"))
        with open(paths[-1], "w", encoding="utf-8", newline="") as f:
            f.write((end.join([head, *HARD[i:], *HARD]) + (end if i else "")).replace("\r\n", "\n").replace("\n", end))
    names = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    whole = [tuple(r)[:-1] for r in referrals.scan_files(spark, paths).orderBy("row_seq").collect()]
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        cut = [tuple(r)[:-1] for r in referrals.scan_files(spark, paths, whole_bytes=0).orderBy("row_seq").collect()]
        n_blocks = large_records(spark, paths).select("path", "block").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(whole) > 13 and cut == whole
    assert n_blocks > (8 if block != "1m" else 1)
