"""Dedupe policies W1-W3 and the date-scoped scan on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobacct.sources import store as ST
from jobacct.sources.accounting import read_accounting_day


def test_three_dedupe_policies(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    silver = spark.createDataFrame(
        [("1", "RUNNING", t(2), "2024-01-01"), ("1", "COMPLETED", t(3), "2024-01-01"), ("2", "PENDING", None, "2024-01-02"),
         ("2", "FAILED", t(5), "2024-01-03")],
        "job_id string, state string, processed_date timestamp, job_date string",
    )
    w1 = {r.job_id: r.state for r in ST.latest_per_job(silver).collect()}
    assert w1 == {"1": "COMPLETED", "2": "PENDING"}  # null processing time sorts first when descending
    w3 = {r.job_id: r.state for r in ST.dedupe_newest_date(silver).collect()}
    assert w3 == {"1": "COMPLETED", "2": "FAILED"}
    seq = lambda p: F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(p).cast("long").alias("pos"))
    raw = spark.createDataFrame([("9", "A", "2024-01-02", 1), ("9", "B", "2024-01-01", 2), ("9", "C", "2024-01-01", 3)],
                                "JobIDRaw string, State string, job_date string, p long")
    raw = raw.withColumn("seq", seq(F.col("p")))
    assert [r.State for r in ST.dedupe_raw(raw).collect()] == ["C"]  # oldest date, then the later line


def test_read_accounting_day(spark):
    b = spark.createDataFrame(
        [("2024-01-01T10:00:00", "2024-01-01T09:00:00"), ("Unknown", "2024-01-02T09:00:00"), ("2024-01-03T00:00:00", "x")],
        "Start string, Submit string",
    )
    assert read_accounting_day(b, ["2024-01-02"]).count() == 1
    cal = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "d string")
    assert {r.job_date for r in read_accounting_day(b, cal).collect()} == {"2024-01-01", "2024-01-03"}


def test_store_stats_against_file_listing(spark, sf_small):
    import glob
    import os

    import pyarrow.parquet as pq

    from jobacct.plans import queries as Q

    root = Q._store(spark)
    ST.write_silver(Q.silver(spark, sf_small), root)
    r = ST.store_stats(spark, root).collect()[0]
    parts = sorted(glob.glob(f"{root}/processed/job_date=*/*.parquet"))
    assert r.data_files == len(parts)
    assert r.latest_file == os.path.relpath(parts[-1], root)
    assert r.recent_records == sum(pq.ParquetFile(f).metadata.num_rows for f in parts[-5:])
    assert r.disk_mb == pytest.approx(sum(map(os.path.getsize, parts)) / 2**20)
    assert ST.store_stats(spark, Q._store(spark)).collect()[0].data_files == 0


def test_scopes_are_of_one_thread(spark):
    """What another thread stages while a scope is open outlives the scope."""
    import threading

    kept = []
    with ST.staging_scope(spark):
        t = threading.Thread(target=lambda: kept.append(ST.stage(spark, spark.range(3).toDF("i"), "other-thread")))
        t.start()
        t.join()
        own = ST.stage(spark, spark.range(2).toDF("i"), "own-thread")
        assert own.count() == 2
    assert kept[0].count() == 3
