"""File reports of the store, the summary after a collection and the sketched medians."""

import glob
import os
import statistics

from pyspark.sql import functions as F

from jobacct.operators import reports as R
from jobacct.plans import collect as C
from jobacct.plans import queries as Q
from jobacct.sources import files
from jobacct.sources import store as ST


def store(spark, sf, tmp_path):
    root = str(tmp_path / "st ore+1")  # a path that a scan encodes
    ST.write_bronze(Q._dated_bronze(spark, sf), root)
    return root, sorted(glob.glob(f"{root}/raw/job_date=*/*.parquet"))


def test_file_stats(spark, sf_small, tmp_path):
    root, parts = store(spark, sf_small, tmp_path)
    got = {r.path: (r.kind, r.bytes, r.n_rows) for r in files.file_stats(spark, root).collect()}
    assert got.keys() == {os.path.relpath(p, root) for p in parts}
    assert sum(n for _, _, n in got.values()) == ST.read_table(spark, root, ST.RAW).count()
    assert all(b == os.path.getsize(f"{root}/{p}") for p, (_, b, _) in got.items())
    assert files.file_stats(spark, str(tmp_path / "none")).count() == 0


def test_unreadable_files(spark, sf_small, tmp_path):
    root, parts = store(spark, sf_small, tmp_path)
    assert files.unreadable_files(spark, root, ST.RAW).count() == 0
    assert files.unreadable_files(spark, root, ST.RAW, deep=True).count() == 0
    whole = open(parts[0], "rb").read()
    folder = os.path.dirname(parts[0])
    for name, data in {"text": b"plain words, no Parquet", "cut": whole[: len(whole) // 2], "empty": b"", "foot": whole[:-30] + bytes(22) + whole[-8:]}.items():
        open(f"{folder}/{name}.parquet", "wb").write(data)
    bad = {os.path.basename(r.path): r.reason for r in files.unreadable_files(spark, root, ST.RAW).collect()}
    want = {"text.parquet": "not a Parquet file", "cut.parquet": "truncated"}
    assert {k: bad[k] for k in want} == want
    assert set(bad) <= {*want, "foot.parquet"}
    dates = [os.path.basename(os.path.dirname(parts[-1])).split("=")[1]]
    assert files.unreadable_files(spark, root, ST.RAW, dates).count() == 0  # other dates are not looked at


def test_damaged_pages_are_found_by_a_deep_read(spark, sf_small, tmp_path):
    root, parts = store(spark, sf_small, tmp_path)
    data = bytearray(open(parts[1], "rb").read())
    data[4 : len(data) // 2] = bytes(len(data) // 2 - 4)  # the footer stays whole
    open(f"{os.path.dirname(parts[1])}/pages.parquet", "wb").write(data)
    assert files.unreadable_files(spark, root, ST.RAW).count() == 0
    got = files.unreadable_files(spark, root, ST.RAW, deep=True).collect()
    assert [(os.path.basename(r.path), r.reason) for r in got] == [("pages.parquet", "rows lost")]


def test_summary_covers_dates_that_a_run_skips(spark, sf_small, tmp_path):
    root = str(tmp_path / "s")
    as_of, days = Q.window(spark, sf_small, 2)
    bronze = Q.bronze(spark, sf_small, 2)
    C.collect(spark, bronze, root, as_of, days)
    again = C.collect(spark, bronze, root, as_of, days).first()
    assert again.inserted_jobs == 0 < again.skipped_jobs
    out = C.collection_summary(spark, root, as_of, days)
    n = ST.read_table(spark, root, ST.PROCESSED).count()
    assert out["daily_usage"].agg(F.sum("job_count")).first()[0] == n > 0
    assert out["cluster_summary"].first().total_jobs == n
    assert C.collection_summary(spark, str(tmp_path / "none"), as_of, days)["daily_usage"].count() == 0


def test_sketched_medians(spark):
    rows = [(f"2024-01-{1 + i % 7:02d}", "COMPLETED", float((i * 7919) % 10_007) / 100, None if i % 3 else float(i % 50)) for i in range(10_007)]
    df = spark.createDataFrame(rows, "job_date string, state string, cpu_efficiency double, memory_efficiency double")
    exact, sketched = R.efficiency_summary(df).first(), R.efficiency_summary(df, approx=True).first()
    for c in ("completed_jobs", "cpu_mean", "cpu_min", "cpu_max", "mem_mean", "mem_min", "mem_max"):
        assert abs(exact[c] - sketched[c]) < 1e-9
    assert abs(sketched.cpu_median - statistics.median(r[2] for r in rows)) < 1.0  # values are ranks / 100
    assert abs(sketched.mem_median - exact.mem_median) <= 1
    # partials of dates merge to what one pass gives; their size does not follow the rows
    parts = R.efficiency_partials(df)
    assert parts.count() == 7 and parts.agg(F.max(F.length("cpu_sketch"))).first()[0] < 40_000
    assert R.efficiency_of_partials(parts).first().completed_jobs == len(rows)
    none = df.where("state = 'FAILED'")
    assert R.efficiency_summary(none, approx=True).count() == 0
    nulls = df.select("job_date", "state", F.lit(None).cast("double").alias("cpu_efficiency"), "memory_efficiency")
    assert R.efficiency_summary(nulls, approx=True).first().cpu_median is None
