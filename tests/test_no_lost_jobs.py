"""Collection, stream and node sums on hand-made rows: nothing is lost, counted twice or rounded."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobacct.operators import nodes as NO
from jobacct.plans.collect import collect
from jobacct.plans.queries import _store
from jobacct.schemas import ACCOUNTING_FIELDS
from jobacct.sources import store as ST
from jobacct.sources.accounting import read_accounting_text
from jobacct.streaming.collect_stream import stream_collect


def line(job, state, submit, start="Unknown", end="Unknown", **more):
    v = dict.fromkeys(ACCOUNTING_FIELDS, "")
    v |= {"JobID": job, "JobIDRaw": job, "JobName": "j", "User": "u", "UID": "1", "Partition": "p", "State": state, "Submit": submit,
          "Start": start, "End": end, "ElapsedRaw": "3600", "TotalCPU": "00:10:00", "AllocCPUS": "2", "NodeList": "n1", "ReqMem": "1G"}
    return "|".join((v | more)[f] for f in ACCOUNTING_FIELDS)


def done(job, day):
    return line(job, "COMPLETED", f"{day}T01:00:00", f"{day}T02:00:00", f"{day}T03:00:00")


def dump(spark, tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return read_accounting_text(spark, str(tmp_path / name))


def stored(spark, root):
    return sorted((r.job_id, r.state, r.job_date) for r in ST.read_table(spark, root, ST.PROCESSED).collect())


def completed(spark, root):
    return sorted(r.job_date for r in ST.read_completed(spark, root).collect())


def test_a_job_added_to_a_settled_date_is_collected(spark, tmp_path):
    root = _store(spark)
    a, b = done("1", "2024-03-01"), done("2", "2024-03-01")
    collect(spark, dump(spark, tmp_path, "a", a), root, "2024-03-01", 1)
    assert completed(spark, root) == []  # the day is not over
    m = collect(spark, dump(spark, tmp_path, "b", a, b), root, "2024-03-02", 1).first()
    assert (m.raw_records, m.inserted_jobs, m.skipped_jobs, m.completed_dates) == (2, 1, 1, 1)
    assert [j for j, _, _ in stored(spark, root)] == ["1", "2"] and completed(spark, root) == ["2024-03-01"]
    # nothing new: the date is marked by the run that read it, and not read again
    assert collect(spark, dump(spark, tmp_path, "c", a, b), root, "2024-03-03", 2).first().raw_records == 0


def test_a_damaged_date_stops_the_merge(spark, tmp_path):
    root = _store(spark)
    collect(spark, dump(spark, tmp_path, "a", done("1", "2024-03-01"), done("2", "2024-03-01")), root, "2024-03-01", 1)
    folder = spark.sparkContext._jvm.java.net.URI(root).getPath()
    from pathlib import Path

    files = sorted(Path(folder, "processed", "job_date=2024-03-01").glob("*.parquet"))
    was = [f.read_bytes() for f in files]
    for f in files:
        f.write_bytes(b"damaged")
    for crc in Path(folder, "processed", "job_date=2024-03-01").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017
        collect(spark, dump(spark, tmp_path, "b", done("3", "2024-03-01")), root, "2024-03-02", 1)
    assert [f.read_bytes() for f in files] == [b"damaged"] * len(files) and completed(spark, root) == []
    for f, data in zip(files, was):
        f.write_bytes(data)
    assert [j for j, _, _ in stored(spark, root)] == ["1", "2"]
    assert ST.load_recent(spark, root, "2024-03-01", 1).count() == 2


def test_a_job_that_starts_on_a_later_day_has_one_row(spark, tmp_path):
    root = _store(spark)
    wait = line("1", "PENDING", "2024-03-01T10:00:00")
    collect(spark, dump(spark, tmp_path, "a", wait), root, "2024-03-01", 1)
    assert stored(spark, root) == [("1", "PENDING", "2024-03-01")]
    ran = line("1", "COMPLETED", "2024-03-01T10:00:00", "2024-03-02T01:00:00", "2024-03-02T02:00:00")
    collect(spark, dump(spark, tmp_path, "b", ran, done("2", "2024-03-02")), root, "2024-03-03", 3)
    assert stored(spark, root) == [("1", "COMPLETED", "2024-03-02"), ("2", "COMPLETED", "2024-03-02")]
    assert completed(spark, root) == ["2024-03-02"]
    assert ST.stored_dates(spark, root, ST.PROCESSED) == ["2024-03-02"]


def test_a_stream_takes_every_file_of_a_date(spark, tmp_path):
    root = _store(spark)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(done(str(i), "2024-03-01") + "\n")
    stream_collect(spark, str(tmp_path / "in"), root, str(tmp_path / "cp"), max_files_per_trigger=1).awaitTermination()
    assert [j for j, _, _ in stored(spark, root)] == ["0", "1", "2"]


def test_shares_are_not_rounded(spark):
    """1000 jobs of one second on 100 nodes: 10 seconds a node."""
    t = dt.datetime(2024, 3, 1)
    rows = [("n-[001-100]", 1 / 3600, 0.0, 1, t, t)] * 1000 + [("", 5.0, 0.0, 1, t, t), ("n-001", 2 / 3600, 0.0, 1, t, t)]
    df = spark.createDataFrame(rows, "node_list string, cpu_hours_reserved double, gpu_hours_reserved double, elapsed_seconds bigint, submit_time timestamp, end_time timestamp")
    for got in (NO.node_totals(df), NO.node_totals_and_period(df)[0]):
        r = {x.node: x for x in got.where(F.col("node").isNotNull()).collect()}
        assert len(r) == 100 and r["n-002"].total_cpu_hours == 1000 / (100 * 3600) and r["n-002"].job_count == 1000
        assert abs(r["n-001"].total_cpu_hours - (10 + 2) / 3600) < 1e-15 and r["n-001"].job_count == 1001


def test_a_job_that_waits_longer_than_the_window_has_one_row(spark, tmp_path):
    root = _store(spark)
    collect(spark, dump(spark, tmp_path, "a", line("1", "PENDING", "2024-03-01T10:00:00"), done("2", "2024-03-01")), root, "2024-03-01", 1)
    for day in ("02", "03"):
        collect(spark, dump(spark, tmp_path, day, done("3" + day, f"2024-03-{day}")), root, f"2024-03-{day}", 1)
    ran = line("1", "RUNNING", "2024-03-01T10:00:00", "2024-03-04T09:00:00")
    collect(spark, dump(spark, tmp_path, "d", ran), root, "2024-03-04", 1)
    assert [x for x in stored(spark, root) if x[0] == "1"] == [("1", "RUNNING", "2024-03-04")]
    assert ("2", "COMPLETED", "2024-03-01") in stored(spark, root) and "2024-03-01" not in completed(spark, root)  # its lines were not read again
    collect(spark, dump(spark, tmp_path, "e", done("2", "2024-03-01"), ran), root, "2024-03-05", 5)
    assert "2024-03-01" in completed(spark, root)
