"""Runs that die, dates that are damaged, jobs split over files: the store ends as if nothing had happened."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobacct.plans.collect import collect
from jobacct.plans.queries import _store
from jobacct.schemas import SILVER_COLUMNS
from jobacct.sources import job_index, journal
from jobacct.sources import store as ST
from jobacct.streaming.collect_stream import stream_collect
from tests.test_no_lost_jobs import completed, done, dump, line, stored


def folder(spark, root) -> Path:
    return Path(spark.sparkContext._jvm.java.net.URI(root).getPath())


def damage(path: Path, keep: set[str]) -> None:
    """Every data file under ``path`` but those of the dates in ``keep`` becomes unreadable."""
    for f in path.rglob("*.parquet"):
        if f.parent.name.partition("=")[2] not in keep:
            f.write_bytes(b"damaged")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def silver_rows(spark, first: int, n: int, jobs_a_day: int = 3):
    """``n`` days of finished jobs from day ``first`` on, numbered in sequence."""
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") / jobs_a_day).cast("int")), "yyyy-MM-dd")
    rows = spark.range(first * jobs_a_day, (first + n) * jobs_a_day).select((F.col("id") + 1_000_000).cast("string").alias("job_id"), F.lit("COMPLETED").alias("state"), day.alias("job_date"))
    filled = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ST.SILVER_STORED.fields if f.name != "job_date"]
    return rows.select(*filled, "job_date").withColumn("processed_date", F.to_timestamp(F.lit("2024-01-01 00:00:00")))


def test_an_upsert_opens_only_the_dates_it_touches(spark):
    root = _store(spark)
    ST.upsert_store(spark, root, silver_rows(spark, 0, 400))
    assert len(ST.stored_dates(spark, root, ST.PROCESSED)) == 400
    damage(folder(spark, root) / "processed", {"2023-02-01"})
    new = silver_rows(spark, 31, 1).withColumn("state", F.lit("FAILED")).withColumn("processed_date", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    merged = ST.upsert_store(spark, root, new)
    assert {(r.state, r.job_date) for r in merged.collect()} == {("FAILED", "2023-02-01")} and merged.count() == 3
    scan = ST.read_table(spark, root, ST.PROCESSED, new.select("job_date"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = scan._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [isnotnull(job_date" in plan and "(job_date" in plan and "2023-02-01)" in plan


def test_a_collection_opens_only_dates_that_hold_its_jobs(spark, tmp_path):
    """400 dates; the job that moved and the day of the collection are readable, nothing else is."""
    root = _store(spark)
    ST.upsert_store(spark, root, silver_rows(spark, 0, 400).where("job_id != '1000030'"))
    collect(spark, dump(spark, tmp_path, "a", line("1000030", "PENDING", "2023-01-11T10:00:00")), root, "2023-01-11", 0)
    blocks = folder(spark, root) / "jobs"
    assert len(list(blocks.glob("job_block=*"))) == 1
    damage(folder(spark, root) / "processed", {"2023-01-11"})
    ran = line("1000030", "RUNNING", "2023-01-11T10:00:00", "2024-06-01T09:00:00")
    m = collect(spark, dump(spark, tmp_path, "b", ran, done("2000000", "2024-06-01")), root, "2024-06-01", 0).first()
    assert (m.inserted_jobs, m.skipped_jobs) == (2, 0)
    rows = ST.read_table(spark, root, ST.PROCESSED, ["2023-01-11", "2024-06-01"]).select("job_id", "state").collect()
    assert ("1000030", "RUNNING") in {tuple(r) for r in rows} and len(rows) == 4  # two of the old day stay, the moved one has one row
    assert len(list(blocks.glob("job_block=*"))) == 2


def test_index_of_odd_ids_and_of_a_store_without_one(spark):
    rows = [("123", "d1"), ("123_4", "d1"), ("99999", "d2"), ("100000", "d2"), ("abc", "d3"), ("", "d3"), ("9" * 30, "d4")]
    ids = spark.createDataFrame(rows, "job_id string, job_date string")
    blocks = {r.job_id: r.job_block for r in job_index.entries(ids).collect()}
    assert blocks["123"] == blocks["123_4"] == blocks["99999"] == 0 and blocks["100000"] == 1
    assert -job_index.OTHER <= blocks["abc"] < 0 and -job_index.OTHER <= blocks[""] < 0
    root = _store(spark)
    job_index.ensure(spark, root, ids)
    found = job_index.lookup(spark, root, spark.createDataFrame([("123",), ("abc",), ("none",), ("9" * 30,)], "job_id string"))
    assert sorted(map(tuple, found.collect())) == [("123", "d1"), ("9" * 30, "d4"), ("abc", "d3")]
    # a plain write of the processed table drops the index; the next upsert builds it
    ST.write_silver(silver_rows(spark, 0, 2), root)
    assert not (folder(spark, root) / "jobs").exists()
    ST.upsert_store(spark, root, silver_rows(spark, 2, 1))
    assert job_index.lookup(spark, root, silver_rows(spark, 0, 3).select("job_id")).count() == 9


class Killed(Exception):
    pass


def killed_at(monkeypatch, k: int) -> list[str]:
    """The k-th change to the file system of a run is not made: the run dies there."""
    done: list[str] = []

    def wrap(name):
        was = getattr(journal.Files, name)

        def call(self, *args):
            if len(done) == k:
                raise Killed(name)
            done.append(name)
            return was(self, *args)

        monkeypatch.setattr(journal.Files, name, call)

    for name in ("move", "delete", "write"):
        wrap(name)
    return done


def test_a_run_killed_at_any_step_is_repaired(spark, monkeypatch):
    """Every step of publishing, in a run that replaces, adds, drops and marks."""

    def content(root):
        tables = {k: sorted(map(tuple, spark.read.parquet(f"{root}/{k}").select("v", "p").collect())) for k in ("one", "two", "three") if journal.Files(spark, root).exists(f"{root}/{k}")}
        return {k: v for k, v in tables.items() if v}

    def store():
        root = _store(spark)
        run = journal.Run(spark, root)
        run.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "v int, p string"), "one", "p")
        run.write(spark.createDataFrame([(4, "a")], "v int, p string"), "two", "p")
        run.publish()
        return root

    def change(root):
        run = journal.Run(spark, root)
        run.write(spark.createDataFrame([(10, "a"), (11, "d")], "v int, p string"), "one", "p")
        run.write(spark.createDataFrame([(12, "z")], "v int, p string"), "three", "p")
        run.drop("one", "p", ["b"])
        run.publish()

    before = {"one": [(1, "a"), (2, "b"), (3, "c")], "two": [(4, "a")]}
    after = {"one": [(3, "c"), (10, "a"), (11, "d")], "two": [(4, "a")], "three": [(12, "z")]}
    root = store()
    assert content(root) == before
    change(root)
    assert content(root) == after and not journal.Files(spark, root).names(f"{root}/journal")
    outcomes = []
    for k in range(12):
        root = store()
        with monkeypatch.context() as m:
            killed_at(m, k)
            try:
                change(root)
                break
            except Killed:
                pass
        # the store is readable meanwhile; a second death during the repair changes nothing
        with monkeypatch.context() as m:
            killed_at(m, 1)
            try:
                journal.recover(spark, root)
            except Killed:
                pass
        outcomes.append(journal.recover(spark, root))
        assert content(root) == (before if k == 0 else after), k
        assert not journal.Files(spark, root).names(f"{root}/journal")
    assert k >= 6


def test_a_killed_collection_is_finished_or_rolled_back_by_the_next(spark, tmp_path, monkeypatch):
    first = [line("1", "PENDING", "2024-03-01T10:00:00"), done("2", "2024-03-01")]
    second = [line("1", "COMPLETED", "2024-03-01T10:00:00", "2024-03-02T01:00:00", "2024-03-02T02:00:00"), done("3", "2024-03-02")]
    want = [("1", "COMPLETED", "2024-03-02"), ("2", "COMPLETED", "2024-03-01"), ("3", "COMPLETED", "2024-03-02")]
    for k in (0, 4):  # before the manifest, within the moves
        root = _store(spark)
        collect(spark, dump(spark, tmp_path, "a", *first), root, "2024-03-01", 1)
        with monkeypatch.context() as m:
            killed_at(m, k)
            with pytest.raises(Killed):
                collect(spark, dump(spark, tmp_path, "b", *first[1:], *second), root, "2024-03-03", 3)
        collect(spark, dump(spark, tmp_path, "c", *first[1:], *second), root, "2024-03-03", 3)
        assert stored(spark, root) == want and completed(spark, root) == ["2024-03-01", "2024-03-02"]
        assert ST.read_table(spark, root, ST.RAW).where("JobIDRaw = '3'").count() == 1


def batch(job, day, cpu):
    return line(f"{job}.batch", "COMPLETED", f"{day}T01:00:00", f"{day}T02:00:00", f"{day}T03:00:00", TotalCPU=cpu, MaxRSS="512M", User="")


def rows(spark, root):
    return sorted(map(repr, ST.read_table(spark, root, ST.PROCESSED).select(*SILVER_COLUMNS, "job_date").collect()))


def test_a_dump_cut_at_any_line_gives_the_same_store(spark, tmp_path):
    at = "2024-04-01 00:00:00"
    lines = [
        line("1", "PENDING", "2024-03-01T01:00:00", "2024-03-01T02:00:00"),  # a stale line, then the job and its step
        done("1", "2024-03-01"), batch("1", "2024-03-01", "00:30:00"),
        batch("2", "2024-03-01", "00:40:00"), done("2", "2024-03-01"),  # the step first
        done("3", "2024-03-02"), batch("3", "2024-03-02", "00:05:00"),
    ]
    whole = _store(spark)
    collect(spark, dump(spark, tmp_path, "whole", *lines), whole, "2024-03-05", 9, at)
    want = rows(spark, whole)
    assert len(want) == 3 and len({r.total_cpu_seconds for r in ST.read_table(spark, whole, ST.PROCESSED).collect()}) == 3
    for cut in (1, 2, 4):
        root, src = _store(spark), tmp_path / f"in{cut}"
        src.mkdir()
        (src / "0.txt").write_text("\n".join(lines[:cut]) + "\n")
        # the query ends with the first file; a new one goes on from its checkpoint
        for part in ("1.txt", None):
            stream_collect(spark, str(src), root, str(tmp_path / f"cp{cut}"), processed_at=at, max_files_per_trigger=1).awaitTermination()
            if part:
                (src / part).write_text("\n".join(lines[cut:]) + "\n")
        assert rows(spark, root) == want, cut


def test_one_line_a_file(spark, tmp_path):
    at, lines = "2024-04-01 00:00:00", [done("1", "2024-03-01"), batch("1", "2024-03-01", "00:30:00"), batch("2", "2024-03-01", "00:40:00"), done("2", "2024-03-01")]
    whole = _store(spark)
    collect(spark, dump(spark, tmp_path, "whole", *lines), whole, "2024-03-05", 9, at)
    root, src = _store(spark), tmp_path / "in"
    src.mkdir()
    for i, x in enumerate(lines):
        (src / f"{i}.txt").write_text(x + "\n")
    stream_collect(spark, str(src), root, str(tmp_path / "cp"), processed_at=at, max_files_per_trigger=1).awaitTermination()
    assert rows(spark, root) == rows(spark, whole)


def test_a_date_with_archived_lines_only_is_rebuilt_by_a_collection(spark, tmp_path):
    root = _store(spark)
    a, b = [done("1", "2024-03-01"), batch("1", "2024-03-01", "00:30:00")], [done("2", "2024-03-02")]
    collect(spark, dump(spark, tmp_path, "a", *a, *b), root, "2024-03-02", 2)
    want = rows(spark, root)
    journal.Files(spark, root).delete(f"{root}/processed/job_date=2024-03-01")
    journal.Files(spark, root).delete(f"{root}/completed/job_date=2024-03-01")
    # the accounting system has forgotten the day: the dump holds another day only
    m = collect(spark, dump(spark, tmp_path, "c", *b), root, "2024-03-03", 3).first()
    assert (m.raw_records, m.inserted_jobs, m.skipped_jobs) == (3, 1, 1)
    assert [r.split("processed_date")[0] for r in rows(spark, root)] == [r.split("processed_date")[0] for r in want]
    assert completed(spark, root) == ["2024-03-01", "2024-03-02"]
    # an archive whose lines are of other dates is none: the dump is taken
    other = _store(spark)
    wrong = ST.read_table(spark, root, ST.RAW).where("job_date = '2024-03-01'").withColumn("job_date", F.lit("2024-03-02"))
    ST.write_bronze(wrong, other)
    collect(spark, dump(spark, tmp_path, "d", *b), other, "2024-03-02", 0)
    assert [j for j, _, _ in stored(spark, other)] == ["2"]
