"""What the store's merges shuffle and rewrite: rows come through whole, in few bytes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jobacct.operators import normalize as N
from jobacct.schemas import ACCOUNTING_FIELDS, SILVER_STORED
from jobacct.session import scratch_path
from jobacct.sources import accounting as S
from jobacct.sources import journal
from jobacct.sources import store as ST


def bronze(spark, *jobs, file="a"):
    """One main line for each (id, day) in ``jobs``."""
    def text(job, day):
        v = dict.fromkeys(ACCOUNTING_FIELDS, "") | {"JobID": job, "JobIDRaw": job, "User": "u", "State": "COMPLETED", "ElapsedRaw": "3600", "AllocCPUS": "2",
                                                    "Submit": f"{day}T01:00:00", "Start": f"{day}T02:00:00", "End": f"{day}T03:00:00", "ReqMem": "1G"}
        return "|".join(v[f] for f in ACCOUNTING_FIELDS)

    rows = [(text(j, d), (file, 0, i)) for i, (j, d) in enumerate(jobs)]
    df = spark.createDataFrame(rows, "value string, seq struct<file:string,block:bigint,pos:bigint>")
    return S.with_job_date(S.parse_accounting_lines(df))


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().toString()
    return re.findall(r"Exchange hashpartitioning\([^\n]*", plan[plan.index("== Physical Plan =="):])


def files(spark, root, day):
    return [n for n in journal.Files(spark, root).names(f"{root}/raw/job_date={day}") if n.startswith("part-")]


def test_the_pick_shuffles_the_texts_of_a_main_line_as_one(spark):
    b = bronze(spark, ("1", "2024-03-01"))
    part = [l for l in N.pick_main_and_batch(b)._jdf.queryExecution().executedPlan().toString().split("\n") if "partial_max_by" in l]
    assert part and all("struct(JobName" not in l.split("_line")[0] and "_line" in l for l in part)


def test_the_pick_keeps_lines_that_cannot_be_packed(spark):
    b = bronze(spark, ("1", "2024-03-01"), ("2", "2024-03-01"), ("3", "2024-03-01"))
    b = b.withColumn("JobName", F.when(F.col("JobID") == "1", "a|b").when(F.col("JobID") == "2", F.lit(None)).otherwise("c"))
    got = {r["job_id_base"]: (r["m"]["JobName"], r["m"]["AllocCPUS"], r["m"]["is_finished"]) for r in N.pick_main_and_batch(b).collect()}
    assert got == {"1": ("a|b", "2", True), "2": (None, "2", True), "3": ("c", "2", True)}


def test_raw_rows_come_through_the_archive_as_they_are(spark):
    b = bronze(spark, ("1", "2024-03-01"), ("2", "2024-03-01"), ("3", "2024-03-02"))
    b = b.withColumns({"Comment": F.when(F.col("JobID") == "1", "x|y").otherwise(F.col("Comment")), "Flags": F.when(F.col("JobID") == "2", F.lit(None)).otherwise("f")})
    b = b.select(*ST.RAW_STORED.names)
    root = scratch_path(spark, "store")
    ST.upsert_raw(spark, root, b)
    got = ST.read_table(spark, root, ST.RAW).select(*b.columns)
    assert got.schema.simpleString() == b.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, b.collect()))


def test_archived_dates_that_lose_no_line_keep_their_files(spark):
    root = scratch_path(spark, "store")
    ST.upsert_raw(spark, root, bronze(spark, ("1", "2024-03-01"), ("2", "2024-03-01"), ("3", "2024-03-02"), ("4", "2024-03-03")))
    old = {d: files(spark, root, d) for d in ("2024-03-01", "2024-03-02", "2024-03-03")}
    ST.upsert_raw(spark, root, bronze(spark, ("2", "2024-03-01"), ("5", "2024-03-02"), file="b"))
    assert set(old["2024-03-02"]) < set(files(spark, root, "2024-03-02"))
    assert not set(old["2024-03-01"]) & set(files(spark, root, "2024-03-01"))
    assert old["2024-03-03"] == files(spark, root, "2024-03-03")
    got = ST.read_table(spark, root, ST.RAW).select("JobIDRaw", "seq.file", "job_date").collect()
    assert sorted(map(tuple, got)) == [("1", "a", "2024-03-01"), ("2", "b", "2024-03-01"), ("3", "a", "2024-03-02"), ("4", "a", "2024-03-03"), ("5", "b", "2024-03-02")]


def test_a_merge_by_date_is_the_plain_upsert(spark, monkeypatch):
    at = ("2024-04-01 00:00:00", "2024-04-02 00:00:00", "2024-03-31 00:00:00")
    days = [f"2024-03-0{1 + k % 3}" for k in range(30)]
    old = N.normalize_jobs(bronze(spark, *((str(k), d) for k, d in enumerate(days))), at[0])
    # some again, some on another date, one older than what is stored, some metrics not what the columns give
    new = N.normalize_jobs(bronze(spark, *((str(k), days[k]) for k in range(5, 12)), ("2", "2024-03-03"), ("40", "2024-03-01")), at[1])
    new = new.unionByName(N.normalize_jobs(bronze(spark, ("20", days[20])), at[2])).withColumn("cpu_efficiency", F.when(F.col("job_id") == "7", 3.25).otherwise(F.col("cpu_efficiency")))
    old = old.withColumn("gpu_hours_reserved", F.when(F.col("job_id") == "3", F.lit(None)).otherwise(F.col("gpu_hours_reserved")))
    want = sorted(map(repr, ST.upsert_silver(old, new).select(*SILVER_STORED.names).collect()))
    for most in (400_000, 3):
        monkeypatch.setattr(ST, "JOBS_PER_TASK", most)
        run = journal.Run(spark, scratch_path(spark, "store"))
        ST.merge_by_date(run, old, new)
        assert sorted(map(repr, ST.read_written(run, ST.PROCESSED).select(*SILVER_STORED.names).collect())) == want


def test_a_merge_of_one_date_shuffles_rows_once(spark):
    lean = N.normalize_jobs(bronze(spark, ("1", "2024-03-01"))).withColumn("_part", F.xxhash64("job_id") % 4)
    once = ST.latest_per_job(ST.stage(spark, lean, "x").repartition("job_date", "_part"), within=["job_date", "_part"])
    assert len(exchanges(once)) == 1
