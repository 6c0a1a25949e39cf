"""C5 from sums by day: equal to the reports over jobs, kept by every merge, gone where they cannot be added up."""

import pytest
from pyspark.sql import functions as F

from jobacct.plans.analyze import analyze
from jobacct.plans.collect import collect
from jobacct.plans.queries import _store
from jobacct.sources import daily, journal
from jobacct.sources import store as ST
from tests.test_no_lost_jobs import done, dump, line
from tests.test_publish_and_index import Killed, damage, folder, killed_at, silver_rows

AS_OF, DAYS = "2023-03-31", 89
SECTIONS = ("daily_usage", "daily_usage_recent", "user_stats", "top_users", "group_stats", "top_wasters", "cluster_summary", "state_distribution",
            "show_group_stats", "user_cpu_share", "daily_gpu_share")


def jobs(spark, first, n, jobs_a_day=7):
    """Days of jobs of several users (one null) and states, with and without times, sizes and waits."""
    i = F.col("job_id").cast("bigint")
    start = F.to_timestamp(F.concat("job_date", F.lit(" 10:00:00")))
    return silver_rows(spark, first, n, jobs_a_day).withColumns({
        "user": F.when(i % 11 != 0, F.concat(F.lit("u"), (i % 5).cast("string"))),
        "state": F.when(i % 3 == 0, "FAILED").when(i % 7 == 0, "TIMEOUT").otherwise("COMPLETED"),
        "submit_time": F.when(i % 13 != 0, start - F.expr("interval 90 seconds")),
        "start_time": F.when(i % 6 != 0, start),
        **{c: (i % k).cast(ST.SILVER_STORED[c].dataType) for c, k in (("elapsed_seconds", 97), ("alloc_cpus", 9), ("alloc_gpus", 3), ("req_mem_mb", 4096), ("max_rss_mb", 2048),
                                                                     ("total_cpu_seconds", 300), ("cpu_efficiency", 101), ("memory_efficiency", 89), ("gpu_hours_reserved", 3),
                                                                     ("cpu_hours_reserved", 5), ("memory_gb_hours_reserved", 6))},
    })


def groups_of(spark):
    return spark.createDataFrame([("u0", "a"), ("u1", "a"), ("u2", "b")], "user string, group string")


FEW = ("daily_usage", "user_stats", "state_distribution")


def values(spark, root, as_of=AS_OF, days=DAYS, sections=FEW, **how):
    out = analyze(spark, root, as_of, days, groups_of(spark), persist=False, **how)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return {k: sorted((tuple(norm(v) for v in r) for r in out[k].collect()), key=repr) for k in sections}, out


def test_ninety_days_from_sums_alone_equal_the_jobs(spark):
    root = _store(spark)
    ST.upsert_store(spark, root, jobs(spark, 0, 100))
    ST.build_daily(spark, root)
    # a merge changes one day, adds one and moves a job
    new = jobs(spark, 40, 1).withColumn("state", F.lit("COMPLETED")).unionByName(jobs(spark, 100, 1)).withColumn("processed_date", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    moved = jobs(spark, 50, 1).where("job_id = '1000350'")
    there = moved.withColumns({"job_date": F.lit("2023-03-01"), "processed_date": F.to_timestamp(F.lit("2024-02-01 00:00:00"))})
    ST.upsert_store(spark, root, new.unionByName(there), moved.select("job_id", "job_date"))
    want, full = values(spark, root, sections=SECTIONS)
    eff = full["efficiency_summary"].first().asDict()
    part, sums = values(spark, root, sections=SECTIONS, from_daily=True)
    assert want == part and sum(r[1] for r in want["user_stats"]) == 630 + 1 - 1
    assert all(full[k].schema.simpleString() == sums[k].schema.simpleString() for k in SECTIONS)
    # no job is read, nor a day outside the window
    damage(folder(spark, root) / "processed", set())
    for table in (daily.USAGE, daily.EFFICIENCY):
        damage(folder(spark, root) / table, set(ST.date_window(AS_OF, DAYS)))
    again, sums = values(spark, root, from_daily=True)
    assert again == {k: want[k] for k in FEW}
    got = sums["efficiency_summary"].first().asDict()
    assert all(got[k] == pytest.approx(eff[k], abs=3 if "median" in k else 1e-9) for k in eff)


def test_a_day_without_completed_jobs_and_a_day_that_goes(spark):
    root = _store(spark)
    ST.upsert_store(spark, root, jobs(spark, 0, 3))
    ST.build_daily(spark, root)
    late = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    ST.upsert_store(spark, root, jobs(spark, 1, 1).withColumns({"state": F.lit("FAILED"), "processed_date": late}))
    all_of_day = jobs(spark, 2, 1)
    ST.upsert_store(spark, root, all_of_day.withColumns({"job_date": F.lit("2023-01-09"), "processed_date": late}), all_of_day.select("job_id", "job_date"))
    names = lambda t: [n.partition("=")[2] for n in journal.Files(spark, root).names(f"{root}/{t}") if "=" in n]
    assert names(daily.USAGE) == ["2023-01-01", "2023-01-02", "2023-01-09"] and names(daily.EFFICIENCY) == ["2023-01-01", "2023-01-09"]
    assert values(spark, root)[0] == values(spark, root, from_daily=True)[0]


def test_collections_keep_the_sums_and_a_killed_one_leaves_both_or_neither(spark, tmp_path, monkeypatch):
    first = [line("1", "PENDING", "2024-03-01T10:00:00"), done("2", "2024-03-01")]
    second = [line("1", "COMPLETED", "2024-03-01T10:00:00", "2024-03-02T01:00:00", "2024-03-02T02:00:00"), done("3", "2024-03-02")]
    for k in (0, 5):  # before the manifest, within the moves
        root = _store(spark)
        collect(spark, dump(spark, tmp_path, f"a{k}", *first), root, "2024-03-01", 1)
        ST.build_daily(spark, root)
        with monkeypatch.context() as m:
            killed_at(m, k)
            with pytest.raises(Killed):
                collect(spark, dump(spark, tmp_path, f"b{k}", *first[1:], *second), root, "2024-03-03", 3)
        same = values(spark, root, "2024-03-03", 3, from_daily=True)[0]  # repairs first
        assert same == values(spark, root, "2024-03-03", 3)[0]
        collect(spark, dump(spark, tmp_path, f"c{k}", *first[1:], *second), root, "2024-03-03", 3)
        same = values(spark, root, "2024-03-03", 3, from_daily=True)[0]
        assert daily.kept(spark, root) and same == values(spark, root, "2024-03-03", 3)[0]
        assert same["state_distribution"] == [("COMPLETED", 3, 100.0)]


def test_sums_go_where_jobs_stand_twice(spark):
    root = _store(spark)
    ST.upsert_store(spark, root, jobs(spark, 0, 3))
    ST.build_daily(spark, root)
    copy = jobs(spark, 0, 1).withColumn("job_date", F.lit("2023-01-03"))
    ST.upsert_store(spark, root, copy)  # on a second date, the first one not superseded
    assert not daily.kept(spark, root)
    assert values(spark, root)[0] == values(spark, root, from_daily=True)[0]
    with pytest.raises(ValueError, match="more than once"):
        ST.build_daily(spark, root)
    other = _store(spark)
    ST.upsert_store(spark, other, jobs(spark, 0, 3))
    ST.build_daily(spark, other)
    ST.write_silver(jobs(spark, 1, 1), other)
    assert not daily.kept(spark, other)


def test_an_empty_store_has_empty_reports(spark):
    root = _store(spark)
    ST.build_daily(spark, root)
    assert values(spark, root, from_daily=True)[0] == values(spark, root)[0]
