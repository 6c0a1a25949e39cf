"""Median over buckets, back-filled GPU hours, node ranges of any width."""

import statistics

import pytest
from pyspark.sql import functions as F

from jobacct.functions.nodes import CHUNK, explode_nodes, node_count
from jobacct.operators import nodes as ND
from jobacct.operators import reports as R

JOB = ("user string, state string, elapsed_seconds long, alloc_cpus long, alloc_gpus long, req_mem_mb double, max_rss_mb double, "
       "total_cpu_seconds double, cpu_efficiency double, memory_efficiency double, cpu_hours_reserved double, "
       "gpu_hours_reserved double, memory_gb_hours_reserved double, submit_time timestamp, start_time timestamp, end_time timestamp")


def jobs(spark, effs, gpu_hours=2.0):
    row = lambda e: ("u", "COMPLETED", 3600, 2, 2, 10.0, 5.0, 100.0, e, None if e is None else e / 2, 2.0 if gpu_hours is not None else None, gpu_hours, 1.0, None, None, None)
    return spark.createDataFrame([row(e) for e in effs], JOB)


@pytest.mark.parametrize("effs", [[3.0], [1.0, 2.0], [0.0, 0.0, 0.0, 100.0], [50.0001, 50.0002, 50.0003, 50.0004], [1.0, 99.0, None],
                                  [7.0, 7.0, 7.0], [0.1 * i for i in range(101)], [-5.0, 3.0, 250.0, 300.0]])
def test_median(spark, effs):
    r = R.efficiency_summary(jobs(spark, effs)).collect()[0]
    seen = [e for e in effs if e is not None]
    assert r.completed_jobs == len(effs)
    assert r.cpu_median == pytest.approx(statistics.median(seen)) and r.mem_median == pytest.approx(statistics.median(seen) / 2)
    assert r.cpu_mean == pytest.approx(statistics.mean(seen)) and (r.cpu_min, r.cpu_max) == (min(seen), max(seen))


def test_median_of_nothing_and_plan(spark):
    assert R.efficiency_summary(jobs(spark, [])).count() == 0
    r = R.efficiency_summary(jobs(spark, [None])).collect()[0]
    assert (r.completed_jobs, r.cpu_median, r.cpu_mean) == (1, None, None)
    plan = R.efficiency_summary(jobs(spark, [1.0]))._jdf.queryExecution().toString().lower()
    assert "median(" not in plan and "percentile" not in plan


def test_back_filled_gpu_hours_agree(spark):
    old = R.backfill_reserved(jobs(spark, [1.0, 2.0], gpu_hours=None)).withColumns({"wait_seconds": F.lit(1), "group": F.lit("g")})
    assert {r.gpu_hours_reserved for r in old.collect()} == {0.0}
    assert R.user_stats(old).collect()[0].total_gpu_hours == 0.0
    assert R.group_stats(old).collect()[0].total_gpu_hours == 0.0
    assert R.cluster_summary(old).collect()[0].total_gpu_hours == 0.0
    new = R.backfill_reserved(jobs(spark, [1.0, 2.0])).withColumn("wait_seconds", F.lit(1))
    assert R.user_stats(new).collect()[0].total_gpu_hours == 4.0


def test_wide_ranges(spark):
    wide = spark.createDataFrame([("n[1-3000000000]",), ("m-[0008-0011,x,3-1]",), ("one",), ("",), (None,), ("p[5-3]",)], "l string")
    assert [r[0] for r in wide.select(node_count("l")).collect()] == [3_000_000_000, 5, 1, 0, 0, 0]
    rows = explode_nodes(wide.where("l not like 'n%' or l is null"), "l")
    assert [r.node for r in rows.where("l like 'm%'").collect()] == ["m-0008", "m-0009", "m-0010", "m-0011", "m-x", None]
    assert [r.node for r in rows.where("l = 'one'").collect()] == ["one"]
    assert {r.node for r in rows.where("l is null or l in ('', 'p[5-3]')").collect()} == {None}
    many = spark.createDataFrame([(f"n[1-{2 * CHUNK + 5}]",)], "l string")
    got = explode_nodes(many, "l")
    assert got.count() == got.distinct().count() == 2 * CHUNK + 5


def test_wide_range_in_node_totals(spark):
    df = spark.createDataFrame([("n[1-200000]", 200000.0, 0.0, 3600), ("n7", 1.0, 0.0, 60)],
                               "node_list string, cpu_hours_reserved double, gpu_hours_reserved double, elapsed_seconds long")
    t = ND.node_totals(df)
    assert t.count() == 200000
    assert {r.node: r.total_cpu_hours for r in t.where("node in ('n7', 'n9')").collect()} == {"n7": 2.0, "n9": 1.0}
