"""End-to-end: registered queries against the DuckDB oracle on sf0.001,
incremental semantics, and plan shape."""

import duckdb
import pytest

import __spark_entry__ as E
from jobacct.checks import fixtures as FX
from jobacct.operators import incremental as I
from jobacct.plans import queries as Q

TABLES = ["events"]
KEYS = [
    "user_stats", "group_stats", "daily_usage", "cluster_summary", "efficiency_summary", "normalize_jobs",
    "node_stats", "gpu_utilization", "queue_grid", "queue_totals", "parse_memory", "expand_nodes", "pseudonymize",
]


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_small}/events.parquet')")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, sf_small, key):
    df = E.queries()[key](spark, sf_small)
    cols = sorted(df.columns)
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    drows = sorted((tuple(_norm(r[dcols.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_cpu_hours" in df.columns


def test_incremental_filter_literal(spark):
    raw = spark.createDataFrame(
        [("d", "1", "1", "COMPLETED", True), ("d", "1", "1.batch", "COMPLETED", False), ("d", "2", "2", "FAILED", True),
         ("d", "3", "3", "RUNNING", True), ("d", "4", "4", "CANCELLED by 5", True)],
        "job_date string, job_id_base string, JobID string, State string, is_main_job boolean",
    )
    existing = spark.createDataFrame([("d", "1", "COMPLETED"), ("d", "2", "RUNNING"), ("d", "4", "CANCELLED")],
                                     "job_date string, job_id_base string, old_state string")
    kept = I.incremental_filter(raw, existing)
    assert sorted(r.JobID for r in kept.where("not skipped").collect()) == ["2", "3"]
    assert kept.where("skipped").count() == 3
    literal = I.incremental_filter(raw, existing, normalize_states=False)
    assert sorted(r.JobID for r in literal.where("not skipped").collect()) == ["2", "3", "4"]


def test_completeness(spark):
    df = spark.createDataFrame([("a", "COMPLETED"), ("a", "RUNNING"), ("b", "FAILED"), ("c", "COMPLETED")], "job_date string, state string")
    got = {r.job_date: r.is_complete for r in I.date_completeness(df, "c").collect()}
    assert got == {"a": False, "b": True, "c": False}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_and_one_exchange_in_normalize(spark, sf_small):
    p = _plan(Q.silver(spark, sf_small))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert p.count("Exchange hashpartitioning") == 1


def test_store_partition_pruning(spark, sf_small):
    from jobacct.sources import store as ST

    root = Q._store(spark)
    ST.write_silver(Q.silver(spark, sf_small), root)
    df = ST.load_days(spark, root, "2024-01-10", 3)
    # the date filter reaches the scan as a partition filter (pruning)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [job_date" in plan and "IN (2024-01-08,2024-01-09,2024-01-10)" in plan
    assert {r.job_date for r in df.select("job_date").distinct().collect()} <= {"2024-01-08", "2024-01-09", "2024-01-10"}


def test_upsert_idempotent(spark, sf_small):
    from jobacct.sources import store as ST

    root = Q._store(spark)
    s = Q.silver(spark, sf_small)
    ST.upsert_store(spark, root, s)
    n1 = ST.read_table(spark, root, ST.PROCESSED).count()
    ST.upsert_store(spark, root, s)
    assert ST.read_table(spark, root, ST.PROCESSED).count() == n1 == s.count()


def test_silver_invariants(spark, sf_small):
    from pyspark.sql import functions as F

    s = Q.silver(spark, sf_small)
    bad = s.where(
        (F.col("cpu_efficiency") < 0) | (F.col("cpu_efficiency") > 100) | (F.col("memory_efficiency") < 0)
        | (F.col("memory_efficiency") > 100) | (F.col("cpu_hours_wasted") < 0) | (F.col("memory_gb_hours_wasted") < 0)
        | (F.col("req_mem_mb") < 0) | (F.col("max_rss_mb") < 0)
    )
    assert bad.count() == 0
    # one row per job and date
    assert s.groupBy("job_date", "job_id").count().where("count > 1").count() == 0


PLAN_KEYS = ["user_stats", "group_stats", "cluster_summary", "state_distribution", "top_share", "node_stats",
             "gpu_utilization", "queue_grid", "status_summary", "with_group", "latest_per_job", "pseudonymize"]


@pytest.mark.parametrize("key", PLAN_KEYS)
def test_plan_has_no_cross_join_or_python(spark, sf_small, key):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = E.queries()[key](spark, sf_small)._jdf.queryExecution().explainString(mode)
    for w in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert w not in plan, (key, w)
