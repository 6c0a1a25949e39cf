"""Frame-level checks: metrics, node usage, inventory (values restated from
the reference's tests) and plan-shape invariants."""

import datetime as dt

from pyspark.sql import functions as F

from jobacct.functions import metrics as M
from jobacct.operators import nodes as ND
from jobacct.operators import reports as R
from jobacct.sources import inventory as INV


def test_efficiency_and_waste(spark):
    df = spark.createDataFrame([(3600, 4, 7200.0, 4096.0, 2048.0), (3600, 4, 3600.0, 4096.0, 1024.0), (0, 4, 0.0, 0.0, 0.0)],
                               "e long, c long, t double, q double, r double")
    rows = df.select(
        M.cpu_efficiency("t", "e", "c"), M.memory_efficiency("r", "q"), M.cpu_hours_wasted("t", "e", "c"),
        M.memory_gb_hours_wasted("q", "r", "e"),
    ).collect()
    assert tuple(rows[0]) == (50.0, 50.0, 2.0, 2.0)
    assert tuple(rows[1]) == (25.0, 25.0, 3.0, 3.0)
    assert tuple(rows[2]) == (0.0, 0.0, 0.0, 0.0)


def test_node_usage_split(spark):
    df = spark.createDataFrame([("node[001-004]", 100.0, 20.0, 7200), ("node-001", 100.0, 10.0, 3600), ("", 5.0, 0.0, 10)],
                               "node_list string, cpu_hours_reserved double, gpu_hours_reserved double, elapsed_seconds long")
    u = ND.node_usage(df).collect()
    assert len(u) == 5
    four = [r for r in u if r.node.startswith("node0")]
    assert {r.cpu_hours for r in four} == {25.0} and {r.gpu_hours for r in four} == {5.0} and {r.elapsed_hours for r in four} == {0.5}
    # hours are conserved by the split
    assert sum(r.cpu_hours for r in u) == 200.0


def test_node_utilization(spark):
    usage = spark.createDataFrame([("n1", 25.0, 0.0, 3600), ("n1", 15000.0, 0.0, 3600), ("n2", 5.0, 1.0, 3600)],
                                  "node_list string, cpu_hours_reserved double, gpu_hours_reserved double, elapsed_seconds long")
    inv = spark.createDataFrame([("n1", 64, 0)], "node string, cpus long, gpus long")
    period = spark.createDataFrame([(7,)], "period_days long")
    s = {r.node: r for r in ND.node_stats(usage, inv, period).collect()}
    assert s["n1"].cpu_hours_available == 64 * 7 * 24
    assert abs(s["n1"].cpu_utilization_pct - 15025 / 10752 * 100) < 1e-9  # over 100 % is allowed
    assert s["n2"].est_cpus is None and s["n2"].cpu_utilization_pct is None
    assert [r.node for r in ND.nodes_missing_cpu(ND.node_stats(usage, inv, period)).collect()] == ["n2"]


def test_inventory_merge(spark):
    cpu = spark.createDataFrame([("a,8", 1), ("b,16", 2), ("a,32", 3), ("c,x", 4), ("d,1,2", 5)], "value string, line_no long")
    gpu = spark.createDataFrame([("a,gpu:4", 1), ("z,gpu:v100:8(S:0-1)", 2), ("b,(null)", 3)], "value string, line_no long")
    inv = {r.node: (r.cpus, r.gpus) for r in ND.node_inventory(INV.parse_node_cpus(cpu), INV.parse_node_gpus(gpu)).collect()}
    assert inv == {"a": (32, 4), "b": (16, 0), "z": (64, 8)}
    s = ND.inventory_summary(ND.node_inventory(INV.parse_node_cpus(cpu), INV.parse_node_gpus(gpu))).collect()[0]
    assert (s.total_nodes, s.total_cpus, s.total_gpus, s.gpu_nodes) == (3, 112, 12, 2)


def test_analysis_period(spark):
    t = lambda *a: dt.datetime(*a)
    df = spark.createDataFrame([(t(2024, 1, 1, 10), t(2024, 1, 3, 0))], "submit_time timestamp, end_time timestamp")
    assert R.analysis_period(df).collect()[0].period_days == 2
    df = spark.createDataFrame([(None, None)], "submit_time timestamp, end_time timestamp")
    assert R.analysis_period(df).collect()[0].period_days == 7


def test_groups_last_wins(spark):
    from jobacct.sources.groups import groups_table

    g = {r.user: r.group for r in groups_table(spark, {"physics": ["alice", "bob"], "chemistry": ["bob"]}).collect()}
    assert g == {"alice": "physics", "bob": "chemistry"}
