"""Node usage and node inventory.

A job's reserved hours are split evenly over the nodes of its node list:
jobs are summed by node list, each distinct list becomes rows (ranges in
chunks), which are aggregated per node with partial aggregation before the
shuffle, so a node hit by a third of all jobs is combined map-side. The inventory is
joined to the per-node result (one row per node), never to job rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobacct.functions.nodes import explode_nodes, node_count
from jobacct.operators.reports import analysis_period, scalar
from jobacct.schemas import DEFAULT_NODE_CPUS


def node_usage(df: DataFrame) -> DataFrame:
    """G1 + P25 + F3: one row per (job, node) with the job's CPU / GPU / elapsed
    hours divided by its node count. Jobs without nodes are dropped first."""
    jobs = df.where(F.col("node_list") != "").withColumn("_n", node_count("node_list")).where(F.col("_n") > 0)
    per = explode_nodes(jobs, "node_list", "_node").where(F.col("_node").isNotNull()).select(
        F.col("_node").alias("node"),
        (F.col("cpu_hours_reserved") / F.col("_n")).alias("cpu_hours"),
        (F.col("gpu_hours_reserved") / F.col("_n")).alias("gpu_hours"),
        ((F.col("elapsed_seconds") / 3600) / F.col("_n")).alias("elapsed_hours"),
    )
    return per


#: Reserved and elapsed hours are whole seconds over 3600; sums are made of the seconds.
SECONDS = {"cpu_hours": "total_cpu_hours", "gpu_hours": "total_gpu_hours", "elapsed_hours": "total_elapsed_hours"}


def _whole_seconds(hours) -> Column:
    return F.coalesce(F.round(hours * 3600).cast("bigint"), F.lit(0))


def _exact_totals(by_list: DataFrame, *more: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Per-node totals from rows (node_list, n, jobs, seconds of each kind), one
    for each distinct node list. Seconds are summed exactly per (node, n) and
    divided once by n * 3600; the few sizes n of a node are added in order, so
    the result is the unrounded sum and does not depend on tasks."""
    rows = explode_nodes(by_list, "node_list")
    per_n = rows.groupBy("node", "n").agg(*(F.sum(c).alias(c) for c in SECONDS), F.sum("jobs").alias("jobs"), *more)
    total = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("n", c))), F.lit(0.0), lambda a, x: a + x[c] / (F.greatest(x["n"], F.lit(1)) * 3600.0))
    return per_n, {out: total(c).alias(out) for c, out in SECONDS.items()}


def _lists(jobs: DataFrame, *more: Column) -> DataFrame:
    """Jobs summed by node list before any list is expanded."""
    g = jobs.groupBy(F.when(F.col("node_list") != "", F.col("node_list")).alias("node_list")).agg(
        F.sum(_whole_seconds(F.col("cpu_hours_reserved"))).alias("cpu_hours"),
        F.sum(_whole_seconds(F.col("gpu_hours_reserved"))).alias("gpu_hours"),
        F.sum(F.coalesce(F.col("elapsed_seconds"), F.lit(0))).cast("bigint").alias("elapsed_hours"),
        F.count(F.lit(1)).alias("jobs"),
        *more,
    )
    return g.withColumn("n", node_count("node_list"))


def node_totals(prepared: DataFrame) -> DataFrame:
    """Per-node sums of the jobs' even shares."""
    per_n, totals = _exact_totals(_lists(prepared))
    return per_n.where(F.col("node").isNotNull()).groupBy("node").agg(*totals.values(), F.sum("jobs").alias("job_count"))


def node_stats(prepared: DataFrame, inventory: DataFrame, period: DataFrame) -> DataFrame:
    """A3 + J4: per-node totals with the node's CPU count (null when the node
    is not in the inventory) and its utilisation over ``period`` days (may
    exceed 100 %; null when the CPU count is unknown or 0)."""
    return node_stats_from_totals(node_totals(prepared), inventory, period)


def nodes_missing_cpu(stats: DataFrame) -> DataFrame:
    """nodes whose CPU count is unknown."""
    return stats.where(F.col("est_cpus").isNull()).select("node", "total_cpu_hours")


def top_nodes(stats: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` nodes by CPU hours (ties by node)."""
    return stats.orderBy(F.col("total_cpu_hours").desc(), F.col("node")).limit(k)


def gpu_utilization(stats: DataFrame, inventory: DataFrame, period: DataFrame) -> DataFrame:
    """A4 + F5 + J5: GPU nodes (GPU hours > 0 and a known GPU count > 0) with
    their GPU-hours capacity over ``period`` days and utilisation."""
    inv = inventory.select("node", F.col("gpus").alias("est_gpus"))
    g = stats.where(F.col("total_gpu_hours") > 0).select("node", "total_gpu_hours").join(inv, "node", "left")
    g = g.where(F.col("est_gpus").isNotNull() & (F.col("est_gpus") > 0)).withColumn("_period", scalar(period))
    avail = F.col("est_gpus") * F.col("_period") * 24
    return g.select(
        "node", "total_gpu_hours", "est_gpus", avail.alias("gpu_hours_available"),
        (F.col("total_gpu_hours") / avail * 100).alias("gpu_utilization_pct"),
    )


def node_inventory(cpus: DataFrame, gpus: DataFrame) -> DataFrame:
    """CPU inventory full-outer GPU inventory. A node with only a GPU line
    gets 64 CPUs; a node without a GPU line has 0 GPUs."""
    j = cpus.join(gpus, "node", "full_outer")
    return j.select(
        "node",
        F.coalesce("cpus", F.lit(DEFAULT_NODE_CPUS).cast("bigint")).alias("cpus"),
        F.coalesce("gpus", F.lit(0).cast("bigint")).alias("gpus"),
    )


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """Nodes, total CPUs, total GPUs, nodes with GPUs."""
    return inventory.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.coalesce(F.sum("cpus"), F.lit(0)).cast("bigint").alias("total_cpus"),
        F.coalesce(F.sum("gpus"), F.lit(0)).cast("bigint").alias("total_gpus"),
        F.count_if(F.col("gpus") > 0).alias("gpu_nodes"),
    )


def node_totals_and_period(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-node totals and the analysis period from ONE pass over the jobs.

    Jobs are summed by node list first; a list is expanded once
    (``explode_outer``: jobs without nodes give one row with a null node), so
    the per-node aggregate also carries every job's submit / end time. The
    period (A12) is then a tiny aggregate over the per-node rows."""
    by_list = _lists(prepared, F.min("submit_time").alias("_min_submit"), F.max("end_time").alias("_max_end"))
    per_n, totals = _exact_totals(by_list, F.min("_min_submit").alias("_min_submit"), F.max("_max_end").alias("_max_end"))
    per = per_n.groupBy("node").agg(
        *totals.values(),
        F.sum("jobs").alias("job_count"),
        F.min("_min_submit").alias("_min_submit"),
        F.max("_max_end").alias("_max_end"),
    )
    from jobacct.functions.metrics import analysis_days
    from jobacct.sources.store import stage

    # one row per node (bounded by the cluster): staged so that the period
    # and the statistics read this small table instead of the jobs again
    per = stage(prepared.sparkSession, per, "node-totals")
    period = per.agg(analysis_days(F.min("_min_submit"), F.max("_max_end")).alias("period_days"))
    totals = per.where(F.col("node").isNotNull()).drop("_min_submit", "_max_end")
    return totals, period


def node_stats_from_totals(totals: DataFrame, inventory: DataFrame, period: DataFrame) -> DataFrame:
    inv = inventory.select("node", F.col("cpus").alias("est_cpus"))
    s = totals.join(inv, "node", "left").withColumn("_period", scalar(period))
    avail = F.col("est_cpus") * F.col("_period") * 24
    return s.select(
        "node", "total_cpu_hours", "total_gpu_hours", "total_elapsed_hours", "job_count", "est_cpus",
        F.when(F.col("est_cpus").isNotNull(), avail).alias("cpu_hours_available"),
        (F.try_divide(F.col("total_cpu_hours"), avail.cast("double")) * 100).alias("cpu_utilization_pct"),
    )


def node_report(prepared: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """The node section of the analysis (one pass over the jobs)."""
    usage = node_usage(prepared)
    totals, period = node_totals_and_period(prepared)
    stats = node_stats_from_totals(totals, inventory, period)
    return {
        "node_usage": usage,
        "node_stats": stats,
        "nodes_missing_cpu": nodes_missing_cpu(stats),
        "top_nodes": top_nodes(stats),
        "gpu_utilization": gpu_utilization(stats, inventory, period),
    }
