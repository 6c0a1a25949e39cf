"""Live-queue usage.

A row on a node held exclusively (oversubscribe NO / USER) counts the whole
node's cores, once per (user, node): the first such row by line order wins
and later ones are skipped, in cores and in nodes mode alike. Other rows
count their cores (cores mode) or nodes (nodes mode). Both modes come out of
one plan as two sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobacct.functions.nodes import expand_nodes
from jobacct.schemas import EXCLUSIVE_OVERSUBSCRIBE


def counted_rows(queue: DataFrame, node_cores: DataFrame) -> DataFrame:
    """Rows that count, with their ``cores_val`` / ``nodes_val``.

    W4: first exclusive row per (user, node) by ``line_no`` (the plan gets a
    per-group top-1 limit before the shuffle). J8: its value is the node's
    total cores (0 if unknown); a node list is looked up by its first node."""
    excl = F.coalesce(F.col("oversubscribe").isin(*EXCLUSIVE_OVERSUBSCRIBE), F.lit(False))
    w = Window.partitionBy("user", "node").orderBy("line_no")
    ex = queue.where(excl).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    ex = ex.withColumn("_lookup", F.get(expand_nodes("node"), 0))
    nc = node_cores.select(F.col("node").alias("_lookup"), F.col("cores").alias("_node_cores"))
    ex = ex.join(nc, "_lookup", "left").withColumn("_v", F.coalesce("_node_cores", F.lit(0).cast("bigint")))
    ex = ex.select("line_no", "user", "partition", "status", F.col("_v").alias("cores_val"), F.col("_v").alias("nodes_val"))
    other = queue.where(~excl).select(
        "line_no", "user", "partition", "status", F.col("cores").alias("cores_val"), F.col("nnodes").alias("nodes_val")
    )
    return ex.unionByName(other)


def queue_usage(queue: DataFrame, node_cores: DataFrame) -> DataFrame:
    """``(user, partition, status, cores, nodes, first_line)``."""
    return counted_rows(queue, node_cores).groupBy("user", "partition", "status").agg(
        F.sum("cores_val").alias("cores"),
        F.sum("nodes_val").alias("nodes"),
        F.min("line_no").alias("first_line"),
    )


def queue_totals(usage: DataFrame) -> DataFrame:
    """Totals per (partition, status), per status and per (user, status)
    as one grouping-sets aggregation; ``level`` names the set."""
    g = usage.groupingSets(
        [["partition", "status"], ["status"], ["user", "status"]], "user", "partition", "status"
    ).agg(
        F.sum("cores").alias("cores"),
        F.sum("nodes").alias("nodes"),
        F.grouping("user").alias("_gu"),
        F.grouping("partition").alias("_gp"),
    )
    level = F.when(F.col("_gu") == 0, F.lit("user_status")).when(F.col("_gp") == 0, F.lit("partition_status")).otherwise(F.lit("status"))
    return g.select(level.alias("level"), "user", "partition", "status", "cores", "nodes")


def _summary(items: Column, value: str) -> Column:
    """'R=2 / PD=1' from an array of structs sorted by first appearance."""
    return F.array_join(F.transform(items, lambda s: F.concat(s["status"], F.lit("="), s[value].cast("string"))), " / ")


def status_summary(usage: DataFrame) -> DataFrame:
    """P24 per (user, partition): statuses in first-seen order, both modes.
    A cell holds at most one entry per status, so the list is small."""
    items = F.array_sort(F.collect_list(F.struct("first_line", "status", "cores", "nodes")))
    return usage.groupBy("user", "partition").agg(items.alias("_i")).select(
        "user", "partition", _summary(F.col("_i"), "cores").alias("cores_summary"),
        _summary(F.col("_i"), "nodes").alias("nodes_summary"),
    )


def queue_grid(usage: DataFrame) -> DataFrame:
    """A18 in long form ``(user, partition, cores_cell, nodes_cell)``:
    user x partition cells, a 'Total' column per user (statuses combined in
    the order they are met going through the user's partitions in first-seen
    order), and a footer row labelled '<n> users' with per-partition and
    grand totals. Missing cells are not emitted; ``grid_wide`` pivots with a
    '-' fill for display."""
    from jobacct.sources.store import stage

    # read five times below: materialised once (one row per user, partition
    # and status) in the checkpoint folder
    usage = stage(usage.sparkSession, usage, "queue-usage")
    cells = status_summary(usage).select("user", "partition", "cores_summary", "nodes_summary")

    pfirst = usage.groupBy("user", "partition").agg(F.min("first_line").alias("_pf"))
    per_user = usage.join(pfirst, ["user", "partition"]).groupBy("user", "status").agg(
        F.min(F.struct("_pf", "first_line")).alias("_k"), F.sum("cores").alias("cores"), F.sum("nodes").alias("nodes")
    )
    ut_items = F.array_sort(F.collect_list(F.struct("_k", "status", "cores", "nodes")))
    user_tot = per_user.groupBy("user").agg(ut_items.alias("_i")).select(
        "user", F.lit("Total").alias("partition"), _summary(F.col("_i"), "cores").alias("cores_summary"),
        _summary(F.col("_i"), "nodes").alias("nodes_summary"),
    )

    n_users = usage.agg(F.concat(F.countDistinct("user").cast("string"), F.lit(" users")).alias("_label"))
    by_part = usage.groupBy("partition", "status").agg(
        F.min("first_line").alias("first_line"), F.sum("cores").alias("cores"), F.sum("nodes").alias("nodes")
    )
    pt = by_part.groupBy("partition").agg(F.array_sort(F.collect_list(F.struct("first_line", "status", "cores", "nodes"))).alias("_i"))
    part_tot = pt.select("partition", _summary(F.col("_i"), "cores").alias("cores_summary"), _summary(F.col("_i"), "nodes").alias("nodes_summary"))
    by_status = usage.groupBy("status").agg(
        F.min("first_line").alias("first_line"), F.sum("cores").alias("cores"), F.sum("nodes").alias("nodes")
    )
    gt = by_status.agg(F.array_sort(F.collect_list(F.struct("first_line", "status", "cores", "nodes"))).alias("_i"))
    grand = gt.select(F.lit("Total").alias("partition"), _summary(F.col("_i"), "cores").alias("cores_summary"), _summary(F.col("_i"), "nodes").alias("nodes_summary"))
    from jobacct.operators.reports import scalar

    footer = part_tot.unionByName(grand).select(scalar(n_users).alias("user"), "partition", "cores_summary", "nodes_summary")
    out = cells.unionByName(user_tot).unionByName(footer)
    return out.select("user", "partition", F.col("cores_summary").alias("cores_cell"), F.col("nodes_summary").alias("nodes_cell"))


def grid_wide(grid: DataFrame, partitions: list[str], cell: str = "cores_cell") -> DataFrame:
    """Display pivot: one row per user, one column per partition (sorted),
    plus 'Total'; missing cells '-'. ``partitions`` is passed explicitly so
    the pivot needs no extra job to find them."""
    cols = sorted(partitions) + ["Total"]
    return grid.groupBy("user").pivot("partition", cols).agg(F.first(cell)).fillna("-", subset=cols).orderBy("user")


def max_lengths(df: DataFrame) -> DataFrame:
    """Longest text per column (display widths), one aggregation."""
    return df.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in df.columns])
