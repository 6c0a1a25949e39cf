"""C6 current (live-queue report) and C7 nodes (inventory report) over
text dumps: what a user points at the files the scheduler printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.operators import nodes as ND
from jobacct.operators import queue as QU
from jobacct.sources import inventory as INV
from jobacct.sources.queue import read_queue_text


def node_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Node description dumps, one file per node named after it
    (``<dir>/<node>.txt``) -> ``(node, line_no, value)``."""
    lines = INV.read_lines(spark, path)
    node = F.regexp_extract(F.col("line_no.file"), r"([^/]+?)(\.txt)?$", 1)
    return lines.select(node.alias("node"), F.col("line_no").alias("line_no"), "value")


def current(spark: SparkSession, queue_path: str, node_cores: DataFrame) -> dict[str, DataFrame]:
    """Queue usage in cores and nodes mode, totals, the grid and its display
    pivots (the partition list for the pivot comes from a small aggregate)."""
    usage = QU.queue_usage(read_queue_text(spark, queue_path), node_cores)
    grid = QU.queue_grid(usage)
    partitions = [r[0] for r in usage.select("partition").where(F.col("partition").isNotNull()).distinct().collect()]
    return {
        "usage": usage,
        "totals": QU.queue_totals(usage),
        "grid": grid,
        "cores_grid": QU.grid_wide(grid, partitions, "cores_cell"),
        "nodes_grid": QU.grid_wide(grid, partitions, "nodes_cell"),
        "widths": QU.max_lengths(grid),
    }


def nodes(spark: SparkSession, cpu_path: str, gpu_path: str) -> dict[str, DataFrame]:
    """Merged CPU / GPU inventory sorted by node, and its summary."""
    inv = ND.node_inventory(INV.parse_node_cpus(INV.read_lines(spark, cpu_path)), INV.parse_node_gpus(INV.read_lines(spark, gpu_path)))
    return {"inventory": inv.orderBy("node"), "summary": ND.inventory_summary(inv)}
