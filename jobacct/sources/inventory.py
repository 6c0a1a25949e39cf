"""Node inventories (S4, S5) and node descriptions.

Inputs are text lines with an order column (``line_no``, or the scan
sequence of ``read_lines``). Duplicate nodes: the last valid line wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.functions.text import gres_gpus, strip_ws, to_int
from jobacct.sources.accounting import line_sequence


def read_lines(spark: SparkSession, path: str | list[str], order: str = "line_no") -> DataFrame:
    """Text lines ``(value, <order>)`` in file / split / line order."""
    return spark.read.text(path).select("value", line_sequence().alias(order))


def _two_parts(lines: DataFrame, order: str) -> DataFrame:
    parts = F.split(strip_ws("value"), ",", -1)
    return (
        lines.where(F.length(strip_ws("value")) > 0)
        .select(F.explode(F.array(parts)).alias("_p"), F.col(order).alias("_o"))
        .where(F.size("_p") == 2)
        .select(F.col("_p")[0].alias("node"), F.col("_p")[1].alias("_v"), "_o")
    )


def parse_node_cpus(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """S4: 'node,cpus' lines -> ``(node, cpus)``; non-integer cpus skipped."""
    p = _two_parts(lines, order).withColumn("cpus", to_int(F.col("_v")))
    return p.where(F.col("cpus").isNotNull()).groupBy("node").agg(F.max_by("cpus", "_o").alias("cpus"))


def gres_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """P14 on every 2-part 'node,gres' line: ``(node, gres, gpus, _o)``,
    gpus null when the line names no GPU count."""
    p = _two_parts(lines, order)
    return p.select("node", F.col("_v").alias("gres"), gres_gpus(F.col("_v")).alias("gpus"), "_o")


def parse_node_gpus(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """S5: 'node,gres' lines -> ``(node, gpus)`` for lines with a GPU count."""
    g = gres_lines(lines, order).where(F.col("gpus").isNotNull())
    return g.groupBy("node").agg(F.max_by("gpus", "_o").alias("gpus"))


def node_total_cores(desc: DataFrame) -> DataFrame:
    """``(node, line_no, value)`` description lines -> ``(node, cores)``:
    the integer after 'CPUTot=' on the first line mentioning CPUTot, else 0."""
    d = desc.where(F.col("value").contains("CPUTot"))
    v = F.regexp_extract("value", r"CPUTot=(\S+)", 1).try_cast("bigint")
    first = d.groupBy("node").agg(F.min_by(v, "line_no").alias("cores"))
    return first.select("node", F.coalesce("cores", F.lit(0).cast("bigint")).alias("cores"))
