"""S3: live-queue snapshot 'user/status/nnodes/partition/cores/node/oversubscribe'.

Lines that do not split into exactly 7 fields or whose node / core counts
are not integers are dropped; that removes the header line wherever it is,
and a malformed line costs one row instead of the whole snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.functions.text import to_int
from jobacct.sources.inventory import read_lines


def parse_queue_lines(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """``(value, <order>)`` lines -> QUEUE rows ``(line_no, user, status,
    nnodes, partition, cores, node, oversubscribe)``."""
    parts = F.split(F.col("value"), "/", -1)
    p = lines.where(F.trim("value") != "").select(F.explode(F.array(parts)).alias("_p"), F.col(order).alias("line_no"))
    p = p.where(F.size("_p") == 7)
    num = lambda i: to_int(F.col("_p")[i])
    out = p.select(
        "line_no",
        F.col("_p")[0].alias("user"),
        F.col("_p")[1].alias("status"),
        num(2).alias("nnodes"),
        F.col("_p")[3].alias("partition"),
        num(4).alias("cores"),
        F.col("_p")[5].alias("node"),
        F.col("_p")[6].alias("oversubscribe"),
    )
    return out.where(F.col("nnodes").isNotNull() & F.col("cores").isNotNull())


def read_queue_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_queue_lines(read_lines(spark, path))
