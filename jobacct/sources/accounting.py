"""Accounting dump scan (S1) and date-scoped scan.

A dump is text with one job or job step per line and 61 '|'-separated fields,
no header. Lines with any other field count (and empty lines) are dropped.
The CSV reader is not used: it would interpret quotes, and fields may hold
any text except '|'.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.functions.text import is_batch_step, is_finished, is_main_job, job_date, job_id_base
from jobacct.schemas import ACCOUNTING_FIELDS, DATE_COLUMN, N_ACCOUNTING_FIELDS

SEQ = "seq"


def line_sequence() -> Column:
    """Order of a line within a text scan: file, split start, then position
    inside the split. Needed for last-wins / first-wins rules, taken on the
    scan before any shuffle can reorder rows."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def with_step_flags(df: DataFrame) -> DataFrame:
    """Add the four computed bronze columns."""
    return df.withColumns(
        {
            "job_id_base": job_id_base("JobID"),
            "is_batch_step": is_batch_step("JobID"),
            "is_main_job": is_main_job("JobID"),
            "is_finished": is_finished("State"),
        }
    )


def parse_accounting_lines(lines: DataFrame, value: str = "value", seq: str | None = SEQ) -> DataFrame:
    """Text lines -> bronze (61 string fields + 4 computed, + ``seq`` if given).

    Narrow transformation only: split, size gate, projection."""
    parts = F.split(F.col(value), r"\|", -1)
    keep = [F.col(seq)] if seq else []
    # The split array is produced by a generator (explode of a one-element
    # array): predicates on the fields then stay above it, instead of being
    # pushed below with ``split(value)`` inlined once per field they use.
    split = lines.select(F.explode(F.array(parts)).alias("_f"), *keep).where(F.size("_f") == N_ACCOUNTING_FIELDS)
    # get: a plan may take a field before it tests the size
    fields = [f"get(_f, {i}) AS `{name}`" for i, name in enumerate(ACCOUNTING_FIELDS)]
    return with_step_flags(split.selectExpr(*fields, *([seq] if seq else [])))


def read_accounting_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read dump files (a file, folder or glob) into bronze with ``seq``."""
    lines = spark.read.text(path).select("value", line_sequence().alias(SEQ))
    return parse_accounting_lines(lines)


def with_job_date(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn(DATE_COLUMN, job_date("Start", "Submit"))


def read_accounting_day(bronze: DataFrame, dates: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose own job date is one of ``dates``.

    ``dates`` is a list of 'yyyy-MM-dd' texts or a one-column DataFrame of them
    (a calendar: one row per day, so it is broadcast)."""
    df = with_job_date(bronze)
    if isinstance(dates, DataFrame):
        cal = dates.select(F.col(dates.columns[0]).alias(DATE_COLUMN)).distinct()
        return df.join(F.broadcast(cal), DATE_COLUMN, "left_semi")
    return df.where(F.col(DATE_COLUMN).isin(list(dates)))
