"""Sums by day, kept beside the jobs.

``<root>/daily_usage/job_date=D/`` holds ``partials.usage_partials`` of date D and
``<root>/daily_efficiency/job_date=D/`` its ``reports.efficiency_partials``. ``build``
makes both from the processed table. From then on every published merge replaces
the rows of the dates it writes and removes those of dates it drops, in the same
journal run as the jobs: a run that dies leaves both or neither. An analysis of any
window then reads some rows for each day and user instead of its jobs.

Sums by day can be added up only if a job stands on one date. Collections see to
that (a job that moved leaves its older date). ``build`` refuses a store where a job
is stored twice; a merge that would put one on a second date, and a plain
``write_silver``, remove the tables, and analyses read the jobs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.operators import partials as P
from jobacct.operators import reports as R
from jobacct.schemas import DATE_COLUMN, SILVER_STORED
from jobacct.session import path_exists
from jobacct.sources import job_index, journal

USAGE, EFFICIENCY = "daily_usage", "daily_efficiency"
_MAKE = {USAGE: P.usage_partials, EFFICIENCY: R.efficiency_partials}


def kept(spark: SparkSession, root: str) -> bool:
    """Whether the store has sums by day."""
    return path_exists(spark, f"{root.rstrip('/')}/{USAGE}")


def _write(run: journal.Run, silver: DataFrame) -> None:
    prepared = R.prepare(silver)
    for table, make in _MAKE.items():
        run.write(make(prepared), table, DATE_COLUMN)


def build(spark: SparkSession, root: str, silver: DataFrame) -> None:
    """Sums of the whole processed table ``silver``, published in one step. One
    shuffle by job proves that none is stored twice, one adds up."""
    twice = silver.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job_id").limit(1).collect()
    if twice:
        raise ValueError(f"job {twice[0][0]} is stored more than once: its days cannot be added up")
    run = journal.Run(spark, root)
    remove(run)  # a rebuild leaves no date that is gone
    run.publish()
    run = journal.Run(spark, root)
    _write(run, silver)
    run.publish()


def remove(run: journal.Run) -> None:
    """The tables go with this run."""
    run.dropped += list(_MAKE)


def _on_two_dates(spark: SparkSession, root: str, new: DataFrame, superseded: DataFrame | None) -> bool:
    """Whether merging ``new`` puts a job on a second date: two in ``new``, or one
    stored elsewhere (by the index, before this run) that is not superseded there."""
    dates = new.select("job_id", DATE_COLUMN)
    held = job_index.lookup(spark, root, new)
    if superseded is not None:
        held = held.join(superseded.select("job_id", DATE_COLUMN), ["job_id", DATE_COLUMN], "left_anti")
    held = held.join(dates.select("job_id").distinct(), "job_id", "left_semi")
    both = dates.unionByName(held).groupBy("job_id").agg(F.min(DATE_COLUMN).alias("a"), F.max(DATE_COLUMN).alias("b"))
    return not both.where("a < b").isEmpty()


def follow(run: journal.Run, new: DataFrame, superseded: DataFrame | None, merged: DataFrame, gone: list[str]) -> None:
    """Bring the sums of a store that keeps them up to date within ``run``:
    ``merged`` are the written dates as they will be, ``gone`` the dates dropped."""
    if not kept(run.spark, run.root):
        return
    if _on_two_dates(run.spark, run.root, new, superseded):
        remove(run)
        return
    _write(run, merged)
    written = set(run.partitions(USAGE))
    done = set(run.partitions(EFFICIENCY))
    run.drop(USAGE, DATE_COLUMN, gone)
    run.drop(EFFICIENCY, DATE_COLUMN, sorted({*gone, *(written - done)}))  # a date may have no COMPLETED job


def read(spark: SparkSession, root: str, table: str, dates: list[str]) -> DataFrame:
    """Sums of ``dates``; other dates are not opened."""
    schema = _MAKE[table](R.prepare(spark.createDataFrame([], SILVER_STORED))).schema
    path = f"{root.rstrip('/')}/{table}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col(DATE_COLUMN).isin(dates))
