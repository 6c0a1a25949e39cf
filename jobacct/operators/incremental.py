"""Incremental collection rules.

All of them are joins against the stored state, so one plan handles any
number of dates: nothing is looped over on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.functions.text import normalize_state
from jobacct.schemas import ACTIVE_STORED_STATES, DATE_COLUMN, INCOMPLETE_JOB_STATES


def requested_dates(spark: SparkSession, as_of: str | dt.date, days: int) -> DataFrame:
    """``as_of - days`` .. ``as_of`` as a one-column DataFrame (a calendar:
    one row per day)."""
    a = as_of if isinstance(as_of, str) else as_of.isoformat()
    end = F.to_date(F.lit(a))
    seq = F.sequence(F.date_sub(end, days), end)
    return spark.range(1).select(F.explode(seq).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias(DATE_COLUMN))


def dates_to_collect(requested: DataFrame, completed: DataFrame) -> DataFrame:
    """F8 + J9: requested dates that are not marked complete."""
    done = completed.select(DATE_COLUMN).distinct()
    return requested.join(F.broadcast(done), DATE_COLUMN, "left_anti")


def existing_states(silver: DataFrame) -> DataFrame:
    """J7 input: stored state of every job, keyed by its date."""
    return silver.select(DATE_COLUMN, F.col("job_id").alias("job_id_base"), F.col("state").alias("old_state"))


def incremental_filter(raw: DataFrame, existing: DataFrame, normalize_states: bool = True) -> DataFrame:
    """F7 (+ J7), row level: ``raw`` (bronze with ``job_date``) left-joined to the
    stored states. A row of a job stored in a finished state (not RUNNING,
    PENDING, SUSPENDED) is skipped, unless it is the main row and its state
    differs from the stored one. Adds ``skipped``; keep ``~skipped``.

    ``normalize_states`` compares 'CANCELLED by N' as 'CANCELLED' (stored
    states are normalised); False gives the literal comparison."""
    j = raw.join(existing, [DATE_COLUMN, "job_id_base"], "left")
    new_state = normalize_state("State") if normalize_states else F.col("State")
    settled = F.col("old_state").isNotNull() & ~F.col("old_state").isin(*ACTIVE_STORED_STATES)
    unchanged_main = F.col("is_main_job") & (new_state == F.col("old_state"))
    skip = settled & (unchanged_main | ~F.col("is_main_job"))
    return j.withColumn("skipped", F.coalesce(skip, F.lit(False))).drop("old_state")


def keep_changed_jobs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """F7 at job level, for collection (``pairs``: one row per job and date
    with its picked main / batch lines). A job stored in a finished state is
    re-processed only when its main state changed, and then WITH its batch
    step (so its CPU time and memory are not lost). Adds ``skipped`` and
    ``stored`` (the job was already in the store)."""
    j = pairs.join(existing, [DATE_COLUMN, "job_id_base"], "left")
    settled = F.col("old_state").isNotNull() & ~F.col("old_state").isin(*ACTIVE_STORED_STATES)
    skip = settled & (normalize_state(F.col("m.State")) == F.col("old_state"))
    return j.withColumns({"skipped": F.coalesce(skip, F.lit(False)), "stored": F.col("old_state").isNotNull()}).drop("old_state")


def date_completeness(silver: DataFrame, as_of: str | dt.date | None = None) -> DataFrame:
    """``(job_date, is_complete)``: complete when no job of the date is in
    one of the 17 changeable states. With ``as_of``, a date on or after it is
    never complete (jobs of that day may still be submitted)."""
    ok = F.bool_and(~F.col("state").isin(*INCOMPLETE_JOB_STATES))
    out = silver.groupBy(DATE_COLUMN).agg(ok.alias("is_complete"))
    if as_of is not None:
        a = as_of if isinstance(as_of, str) else as_of.isoformat()
        out = out.withColumn("is_complete", F.col("is_complete") & (F.col(DATE_COLUMN) < F.lit(a)))
    return out
