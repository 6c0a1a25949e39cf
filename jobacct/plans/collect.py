"""C4 collect / C8 reprocess: keep the store current from accounting dumps.

One plan over every requested date. Dates marked complete are left out (a date
is marked only by a run that read its lines after the date had passed; what the
store happens to hold never skips a date). A date that has archived lines but no
processed rows is rebuilt from the archive, the others are taken from the dump.
Jobs are picked (one shuffle keyed by job) and compared with their stored states;
where a job is stored says the job index, so only dates that hold jobs of this
run are opened. Changed jobs are normalised and merged into the dates they touch,
the dates that settled are marked, and all of it is published in one step
(``sources.journal``): a run that dies is finished or rolled back by the next.

The driver handles dates (one for each day), blocks of job numbers and one row
of metrics, gathered with ``Observation`` during the writes (lines: counted from the
footers of what was written).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobacct.functions.text import job_date
from jobacct.operators import incremental as I
from jobacct.operators import reports as R
from jobacct.operators.normalize import pick_main_and_batch, processed_at_col, silver_from_pairs, typed_from_pairs, with_metrics
from jobacct.schemas import DATE_COLUMN
from jobacct.session import use_utc
from jobacct.sources import job_index, journal
from jobacct.sources import store as ST
from jobacct.sources.accounting import SEQ, with_job_date

METRICS = "raw_records bigint, processed_jobs bigint, inserted_jobs bigint, updated_jobs bigint, skipped_jobs bigint, completed_dates bigint"


def collect(spark: SparkSession, bronze: DataFrame, root: str, as_of: str | dt.date, days: int = 1,
            processed_at=None, every_line: bool = False) -> DataFrame:
    """Run one collection; returns one metrics row (A17). Staged intermediate
    folders are removed before returning.

    ``every_line`` (streams): all lines of ``bronze`` are taken, whatever their
    date and marks; a job is normalised from its new and its archived lines
    together, and no date is marked: later files may add to it."""
    use_utc(spark)
    journal.recover(spark, root)
    with ST.staging_scope(spark):
        return _collect(spark, bronze, root, as_of, days, processed_at, every_line)


def rebuildable(spark: SparkSession, root: str, dates: list[str]) -> list[str]:
    """Those of ``dates`` that the archive holds lines of, but the processed table no rows."""
    have = set(ST.stored_dates(spark, root, ST.PROCESSED))
    missing = [d for d in ST.stored_dates(spark, root, ST.RAW) if d in dates and d not in have]
    return ST.calendar(archived(spark, root, missing).select(DATE_COLUMN)) if missing else []


def archived(spark: SparkSession, root: str, dates: list[str]) -> DataFrame:
    """Archived lines of ``dates``; a line filed under another date than its own is ignored there."""
    return ST.read_table(spark, root, ST.RAW, dates).where(job_date("Start", "Submit") == F.col(DATE_COLUMN))


def stored_states(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(job_date, job_id, state) of the stored rows of the jobs ``ids`` (job_id).
    Opens the index blocks of these jobs and the dates these name."""
    job_index.ensure(spark, root, ST.read_table(spark, root, ST.PROCESSED))
    known = ST.stage(spark, job_index.lookup(spark, root, ids), "collect-known")
    rows = ST.read_table(spark, root, ST.PROCESSED, known.select(DATE_COLUMN)).select(DATE_COLUMN, "job_id", "state")
    return ST.stage(spark, rows.join(known, [DATE_COLUMN, "job_id"], "left_semi"), "collect-stored")


def _collect(spark: SparkSession, bronze: DataFrame, root: str, as_of: str | dt.date, days: int,
             processed_at, every_line: bool) -> DataFrame:
    a = as_of if isinstance(as_of, str) else as_of.isoformat()
    cols = ST.RAW_STORED.names
    lines, todo, rebuild = with_job_date(bronze), [], []
    if every_line:
        lines = lines.where(F.col(DATE_COLUMN).isNotNull())
    else:
        todo = ST.calendar(I.dates_to_collect(I.requested_dates(spark, a, days), ST.read_completed(spark, root)))
        rebuild = rebuildable(spark, root, todo)
        lines = lines.where(F.col(DATE_COLUMN).isin([d for d in todo if d not in rebuild]))
    obs_pairs, obs_new = Observation("pairs"), Observation("new")
    run = journal.Run(spark, root)
    # written once, to the archive's new files: read from there by the keys and the normalisation
    lines = ST.merge_raw(run, lines.select(*cols))
    n_lines = lines.count()
    source, n_rebuilt = lines, 0
    if rebuild:
        from_archive = archived(spark, root, rebuild).select(*cols)
        n_rebuilt = from_archive.count()
        source = lines.unionByName(from_archive)
    if every_line:
        raw = ST.merged_raw(run)
        jobs = lines.select(DATE_COLUMN, "job_id_base").distinct()
        source = raw.join(jobs, [DATE_COLUMN, "job_id_base"], "left_semi")
    ids = source.where("is_main_job").select(F.col("job_id_base").alias("job_id"))
    stored = stored_states(spark, root, ids)
    pairs = I.keep_changed_jobs(pick_main_and_batch(source, SEQ), I.existing_states(stored))
    if every_line:  # a settled job whose batch line came in a later file than its main line
        late = lines.where("is_batch_step").select(DATE_COLUMN, "job_id_base").distinct().withColumn("late", F.lit(True))
        pairs = pairs.join(late, [DATE_COLUMN, "job_id_base"], "left")
        pairs = pairs.withColumn("skipped", F.col("skipped") & F.col("late").isNull())
    pairs = pairs.observe(
        obs_pairs,
        F.count_if("skipped").alias("skipped_jobs"),
        F.count_if(~F.col("skipped") & ~F.col("stored")).alias("inserted_jobs"),
        F.count_if(~F.col("skipped") & F.col("stored")).alias("updated_jobs"),
    )
    new = typed_from_pairs(pairs.where(~F.col("skipped"))).withColumn("processed_date", processed_at_col(processed_at))
    new = ST.stage(spark, new.observe(obs_new, F.count(F.lit(1)).alias("processed_jobs")), "collect-new")
    new = with_metrics(new, F.col("processed_date"))
    n_new = int(obs_new.get.get("processed_jobs", 0))

    # a job that moved to another date leaves the older one
    moved = stored.alias("s").join(new.select("job_id", F.col(DATE_COLUMN).alias("_to")), "job_id").where(F.col(DATE_COLUMN) != F.col("_to"))
    moved = ST.stage(spark, moved.select("job_id", DATE_COLUMN).distinct(), "collect-moved")
    written = ST.merge_silver(run, new, moved) if n_new else []
    done = 0
    if not every_line:
        # dates whose lines this run has read, or that a job has left; of the latter only requested ones can be marked
        seen = {*ST.calendar(lines.select(DATE_COLUMN)), *rebuild, *(d for d in ST.calendar(moved.select(DATE_COLUMN)) if d in todo)}
        rows = ST.read_table(spark, root, ST.PROCESSED, sorted(seen.difference(written, run.dropped_of(ST.PROCESSED)))).select(DATE_COLUMN, "state")
        if written:
            rows = rows.unionByName(ST.read_written(run, ST.PROCESSED).where(F.col(DATE_COLUMN).isin(sorted(seen))).select(DATE_COLUMN, "state"))
        complete = I.date_completeness(rows, a).where("is_complete").select(DATE_COLUMN)
        run.write(ST.new_marks(spark, root, complete, processed_at_col(processed_at)), ST.COMPLETED, DATE_COLUMN)
        done = len(run.partitions(ST.COMPLETED))
    run.publish()
    p = obs_pairs.get
    row = (n_lines + n_rebuilt, n_new, *(int(p.get(f"{k}_jobs", 0)) for k in ("inserted", "updated", "skipped")), done)
    # a one-row table of scalars already computed (nothing passes through the driver)
    return spark.createDataFrame([row], METRICS)


def collection_summary(spark: SparkSession, root: str, as_of: str | dt.date, days: int = 1,
                       groups: DataFrame | None = None) -> dict[str, DataFrame]:
    """C4 after a collection: the reports over all requested dates, those that were
    skipped as complete included. A job stored on two dates counts on the newer
    one (W3). No stored row: empty reports. Lazy: one pruned scan of the dates, one
    shuffle by job, the report's own aggregation."""
    use_utc(spark)
    dates = ST.date_window(as_of, days)
    jobs = R.prepare(ST.dedupe_newest_date(ST.read_table(spark, root, ST.PROCESSED, dates, ignore_corrupt=True)))
    return {
        "daily_usage": R.daily_usage(jobs),
        "cluster_summary": R.cluster_summary(jobs),
        "state_distribution": R.state_distribution(jobs),
        "group_stats": R.group_stats(jobs, groups),
        "efficiency_summary": R.efficiency_summary(jobs),
        "top_wasters": R.top_wasters(jobs),
        "top_users": R.top_users(R.user_stats(jobs)),
    }


def reprocess_missing(spark: SparkSession, root: str, processed_at=None) -> DataFrame:
    """Dates that have raw rows but no processed rows are normalised from
    the archived raw rows and written. Returns the new silver rows."""
    use_utc(spark)
    journal.recover(spark, root)
    missing = archived(spark, root, rebuildable(spark, root, ST.stored_dates(spark, root, ST.RAW)))
    new = silver_from_pairs(pick_main_and_batch(missing.drop(DATE_COLUMN), SEQ), processed_at)
    return ST.upsert_store(spark, root, new)
