"""The date-partitioned Parquet store.

Layout under a store root::

    processed/job_date=YYYY-MM-DD/part-*.parquet   silver, one row per job
    raw/job_date=YYYY-MM-DD/part-*.parquet         bronze + line sequence
    completed/job_date=YYYY-MM-DD/part-*.parquet   dates that need no re-collection
    jobs/job_block=B/part-*.parquet                on which date a job is stored (``job_index``)
    daily_*/job_date=YYYY-MM-DD/part-*.parquet     sums by day, if kept (``daily``)

Reads always pass the declared schema (files written before a column existed
read it as null instead of failing the union) and filter on ``job_date`` so
only the requested date folders are listed and opened (partition pruning).
Plain writes replace only the date partitions present in the written data
(dynamic partition overwrite). An upsert writes the merged dates beside the
tables and publishes them by moving folders (``journal``): the store is never
read and overwritten by the same job, and a run that dies at any point is
finished or rolled back by the next one.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.functions import text as X
from jobacct.operators import normalize as N
from jobacct.schemas import BRONZE_STORED, DATE_COLUMN, SILVER_COLUMNS, SILVER_STORED
from jobacct.session import path_exists, scratch_path
from jobacct.sources import daily, job_index, journal
from jobacct.sources.accounting import SEQ

PROCESSED, RAW, COMPLETED = "processed", "raw", "completed"
# fields that differ from line to line, equal ones side by side, then the rest: a packed line
# in this order has few places where it differs from the line before it, and compresses better
PACKED_ORDER = (
    "JobID", "JobIDRaw", "job_id_base", "JobName", "Submit", "Eligible", "Start", "End", "Elapsed", "CPUTime", "TotalCPU", "MaxRSS",
    "ElapsedRaw", "CPUTimeRAW", "AllocCPUS", "ReqCPUS", "NCPUS", "ReqTRES", "AllocTRES", "ReqMem", "AllocNodes", "ReqNodes", "NNodes",
    "NodeList", "Priority", "UID", "User", "WorkDir", "Partition", "State",
)
# jobs of a date that one task merges
JOBS_PER_TASK = 400_000
RAW_STORED = T.StructType(
    BRONZE_STORED.fields[:-1]
    + [
        T.StructField(
            "seq",
            T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("pos", T.LongType())]),
        ),
        BRONZE_STORED.fields[-1],
    ]
)
COMPLETED_SCHEMA = T.StructType([T.StructField("marked_at", T.TimestampType()), T.StructField(DATE_COLUMN, T.StringType())])
SCHEMAS = {PROCESSED: SILVER_STORED, RAW: RAW_STORED, COMPLETED: COMPLETED_SCHEMA}


def _path(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


def _as_date(d: str | dt.date) -> str:
    return d if isinstance(d, str) else d.strftime("%Y-%m-%d")


def date_window(as_of: str | dt.date, days: int) -> list[str]:
    """``days`` back from ``as_of`` inclusive: days + 1 dates, ascending."""
    end = dt.date.fromisoformat(_as_date(as_of))
    return [(end - dt.timedelta(days=i)).isoformat() for i in range(days, -1, -1)]


def read_table(spark: SparkSession, root: str, kind: str, dates: list[str] | DataFrame | None = None,
               ignore_corrupt: bool = False) -> DataFrame:
    """Read one store table with its declared schema; no folder -> empty.

    An unreadable file raises, so nothing is ever merged against part of a
    date; the reporting loads (S6-S8) pass ``ignore_corrupt``.

    ``dates``: a list, or a one-column DataFrame of dates that is brought to the
    driver first (a calendar: one row per day). Either way the scan has a
    partition filter: other dates are not opened."""
    schema = SCHEMAS[kind]
    path = _path(root, kind)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", str(ignore_corrupt).lower())
        .option("basePath", path)
        .parquet(path)
    )
    if dates is None:
        return df
    return df.where(F.col(DATE_COLUMN).isin(calendar(dates) if isinstance(dates, DataFrame) else list(dates)))


def calendar(dates: DataFrame) -> list[str]:
    """The distinct dates of a one-column DataFrame: one for each day."""
    return sorted(r[0] for r in dates.distinct().collect() if r[0] is not None)


def write_table(df: DataFrame, root: str, kind: str, mode: str = "overwrite") -> None:
    """Write date partitions; with ``overwrite`` only the dates present in
    ``df`` are replaced. The REBALANCE hint clusters rows by date and lets
    AQE size the write tasks: a large date is split over several tasks
    (files of about the advisory partition size), small dates are merged, so
    neither one task per day nor many tiny files."""
    cols = [f.name for f in SCHEMAS[kind].fields]
    if kind == PROCESSED:
        df = df.select(*cols)
        out = N.restored_metrics(N.without_metrics(df).hint("rebalance", DATE_COLUMN), df.schema)
    else:
        out = dealt_raw(df) if kind == RAW else df.select(*cols).hint("rebalance", DATE_COLUMN)
    (
        out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", journal.COMPRESSION)
        .partitionBy(DATE_COLUMN)
        .parquet(_path(root, kind))
    )


def stored_dates(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Dates with a partition folder, ascending: a listing, no file is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_path(root, kind))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(n.partition("=")[2] for n in names if n.startswith(DATE_COLUMN + "="))


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


class staging_scope:
    """Folders staged inside the scope are deleted when it exits: for plans
    (such as collect) whose staged data is fully consumed before they return.
    Without a scope staged folders stay (their DataFrames may be read later).
    A scope holds what its own thread stages: a stream's batch or a second plan
    in another thread keeps its folders."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        _SCOPES.open.append([])
        return self

    def __exit__(self, *exc):
        paths = _SCOPES.open.pop()
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            try:
                hp.getFileSystem(conf).delete(hp, True)
            except Exception:  # noqa: BLE001 - cleanup is best effort
                pass
        return False


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read
    it back: cuts the lineage and decouples reading from overwriting."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", journal.COMPRESSION).parquet(path)
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


# --- dedupe policies -----------------------------------------------------------
def latest_per_job(df: DataFrame, *first: Column, within: Sequence[str] = ()) -> DataFrame:
    """Per ``job_id`` the row with the latest ``processed_date`` (null first,
    as in a descending sort); ties by ``first``, by newer ``job_date``, then by
    state. The window is keyed by job (even spread), and by ``within`` (columns that
    ``df`` is dealt by already); the plan limits each group to its top row before the
    shuffle."""
    w = Window.partitionBy(*within, "job_id").orderBy(
        F.col("processed_date").desc_nulls_first(), *first, F.col(DATE_COLUMN).desc_nulls_last(), F.col("state").asc_nulls_last()
    )
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_raw(df: DataFrame) -> DataFrame:
    """Per ``JobIDRaw`` the row of the OLDEST date; within a date the
    later line (by stored line sequence) wins."""
    w = Window.partitionBy("JobIDRaw").orderBy(F.col(DATE_COLUMN).asc_nulls_last(), F.col("seq").desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_newest_date(df: DataFrame) -> DataFrame:
    """Per ``job_id`` the row of the NEWEST date (ties: latest processing)."""
    w = Window.partitionBy("job_id").orderBy(F.col(DATE_COLUMN).desc_nulls_last(), F.col("processed_date").desc_nulls_first())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# --- loads -----------------------------------------------------------------------
def load_recent(spark: SparkSession, root: str, as_of: str | dt.date, days: int, kind: str = PROCESSED) -> DataFrame:
    """Dates ``as_of - days`` .. ``as_of`` (days + 1 dates), deduped: W1
    for processed, W2 for raw. Nothing stored -> empty DataFrame."""
    df = read_table(spark, root, kind, date_window(as_of, days), ignore_corrupt=True)
    return latest_per_job(df) if kind == PROCESSED else dedupe_raw(df)


def load_days(spark: SparkSession, root: str, as_of: str | dt.date, n: int = 7) -> DataFrame:
    """The last ``n`` dates (``as_of`` and n - 1 before), no dedupe."""
    return read_table(spark, root, PROCESSED, date_window(as_of, n - 1), ignore_corrupt=True)


# --- sinks -------------------------------------------------------------------------
def write_silver(df: DataFrame, root: str) -> None:
    """Replace the written dates of the processed table. The job index and the
    sums by day do not follow a plain write; they go. The next collection builds the
    index anew, ``build_daily`` the sums."""
    files = journal.Files(df.sparkSession, root)
    for table in (job_index.JOBS, daily.USAGE, daily.EFFICIENCY):
        files.delete(f"{root.rstrip('/')}/{table}")
    write_table(df, root, PROCESSED)
    files.delete(f"{root.rstrip('/')}/{job_index.JOBS}")


def write_bronze(df: DataFrame, root: str) -> None:
    """Archive raw rows (61 + 4 columns, line sequence) per date."""
    write_table(df, root, RAW)


def upsert_silver(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing union new, latest version of each job (W1); of two versions
    processed at one time the new one."""
    cols = [*SILVER_COLUMNS, DATE_COLUMN]
    both = existing.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    return latest_per_job(both, F.col("_new").desc()).drop("_new")


def merge_by_date(run: journal.Run, existing: DataFrame, new: DataFrame) -> None:
    """``upsert_silver`` written into ``run`` with one shuffle of the rows: a job that stands on
    one date alone is decided where its date is written. Jobs that stand on several (found by
    a pass over ids and dates) are merged apart."""
    spark, cols = run.spark, [*SILVER_COLUMNS, DATE_COLUMN]
    both = existing.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    dates = both.groupBy("job_id").agg(F.min(DATE_COLUMN).alias("a"), F.max(DATE_COLUMN).alias("b"), F.count_if(F.col(DATE_COLUMN).isNull()).alias("undated"))
    several = stage(spark, dates.where("a < b or undated > 0").select("job_id"), "silver-several")
    one = both
    if not several.isEmpty():
        same = F.col("r.job_id").eqNullSafe(F.col("s.job_id"))
        one = both.alias("r").join(several.alias("s"), same, "left_anti")
        rest = both.alias("r").join(several.alias("s"), same, "left_semi")
        run.write(latest_per_job(rest, F.col("_new").desc()).drop("_new"), PROCESSED, DATE_COLUMN)
    tasks = {r[DATE_COLUMN]: -(-r["count"] // JOBS_PER_TASK) for r in both.groupBy(DATE_COLUMN).count().collect()}
    lean, within = N.without_metrics(one), [DATE_COLUMN]
    part = F.lit(0).cast("bigint")
    for n in sorted({*tasks.values()} - {1}):
        some = [d for d, k in tasks.items() if k == n and d is not None]
        part = F.when(F.col(DATE_COLUMN).isin(some), F.pmod(F.xxhash64("job_id"), F.lit(n))).otherwise(part)
        within = [DATE_COLUMN, "_part"]
    lean = lean.withColumn("_part", part).repartition(*within)
    merged = latest_per_job(lean, F.col("_new").desc(), within=within)
    run.write(N.restored_metrics(merged, one.select(*cols).schema), PROCESSED, DATE_COLUMN, dealt=True)


def merge_silver(run: journal.Run, new: DataFrame, superseded: DataFrame | None = None) -> list[str]:
    """Write the merged dates that ``new`` touches, and the index rows of its
    jobs, into ``run``; gives these dates. Both inputs are read several times:
    staged tables."""
    spark, root = run.spark, run.root
    touched = calendar(new.select(DATE_COLUMN))
    left = calendar(superseded.select(DATE_COLUMN)) if superseded is not None else []
    existing = read_table(spark, root, PROCESSED, sorted({*touched, *left}))
    if left:
        existing = existing.join(superseded.select("job_id", DATE_COLUMN).distinct(), ["job_id", DATE_COLUMN], "left_anti")
    merge_by_date(run, existing, new)
    written = run.partitions(PROCESSED)
    run.drop(PROCESSED, DATE_COLUMN, [d for d in left if d not in written])
    job_index.ensure(spark, root, read_table(spark, root, PROCESSED))
    daily.follow(run, new, superseded, read_written(run, PROCESSED), run.dropped_of(PROCESSED))
    run.write(job_index.merged(spark, root, new), job_index.JOBS, job_index.BLOCK_COLUMN)
    return written


def upsert_store(spark: SparkSession, root: str, new: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """U2 on the store: merge ``new`` silver rows into the dates they touch
    and replace exactly those date partitions. Returns the rows of these dates.

    ``superseded``: (job_id, job_date) of stored rows whose job moved to another
    date (a pending job is dated by its submission, a started one by its
    start). They leave their dates, which count as touched; a date that loses
    its last row is removed."""
    journal.recover(spark, root)
    with staging_scope(spark):
        new = stage(spark, new.select(*SILVER_COLUMNS, DATE_COLUMN), "silver-new")
        superseded = superseded and stage(spark, superseded.select("job_id", DATE_COLUMN).distinct(), "silver-superseded")
        run = journal.Run(spark, root)
        written = merge_silver(run, new, superseded)
        run.publish()
    return read_table(spark, root, PROCESSED, written)


def build_daily(spark: SparkSession, root: str) -> None:
    """From now on the store keeps sums by day (``daily``)."""
    journal.recover(spark, root)
    daily.build(spark, root, read_table(spark, root, PROCESSED))


def dealt_raw(raw: DataFrame) -> DataFrame:
    """Raw rows clustered by date (as by REBALANCE) and sorted by it. A row of 66 columns
    is shuffled as the text it was read from, a quarter of its size, and taken apart again;
    one that is no such text (a null field, a '|' in a field) is shuffled as it is."""
    flat = {f.name: (F.col(f.name), f.dataType) for f in RAW_STORED.fields if f.name not in (SEQ, DATE_COLUMN)}
    flat |= {f"_{f.name}": (F.col(SEQ)[f.name], f.dataType) for f in RAW_STORED[SEQ].dataType.fields}
    flat = {n: flat[n] for n in ("_pos", *PACKED_ORDER, *(n for n in flat if n != "_pos" and n not in PACKED_ORDER))}
    line = X.packed(*[c.cast("string") for c, _ in flat.values()])
    df = raw.select(line.alias("_line"), *RAW_STORED.names)
    df = df.select("_line", F.when(F.col("_line").isNull(), F.struct(*[n for n in RAW_STORED.names if n != DATE_COLUMN])).alias("_odd"), DATE_COLUMN)
    df = df.hint("rebalance", DATE_COLUMN).sortWithinPartitions(DATE_COLUMN)
    df = df.select(X.unpacked(F.col("_line")).alias("_f"), "_odd", DATE_COLUMN)
    at = {n: F.col("_f")[i].cast(t) for i, (n, (_, t)) in enumerate(flat.items())}
    seq = F.struct(*[at[f"_{n}"].alias(n) for n in RAW_STORED[SEQ].dataType.names])
    at[SEQ] = F.when(F.col("_f").isNotNull(), seq)
    return df.select(*[F.coalesce(at[n], F.col("_odd")[n]).alias(n) for n in RAW_STORED.names if n != DATE_COLUMN], DATE_COLUMN)


def merge_raw(run: journal.Run, new_raw: DataFrame) -> DataFrame:
    """Raw archive: per date, archived lines whose ``JobIDRaw`` was fetched again
    are replaced by the new fetch (kept as fetched, duplicates included: the
    load-time rule W2 resolves them); other archived lines stay. Writes ``new_raw``,
    which is read once, into ``run`` and gives what was written (``merged_raw`` gives
    all rows of the touched dates).

    Only (date, JobIDRaw) of the dates that both hold are shuffled to tell which
    archived lines go. A date that loses none keeps its files, the new ones come
    beside them; of the others the lines that stay are written again."""
    spark, root = run.spark, run.root
    # its files are listed here: lines written to these dates below are not among them
    new = run.write(dealt_raw(new_raw), RAW, DATE_COLUMN, dealt=True)
    both = sorted({*run.partitions(RAW)}.intersection(stored_dates(spark, root, RAW)))
    if not both:
        return new
    key = [DATE_COLUMN, "JobIDRaw"]
    archived = read_table(spark, root, RAW, both)
    of = lambda df, fetched: df.select(*key, F.lit(fetched).alias("fetched"))
    keys = of(archived, False).unionByName(of(new.where(F.col(DATE_COLUMN).isin(both)), True)).groupBy(*key)
    keys = keys.agg(F.bool_and("fetched").alias("only_new"), (F.bool_or("fetched") & F.col("JobIDRaw").isNotNull()).alias("replaced"))
    keys = stage(spark, keys.where(~F.col("only_new")).drop("only_new"), "raw-keys")
    per_date = keys.groupBy(DATE_COLUMN).agg(F.bool_or("replaced").alias("loses"), F.bool_and("replaced").alias("loses_all")).collect()
    loses = sorted(r[DATE_COLUMN] for r in per_date if r["loses"])
    run.add(RAW, DATE_COLUMN, [d for d in both if d not in loses])
    mixed = sorted(r[DATE_COLUMN] for r in per_date if r["loses"] and not r["loses_all"])
    if mixed:
        a, k = archived.where(F.col(DATE_COLUMN).isin(mixed)).alias("a"), keys.where(~F.col("replaced")).alias("k")
        stays = a.join(k, (F.col(f"a.{DATE_COLUMN}") == F.col(f"k.{DATE_COLUMN}")) & F.col("a.JobIDRaw").eqNullSafe(F.col("k.JobIDRaw")), "left_semi")
        run.write(dealt_raw(stays), RAW, DATE_COLUMN, dealt=True)
    return new


def merged_raw(run: journal.Run) -> DataFrame:
    """All rows of the dates whose lines ``run`` has written, as they will be."""
    written = read_written(run, RAW)
    beside = [n.partition("=")[2] for n in run.added if n.startswith(f"{RAW}/")]
    return written.unionByName(read_table(run.spark, run.root, RAW, beside)) if beside else written


def read_written(run: journal.Run, kind: str) -> DataFrame:
    """What ``run`` has written of a table."""
    path = f"{run.path}/{kind}"
    return run.spark.read.schema(SCHEMAS[kind]).option("basePath", path).parquet(path)


def upsert_raw(spark: SparkSession, root: str, new_raw: DataFrame) -> None:
    """``merge_raw`` as a run of its own."""
    journal.recover(spark, root)
    with staging_scope(spark):
        run = journal.Run(spark, root)
        merge_raw(run, new_raw.select(*RAW_STORED.names))
        run.publish()


# --- completion state ---------------------------------------------------------------
def read_completed(spark: SparkSession, root: str) -> DataFrame:
    """Completed dates (empty when nothing was stored yet)."""
    return read_table(spark, root, COMPLETED)


def new_marks(spark: SparkSession, root: str, dates: DataFrame, marked_at: Column | None = None) -> DataFrame:
    """Rows that mark those of ``dates`` (one column of 'yyyy-MM-dd') that are not marked yet."""
    new = dates.select(F.col(dates.columns[0]).alias(DATE_COLUMN)).distinct()
    new = new.join(read_completed(spark, root).select(DATE_COLUMN), DATE_COLUMN, "left_anti")
    return new.select((marked_at if marked_at is not None else F.current_timestamp()).alias("marked_at"), DATE_COLUMN)


def mark_complete(spark: SparkSession, root: str, dates: DataFrame, marked_at: Column | None = None) -> DataFrame:
    """Add ``dates`` to the completed set. Only dates not yet stored are
    added, so re-running is a no-op. Gives the added rows."""
    journal.recover(spark, root)
    run = journal.Run(spark, root)
    run.write(new_marks(spark, root, dates, marked_at), COMPLETED, DATE_COLUMN)
    added = run.partitions(COMPLETED)
    run.publish()
    return read_table(spark, root, COMPLETED, added)


# --- statistics ------------------------------------------------------------------------
def store_stats(spark: SparkSession, root: str, last: int = 5) -> DataFrame:
    """Number of data files of raw and processed rows, the latest of them
    (path order), rows of the last ``last`` files and total MB (``files``)."""
    from jobacct.sources import files

    return files.file_summary(files.file_stats(spark, root), last)
