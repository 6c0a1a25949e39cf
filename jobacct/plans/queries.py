"""Registry of query keys: each is ``(spark, sf_dir) -> DataFrame``.

Every query reads the shared test tables (through ``checks.fixtures``, which
renders accounting text from ``events``) and runs the real pipeline over
ALL of it: text scan -> bronze -> silver -> report. Doubles are rounded to
6 places so results compare across engines (the sums behind them are exact).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.checks import fixtures as FX
from jobacct.operators import normalize as N
from jobacct.operators import reports as R
from jobacct.schemas import ACCOUNTING_FIELDS
from jobacct.session import use_utc
from jobacct.sources import accounting as S
from jobacct.sources.groups import groups_from_pairs

# fixed processing time of the registered queries (reproducible output)
PROCESSED_AT = "2024-02-01 06:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str, digits: int = 6):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return rounded(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return deco


def rounded(df: DataFrame, digits: int) -> DataFrame:
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


# --- shared pipeline pieces --------------------------------------------------
# Built logical plans (not results) are reused by the queries of one session:
# DataFrames are immutable, and building the wide parser projections costs
# about a second of driver time each. Every query still runs its whole plan.
_PLANS: dict[tuple, DataFrame] = {}


def _plan(spark: SparkSession, name: str, sf_dir: str, build, *args) -> DataFrame:
    key = (spark.sparkContext.applicationId, name, sf_dir.rstrip("/"), args)
    df = _PLANS.get(key)
    if df is None:
        df = _PLANS[key] = build(spark, sf_dir, *args)
    return df


def bronze(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """S1 over the dump rendered from ``events`` (materialised once as text)."""
    return _plan(spark, "bronze", sf_dir, lambda sp, d, r: S.read_accounting_text(sp, FX.dump_path(sp, d, r)), run)


def silver(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    return _plan(spark, "silver", sf_dir, lambda sp, d, r: N.normalize_jobs(bronze(sp, d, r), processed_at=PROCESSED_AT), run)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, "groups", sf_dir, lambda sp, d: groups_from_pairs(FX.group_pairs(sp, d)))


def prepared(spark: SparkSession, sf_dir: str, with_groups: bool = False) -> DataFrame:
    """Prepared jobs; the group mapping is joined only where a report uses it."""
    return R.prepare(silver(spark, sf_dir), groups(spark, sf_dir) if with_groups else None)


# --- reports -----------------------------------------------------------------
@register("user_stats")
def user_stats(spark, sf_dir):
    """A1 flagship: per-user usage over every job of the dump."""
    return R.user_stats(prepared(spark, sf_dir))


def _ts_txt(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


@register("group_stats")
def group_stats(spark, sf_dir):
    """A2: per research group; mapping derived from the users of ``events``."""
    return R.group_stats(R.prepare(silver(spark, sf_dir)), groups(spark, sf_dir))


@register("daily_usage")
def daily_usage(spark, sf_dir):
    """A5 + P22: per day of start (else submit)."""
    return R.daily_usage(prepared(spark, sf_dir))


@register("daily_usage_recent")
def daily_usage_recent(spark, sf_dir):
    """The last 14 days of the daily table."""
    return R.daily_usage_recent(R.daily_usage(prepared(spark, sf_dir)), 14)


@register("efficiency_summary")
def efficiency_summary(spark, sf_dir):
    """A6 + F2: efficiency statistics over COMPLETED jobs."""
    return R.efficiency_summary(prepared(spark, sf_dir))


@register("top_wasters")
def top_wasters(spark, sf_dir):
    """A7 + T4: top 10 users by wasted CPU hours (COMPLETED jobs)."""
    return R.top_wasters(prepared(spark, sf_dir), 10)


@register("cluster_summary")
def cluster_summary(spark, sf_dir):
    """A8 + T5: cluster totals and top-3 states."""
    return R.cluster_summary(prepared(spark, sf_dir))


@register("state_distribution")
def state_distribution(spark, sf_dir):
    """Jobs per state and share."""
    return R.state_distribution(silver(spark, sf_dir))


@register("worst_users")
def worst_users(spark, sf_dir):
    """A10: 5 users with the lowest mean CPU efficiency."""
    return R.worst_users(silver(spark, sf_dir), 5)


@register("waste_by_partition")
def waste_by_partition(spark, sf_dir):
    """Wasted CPU hours per partition."""
    return R.waste_by_partition(silver(spark, sf_dir))


@register("analysis_period")
def analysis_period(spark, sf_dir):
    """Analysis period in days."""
    return R.analysis_period(silver(spark, sf_dir))


@register("top_users")
def top_users(spark, sf_dir):
    """Top 15 users by CPU hours."""
    return R.top_users(R.user_stats(prepared(spark, sf_dir)), 15)


@register("top_share")
def top_share(spark, sf_dir):
    """T6 + F6 + W6: CPU-hours bar chart of users (top 20, share of all)."""
    return R.top_share(R.user_stats(prepared(spark, sf_dir)), "user", "total_cpu_hours", 20, 50)


@register("incomplete_jobs")
def incomplete_jobs(spark, sf_dir):
    """jobs in a state that can still change."""
    return R.incomplete_jobs(silver(spark, sf_dir)).select("job_id", "state", "job_date")


@register("prepare")
def prepare(spark, sf_dir):
    """Group, back-filled reserved hours and wait per job."""
    return prepared(spark, sf_dir, with_groups=True).select("job_id", "user", "group", "wait_seconds", "cpu_hours_reserved")


@register("with_group")
def with_group(spark, sf_dir):
    """User -> group (last configured group wins; unknown -> ungrouped)."""
    return R.with_group(silver(spark, sf_dir), groups(spark, sf_dir)).select("job_id", "user", "group")


@register("groups_table")
def groups_table(spark, sf_dir):
    """The (user, group) dimension."""
    return groups(spark, sf_dir)


@register("wait_time")
def wait_time(spark, sf_dir):
    """Whole seconds from submit to start."""
    return R.with_wait(silver(spark, sf_dir)).select("job_id", "wait_seconds")


@register("backfill_reserved")
def backfill_reserved(spark, sf_dir):
    """P20: silver written before the reserved columns existed."""
    old = silver(spark, sf_dir).drop(*R.RESERVED_COLUMNS)
    return R.backfill_reserved(old).select("job_id", *R.RESERVED_COLUMNS)


@register("job_metrics")
def job_metrics(spark, sf_dir):
    """Efficiency, waste and reserved hours per job."""
    return silver(spark, sf_dir).select(
        "job_id", "cpu_efficiency", "memory_efficiency", "cpu_hours_wasted", "memory_gb_hours_wasted",
        *R.RESERVED_COLUMNS,
    )


@register("normalize_jobs")
def normalize_jobs(spark, sf_dir):
    """C1 + P23: the whole silver table (times as text)."""
    s = silver(spark, sf_dir)
    cols = [_ts_txt(c) if c in ("submit_time", "start_time", "end_time", "processed_date") else F.col(c) for c in s.columns]
    return s.select(*cols)


@register("main_batch_join")
def main_batch_join(spark, sf_dir):
    """J1 + W5: usage from the batch step, else the main row; last line wins."""
    return silver(spark, sf_dir).select("job_id", "state", "alloc_cpus", "total_cpu_seconds", "max_rss_mb")


# --- per-line parsers over the whole dump ------------------------------------
@register("scan_accounting")
def scan_accounting(spark, sf_dir):
    """Every 61-field line of the dump (malformed lines dropped)."""
    return bronze(spark, sf_dir).select("JobID", "JobIDRaw", "User", "State", "Partition", "NodeList", "ElapsedRaw")


@register("scan_day")
def scan_day(spark, sf_dir):
    """Lines per own job date, over the calendar of all dump dates."""
    b = bronze(spark, sf_dir)
    dated = S.with_job_date(b).where(F.col("job_date").isNotNull())
    span = dated.agg(F.min("job_date").alias("lo"), F.max("job_date").alias("hi"))
    cal = span.select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("d"))
    cal = cal.select(F.date_format("d", "yyyy-MM-dd").alias("job_date"))
    day = S.read_accounting_day(b, cal)
    return day.groupBy("job_date").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("is_main_job")).alias("main_lines"),
        F.count_if(F.col("is_batch_step")).alias("batch_lines"),
    )


@register("classify_steps")
def classify_steps(spark, sf_dir):
    """Base id and step kind of every line."""
    return bronze(spark, sf_dir).select("JobID", "job_id_base", "is_batch_step", "is_main_job", "is_finished")


@register("job_date")
def job_date_q(spark, sf_dir):
    """Each line's own job date."""
    from jobacct.functions.text import job_date

    return bronze(spark, sf_dir).select("JobID", job_date("Start", "Submit").alias("job_date"))


@register("normalize_state")
def normalize_state_q(spark, sf_dir):
    """P5: CANCELLED variants folded."""
    from jobacct.functions.text import normalize_state

    b = bronze(spark, sf_dir).where("is_main_job")
    return b.select("JobID", F.col("State").alias("raw_state"), normalize_state("State").alias("state"))


@register("user_fallback")
def user_fallback(spark, sf_dir):
    """Blank user -> uid_<UID> / MISSING_USER, on main lines."""
    from jobacct.functions.text import user_or_uid

    return bronze(spark, sf_dir).where("is_main_job").select("JobID", user_or_uid("User", "UID").alias("user"))


@register("parse_memory")
def parse_memory(spark, sf_dir):
    """ReqMem and MaxRSS of every line in MB."""
    from jobacct.functions.text import memory_mb

    b = bronze(spark, sf_dir)
    return b.select("JobID", memory_mb("ReqMem").alias("req_mem_mb"), memory_mb("MaxRSS").alias("max_rss_mb"))


@register("parse_cpu_time")
def parse_cpu_time(spark, sf_dir):
    """TotalCPU of every line in seconds."""
    from jobacct.functions.text import cpu_seconds

    return bronze(spark, sf_dir).select("JobID", cpu_seconds("TotalCPU").alias("total_cpu_seconds"))


@register("parse_int")
def parse_int(spark, sf_dir):
    """ElapsedRaw and AllocCPUS of every line."""
    from jobacct.functions.text import safe_int

    b = bronze(spark, sf_dir)
    return b.select("JobID", safe_int("ElapsedRaw").alias("elapsed_seconds"), safe_int("AllocCPUS").alias("alloc_cpus"))


@register("parse_timestamp")
def parse_timestamp(spark, sf_dir):
    """P10: Submit / Start / End of main lines (as UTC text)."""
    from jobacct.functions.text import safe_timestamp

    b = bronze(spark, sf_dir).where("is_main_job")
    t = b.select(
        "JobID",
        safe_timestamp("Submit").alias("submit_time"),
        safe_timestamp("Start").alias("start_time"),
        safe_timestamp("End").alias("end_time"),
    )
    return t.select("JobID", _ts_txt("submit_time"), _ts_txt("start_time"), _ts_txt("end_time"))


@register("parse_gpu")
def parse_gpu(spark, sf_dir):
    """GPUs from AllocTRES of every line."""
    from jobacct.functions.text import gpu_count

    return bronze(spark, sf_dir).select("JobID", gpu_count("AllocTRES").alias("alloc_gpus"))


@register("partition_cores")
def partition_cores_q(spark, sf_dir):
    """Cores from the partition name (first digit run, else 0)."""
    from jobacct.functions.text import partition_cores

    b = bronze(spark, sf_dir).where("is_main_job")
    p = F.concat(F.col("Partition"), F.lit("-"), F.col("AllocCPUS"), F.lit("c"))
    return b.select("JobID", p.alias("partition"), partition_cores(p).alias("cores"))


# --- nodes -------------------------------------------------------------------
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobacct.operators.nodes import node_inventory
    from jobacct.sources.inventory import parse_node_cpus, parse_node_gpus

    def build(sp, d):
        return node_inventory(parse_node_cpus(FX.node_cpu_lines(sp, d)), parse_node_gpus(FX.node_gpu_lines(sp, d)))

    return _plan(spark, "inventory", sf_dir, build)


def node_section(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from jobacct.operators.nodes import node_report

    return node_report(prepared(spark, sf_dir), inventory(spark, sf_dir))


@register("node_usage")
def node_usage(spark, sf_dir):
    """C3 + G1 + P12 + P25 + F3: (job, node) rows with evenly split hours."""
    return node_section(spark, sf_dir)["node_usage"]


@register("expand_nodes")
def expand_nodes_q(spark, sf_dir):
    """Node list of every main job expanded to an array."""
    from jobacct.functions.nodes import expand_nodes

    b = bronze(spark, sf_dir).where("is_main_job")
    return b.select("JobID", "NodeList", F.array_join(expand_nodes("NodeList"), ",").alias("nodes"))


@register("node_stats", digits=6)
def node_stats(spark, sf_dir):
    """A3 + J4 + A12: per-node totals, CPU count and utilisation."""
    return node_section(spark, sf_dir)["node_stats"]


@register("top_nodes", digits=6)
def top_nodes(spark, sf_dir):
    """Top 20 nodes by CPU hours."""
    return node_section(spark, sf_dir)["top_nodes"]


@register("nodes_missing_cpu", digits=6)
def nodes_missing_cpu(spark, sf_dir):
    """nodes with jobs but no CPU count in the inventory."""
    return node_section(spark, sf_dir)["nodes_missing_cpu"]


@register("gpu_utilization", digits=6)
def gpu_utilization(spark, sf_dir):
    """A4 + F5 + J5: GPU nodes and their utilisation."""
    return node_section(spark, sf_dir)["gpu_utilization"]


@register("node_inventory")
def node_inventory_q(spark, sf_dir):
    """C7 + J6: merged CPU / GPU inventory."""
    return inventory(spark, sf_dir)


@register("inventory_summary")
def inventory_summary(spark, sf_dir):
    """Inventory totals."""
    from jobacct.operators.nodes import inventory_summary as summary

    return summary(inventory(spark, sf_dir))


@register("scan_node_cpus")
def scan_node_cpus(spark, sf_dir):
    """CPU inventory lines, last valid line per node wins."""
    from jobacct.sources.inventory import parse_node_cpus

    return parse_node_cpus(FX.node_cpu_lines(spark, sf_dir))


@register("scan_node_gpus")
def scan_node_gpus(spark, sf_dir):
    """GPU inventory lines with a GPU count, last per node wins."""
    from jobacct.sources.inventory import parse_node_gpus

    return parse_node_gpus(FX.node_gpu_lines(spark, sf_dir))


@register("parse_gres")
def parse_gres(spark, sf_dir):
    """GPU count of every 2-part GRES line (null: no count)."""
    from jobacct.sources.inventory import gres_lines

    return gres_lines(FX.node_gpu_lines(spark, sf_dir)).select("node", "gres", "gpus")


@register("node_total_cores")
def node_total_cores(spark, sf_dir):
    """Total CPUs of each node from its description text."""
    from jobacct.sources.inventory import node_total_cores as cores

    return cores(FX.node_description_lines(spark, sf_dir))


# --- live queue ----------------------------------------------------------------
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobacct.sources.queue import parse_queue_lines

    return _plan(spark, "queue", sf_dir, lambda sp, d: parse_queue_lines(FX.queue_lines(sp, d)))


def node_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobacct.sources.inventory import node_total_cores as cores

    return cores(FX.node_description_lines(spark, sf_dir))


def usage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobacct.operators.queue import queue_usage

    return queue_usage(queue(spark, sf_dir), node_cores(spark, sf_dir))


@register("scan_queue")
def scan_queue(spark, sf_dir):
    """S3: parsed queue snapshot (header and malformed lines dropped)."""
    return queue(spark, sf_dir)


@register("queue_usage_cores")
def queue_usage_cores(spark, sf_dir):
    """A14 + W4 + J8 (cores mode): cores per user, partition and status."""
    return usage_q(spark, sf_dir).select("user", "partition", "status", "cores")


@register("queue_usage_nodes")
def queue_usage_nodes(spark, sf_dir):
    """A14 (nodes mode): nodes per user, partition and status."""
    return usage_q(spark, sf_dir).select("user", "partition", "status", "nodes")


@register("queue_totals")
def queue_totals(spark, sf_dir):
    """Totals per (partition, status), status and (user, status)."""
    from jobacct.operators.queue import queue_totals as totals

    return totals(usage_q(spark, sf_dir))


@register("status_summary")
def status_summary(spark, sf_dir):
    """P24: 'R=2 / PD=1' per user and partition in first-seen order."""
    from jobacct.operators.queue import status_summary as summary

    return summary(usage_q(spark, sf_dir))


@register("queue_grid")
def queue_grid(spark, sf_dir):
    """C6 + A18: the queue grid (cells, user totals, footer)."""
    from jobacct.operators.queue import queue_grid as grid

    return grid(usage_q(spark, sf_dir))


@register("max_lengths")
def max_lengths(spark, sf_dir):
    """Display width of each grid column."""
    from jobacct.operators.queue import max_lengths as widths
    from jobacct.operators.queue import queue_grid as grid

    return widths(grid(usage_q(spark, sf_dir)))


# --- store, incremental collection ------------------------------------------------
RUN1_AT, RUN2_AT = "2024-02-01 06:00:00", "2024-02-02 06:00:00"
_WINDOWS: dict[tuple, tuple[str, int]] = {}


def window(spark: SparkSession, sf_dir: str, run: int) -> tuple[str, int]:
    """(as_of, days) of a collection run: ``run`` days after the last event, back
    to the day before the first (a job waits two hours at most)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _WINDOWS:
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        r = spark.read.parquet(f"{sf_dir}/events.parquet").agg(day(F.min("ts")), day(F.max("ts"))).first()
        _WINDOWS[key] = tuple(dt.date.fromisoformat(x or PROCESSED_AT[:10]) for x in r)
    first, last = _WINDOWS[key]
    as_of = last + dt.timedelta(days=run)
    return as_of.isoformat(), (as_of - first).days + 1


def _store(spark: SparkSession) -> str:
    from jobacct.session import scratch_path

    return scratch_path(spark, "store")


def _dated_bronze(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    return S.with_job_date(bronze(spark, sf_dir, run)).where(F.col("job_date").isNotNull())


def _silver_run(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    def build(sp, d, r):
        return N.normalize_jobs(bronze(sp, d, r), processed_at=RUN1_AT if r == 1 else RUN2_AT)

    return _plan(spark, "silver_run", sf_dir, build, run)


def _silver_text(df: DataFrame) -> DataFrame:
    cols = [_ts_txt(c) if c in ("submit_time", "start_time", "end_time", "processed_date") else F.col(c) for c in df.columns]
    return df.select(*cols)


def _two_runs_appended(spark: SparkSession, sf_dir: str) -> str:
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_table(_silver_run(spark, sf_dir, 1), root, ST.PROCESSED)
    ST.write_table(_silver_run(spark, sf_dir, 2), root, ST.PROCESSED, mode="append")
    return root


@register("write_silver")
def write_silver(spark, sf_dir):
    """Silver written to the date-partitioned store and read back."""
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_silver(silver(spark, sf_dir), root)
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select(*N.SILVER_COLUMNS, "job_date")


@register("write_bronze")
def write_bronze(spark, sf_dir):
    """Raw rows archived per date and read back."""
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    return ST.read_table(spark, root, ST.RAW).select("JobID", "JobIDRaw", "State", "job_date")


@register("reload_raw")
def reload_raw(spark, sf_dir):
    """Archived raw rows re-read with a corrupt file in the store (skipped)
    and re-filtered by each row's own date."""
    from jobacct.functions.text import job_date
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    for d in ST.stored_dates(spark, root, ST.RAW)[:1]:
        _damage(spark, f"{root}/raw/job_date={d}/corrupt.parquet", "not a parquet file")
    r = ST.read_table(spark, root, ST.RAW, ignore_corrupt=True)
    return r.where(job_date("Start", "Submit") == F.col("job_date")).select("JobID", "job_date")


@register("load_recent_processed")
def load_recent_processed(spark, sf_dir):
    """S7 + W1 + U1: two stored versions of every job; the latest wins."""
    from jobacct.sources import store as ST

    root = _two_runs_appended(spark, sf_dir)
    df = ST.load_recent(spark, root, *window(spark, sf_dir, 2), ST.PROCESSED)
    return _silver_text(df).select("job_id", "state", "processed_date", "job_date")


@register("load_recent_raw")
def load_recent_raw(spark, sf_dir):
    """S7 + W2: archived raw rows, one per JobIDRaw (later line of a date wins)."""
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    df = ST.load_recent(spark, root, *window(spark, sf_dir, 1), ST.RAW)
    return df.select("JobIDRaw", "State", "job_date")


@register("load_days")
def load_days(spark, sf_dir):
    """Last n daily partitions, concatenated without dedupe."""
    from jobacct.sources import store as ST

    root = _two_runs_appended(spark, sf_dir)
    as_of, days = window(spark, sf_dir, 2)
    return ST.load_days(spark, root, as_of, days + 1).select("job_id", "state", "job_date")


@register("latest_per_job")
def latest_per_job(spark, sf_dir):
    """Latest processed version per job over two runs."""
    from jobacct.sources import store as ST

    both = _silver_run(spark, sf_dir, 1).unionByName(_silver_run(spark, sf_dir, 2))
    return _silver_text(ST.latest_per_job(both)).select("job_id", "state", "processed_date", "job_date")


@register("dedupe_newest_date")
def dedupe_newest_date(spark, sf_dir):
    """Newest date per job over two runs (ties: latest processing)."""
    from jobacct.sources import store as ST

    both = _silver_run(spark, sf_dir, 1).unionByName(_silver_run(spark, sf_dir, 2))
    return ST.dedupe_newest_date(both).select("job_id", "state", "job_date")


@register("upsert_silver")
def upsert_silver(spark, sf_dir):
    """Run 1 then run 2 upserted into the store (dynamic partition overwrite)."""
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.upsert_store(spark, root, _silver_run(spark, sf_dir, 1))
    ST.upsert_store(spark, root, _silver_run(spark, sf_dir, 2))
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select("job_id", "state", "processed_date", "job_date")


@register("date_completeness")
def date_completeness(spark, sf_dir):
    """Dates whose jobs all settled (before the as-of date) after run 2."""
    from jobacct.operators.incremental import date_completeness as dc

    return dc(_silver_run(spark, sf_dir, 2), window(spark, sf_dir, 2)[0])


@register("completed_roundtrip")
def completed_roundtrip(spark, sf_dir):
    """S11 + U3: settled dates marked complete (twice: idempotent), read back."""
    from jobacct.operators.incremental import date_completeness as dc
    from jobacct.sources import store as ST

    root = _store(spark)
    done = dc(_silver_run(spark, sf_dir, 2), window(spark, sf_dir, 2)[0]).where("is_complete").select("job_date")
    at = F.to_timestamp(F.lit(RUN2_AT))
    ST.mark_complete(spark, root, done, at)
    ST.mark_complete(spark, root, done, at)
    return ST.read_completed(spark, root).select("job_date", F.date_format("marked_at", "yyyy-MM-dd HH:mm:ss").alias("marked_at"))


@register("dates_to_collect")
def dates_to_collect(spark, sf_dir):
    """F8 + G2 + J9: requested dates minus the dates completed after run 2."""
    from jobacct.operators import incremental as I

    as_of, days = window(spark, sf_dir, 2)
    done = I.date_completeness(_silver_run(spark, sf_dir, 2), as_of).where("is_complete")
    return I.dates_to_collect(I.requested_dates(spark, as_of, days), done)


@register("incremental_filter")
def incremental_filter(spark, sf_dir):
    """F7 + J7: run-2 dump lines kept against the states stored by run 1."""
    from jobacct.operators import incremental as I

    existing = I.existing_states(_silver_run(spark, sf_dir, 1))
    f = I.incremental_filter(_dated_bronze(spark, sf_dir, 2), existing)
    return f.where(~F.col("skipped")).select("JobID", "job_date")


def _collect_two_runs(spark: SparkSession, sf_dir: str):
    from jobacct.plans.collect import collect

    root = _store(spark)
    m1 = collect(spark, bronze(spark, sf_dir, 1), root, *window(spark, sf_dir, 1), RUN1_AT).collect()
    m2 = collect(spark, bronze(spark, sf_dir, 2), root, *window(spark, sf_dir, 2), RUN2_AT)
    return root, m1, m2


@register("collect_incremental")
def collect_incremental(spark, sf_dir):
    """C4: two collection runs into one store; the store afterwards."""
    from jobacct.sources import store as ST

    root, _, m2 = _collect_two_runs(spark, sf_dir)
    m2.collect()
    df = ST.read_table(spark, root, ST.PROCESSED)
    return _silver_text(df).select("job_id", "state", "processed_date", "end_time", "total_cpu_seconds", "job_date")


@register("collect_metrics")
def collect_metrics(spark, sf_dir):
    """Metrics of the second collection run."""
    _, _, m2 = _collect_two_runs(spark, sf_dir)
    return spark.createDataFrame(m2.collect(), m2.schema)


@register("reprocess_missing")
def reprocess_missing(spark, sf_dir):
    """A store with raw rows only; processed rows rebuilt from them."""
    from jobacct.plans.collect import reprocess_missing as rp
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    rp(spark, root, PROCESSED_AT)
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select(*N.SILVER_COLUMNS, "job_date")


@register("store_stats")
def store_stats(spark, sf_dir):
    """Data files, the date folder of the latest, rows of the last 5 (the size depends on the encoder)."""
    from jobacct.sources import store as ST

    r = ST.store_stats(spark, _archived_store(spark, sf_dir)).drop("disk_mb")
    return r.withColumn("latest_file", F.regexp_replace("latest_file", "/[^/]*$", ""))


def _archived_store(spark: SparkSession, sf_dir: str) -> str:
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_silver(silver(spark, sf_dir), root)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    return root


@register("file_stats")
def file_stats(spark, sf_dir):
    """S13 by file: rows of each date's files from their footers, and whether all have a size."""
    from jobacct.sources import files

    r = files.file_stats(spark, _archived_store(spark, sf_dir))
    return r.groupBy("kind", "job_date").agg(F.sum("n_rows").alias("n_rows"), F.every(F.col("mb") > 0).alias("sized"))


@register("unreadable_files")
def unreadable_files(spark, sf_dir):
    """Files that a load reads past. A store's first date gets a file of
    text, its last date one that breaks off; both are reported, the rest is loaded."""
    from jobacct.sources import files
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir), root)
    dates = ST.stored_dates(spark, root, ST.RAW)
    n = ST.read_table(spark, root, ST.RAW, ignore_corrupt=True).count()
    if dates:
        _damage(spark, f"{root}/raw/job_date={dates[0]}/text.parquet", "no Parquet in here")
        _damage(spark, f"{root}/raw/job_date={dates[-1]}/broken.parquet", "PAR1 breaks off")
    left = ST.read_table(spark, root, ST.RAW, ignore_corrupt=True).count()
    r = files.unreadable_files(spark, root, ST.RAW)
    return r.select("job_date", F.substring_index("path", "/", -1).alias("file"), "bytes", "reason", F.lit(left == n).alias("rest_loaded"))


def _damage(spark: SparkSession, path: str, text: str) -> None:
    """Put a file of ``text`` into the store, wherever that is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@register("efficiency_summary_approx")
def efficiency_summary_approx(spark, sf_dir):
    """A6 from mergeable sketches per date: everything exact but the medians,
    whose ranks are within 2 % of the middle."""
    jobs = prepared(spark, sf_dir)
    r = R.efficiency_summary(jobs, approx=True)
    for k, c in R._KINDS.items():
        v, m = F.col("v"), F.col("m")
        of = R.completed(jobs).select(F.col(c).cast("double").alias("v"), r.select(f"{k}_median").scalar().alias("m"))
        ranks = of.agg(F.struct(F.try_divide(F.count_if(v < m), F.count(v)).alias("lo"), F.try_divide(F.count_if(v <= m), F.count(v)).alias("hi"))).scalar()
        r = r.withColumn(f"{k}_median_close", (ranks["lo"] <= 0.52) & (ranks["hi"] >= 0.48))
    exact = [f"{k}_{x}" for k in R._KINDS for x in ("mean", "min", "max")]
    return r.select("completed_jobs", *(F.round(c, 6).alias(c) for c in exact), *(f"{k}_median_close" for k in R._KINDS))


@register("collect_summary")
def collect_summary(spark, sf_dir):
    """C4: after the second collection, usage by day over all requested dates."""
    from jobacct.plans.collect import collection_summary

    root, _, m2 = _collect_two_runs(spark, sf_dir)
    m2.collect()
    return collection_summary(spark, root, *window(spark, sf_dir, 2))["daily_usage"]


@register("analyze_user_stats")
def analyze_user_stats(spark, sf_dir):
    """The per-user section of an analysis over the store after two
    appended runs (load_recent -> prepare -> user_stats)."""
    from jobacct.sources import store as ST

    root = _two_runs_appended(spark, sf_dir)
    df = ST.load_recent(spark, root, *window(spark, sf_dir, 2), ST.PROCESSED)
    return R.user_stats(R.prepare(df))


@register("pseudonymize")
def pseudonymize(spark, sf_dir):
    """Every line of the dump with consistent first-appearance aliases."""
    from jobacct.operators.privacy import pseudonymize as pz

    out, _ = pz(spark, bronze(spark, sf_dir))
    return out.select("JobID", "JobName", "User", "Group", "Account", "Partition", "Cluster", "NodeList", "WorkDir", "SubmitLine")


PSEUDONYMIZED = ("JobID", "JobName", "User", "Group", "Account", "Partition", "Cluster", "NodeList", "WorkDir", "SubmitLine")


@register("pseudonymize_next")
def pseudonymize_next(spark, sf_dir):
    """The run-2 dump with the alias map kept from run 1: known values keep
    their alias, new ones are numbered after it."""
    from jobacct.operators import privacy as P
    from jobacct.session import scratch_path

    kept = scratch_path(spark, "alias-kept")
    _, amap = P.pseudonymize(spark, bronze(spark, sf_dir, 1))
    P.save_map(amap, kept)
    out, amap = P.pseudonymize(spark, bronze(spark, sf_dir, 2), known=P.load_map(spark, kept))
    P.save_map(amap, kept)
    return out.select(*PSEUDONYMIZED)


@register("pseudonymize_texts")
def pseudonymize_texts(spark, sf_dir):
    """Queue snapshot, CPU and GPU inventories and node descriptions
    rewritten with one alias map."""
    from jobacct.operators import privacy as P

    described = FX.node_description_lines(spark, sf_dir).select("value", (F.substring("node", -3, 3).cast("bigint") * 10 + F.col("line_no")).alias("seq"))
    named = lambda df: df.select("value", F.col("line_no").cast("bigint").alias("seq"))
    texts = [
        (P.QUEUE, named(FX.queue_lines(spark, sf_dir))), (P.INVENTORY, named(FX.node_cpu_lines(spark, sf_dir))),
        (P.INVENTORY, named(FX.node_gpu_lines(spark, sf_dir))), (P.DESCRIPTION, described),
    ]
    done, _ = P.pseudonymize_texts(spark, texts)
    rows = [d.select(F.lit(k).alias("text"), "seq", "value") for k, d in enumerate(done)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@register("stream_collect")
def stream_collect(spark, sf_dir):
    """The run-1 dump streamed (availableNow) into an empty store."""
    from jobacct.session import scratch_path
    from jobacct.sources import store as ST
    from jobacct.streaming.collect_stream import stream_collect as sc

    root = _store(spark)
    q = sc(spark, FX.dump_path(spark, sf_dir, 1), root, scratch_path(spark, "stream-ckpt"), *window(spark, sf_dir, 1), RUN1_AT)
    q.awaitTermination()
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select("job_id", "state", "processed_date", "job_date")


@register("stream_split_files")
def stream_split_files(spark, sf_dir):
    """The run-1 dump dealt over three files, all main lines, all batch
    lines, all other steps, and streamed file by file: every job is split over
    micro-batches and put together from the archive."""
    from jobacct.session import scratch_path
    from jobacct.sources import store as ST
    from jobacct.sources.journal import Files
    from jobacct.streaming.collect_stream import stream_collect as sc

    root, src = _store(spark), scratch_path(spark, "stream-split")
    lines = spark.read.text(FX.dump_path(spark, sf_dir, 1))
    job = F.split("value", r"\|")[ACCOUNTING_FIELDS.index("JobID")]
    for kind in (~job.contains("."), job.endswith(".batch"), job.contains(".") & ~job.endswith(".batch")):
        lines.where(F.coalesce(kind, F.lit(False))).write.mode("append").option("compression", "gzip").text(src)
    files = [n for n in Files(spark, src).names(src) if n.startswith("part-")]
    q = sc(spark, src, root, scratch_path(spark, "stream-ckpt"), processed_at=RUN1_AT, max_files_per_trigger=max(1, len(files) // 3))
    q.awaitTermination()
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select("job_id", "state", "processed_date", "total_cpu_seconds", "max_rss_mb", "job_date")


@register("collect_rebuild")
def collect_rebuild(spark, sf_dir):
    """C4: run 2 collected into a store that has run 1's archived lines of every
    date, but processed rows of even days only: odd days are rebuilt from the
    archive, even ones and new ones are taken from the dump."""
    from jobacct.plans.collect import collect
    from jobacct.sources import store as ST

    root = _store(spark)
    ST.write_bronze(_dated_bronze(spark, sf_dir, 1), root)
    ST.write_silver(_silver_run(spark, sf_dir, 1).where(F.substring("job_date", 9, 2).cast("int") % 2 == 0), root)
    collect(spark, bronze(spark, sf_dir, 2), root, *window(spark, sf_dir, 2), RUN2_AT).collect()
    return _silver_text(ST.read_table(spark, root, ST.PROCESSED)).select("job_id", "state", "processed_date", "total_cpu_seconds", "job_date")


def _analysis(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from jobacct.plans.analyze import analyze

    root = _two_runs_appended(spark, sf_dir)
    return analyze(spark, root, *window(spark, sf_dir, 2), groups(spark, sf_dir), inventory(spark, sf_dir), persist=False)


def _register_analyze(section: str) -> None:
    def fn(spark, sf_dir):
        return _analysis(spark, sf_dir)[section]

    fn.__doc__ = f"C5: the '{section}' section of an analysis over the store (two appended runs)."
    register(f"analyze_{section}")(fn)


for _section in ("group_stats", "daily_usage", "efficiency_summary", "top_wasters", "cluster_summary",
                 "state_distribution", "node_stats", "gpu_utilization"):
    _register_analyze(_section)


def _daily_analysis(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from jobacct.plans.analyze import analyze
    from jobacct.plans.collect import collect
    from jobacct.sources import store as ST

    root = _store(spark)
    collect(spark, bronze(spark, sf_dir, 1), root, *window(spark, sf_dir, 1), RUN1_AT).collect()
    ST.build_daily(spark, root)
    collect(spark, bronze(spark, sf_dir, 2), root, *window(spark, sf_dir, 2), RUN2_AT).collect()
    return analyze(spark, root, *window(spark, sf_dir, 2), groups(spark, sf_dir), persist=False, from_daily=True)


def _register_daily(section: str) -> None:
    def fn(spark, sf_dir):
        return _daily_analysis(spark, sf_dir)[section]

    fn.__doc__ = f"C5: the '{section}' section from the sums by day, built after the first collection and kept by the second."
    register(f"analyze_daily_{section}")(fn)


for _section in ("user_stats", "group_stats", "daily_usage", "top_wasters", "cluster_summary", "state_distribution"):
    _register_daily(_section)


def _chart_section(spark: SparkSession, sf_dir: str, section: str) -> DataFrame:
    if section in ("node_stats", "gpu_utilization"):
        return node_section(spark, sf_dir)[section]
    jobs = prepared(spark, sf_dir)
    if section == "user_stats":
        return R.user_stats(jobs)
    return R.group_stats(jobs, groups(spark, sf_dir)) if section == "group_stats" else R.daily_usage_recent(R.daily_usage(jobs))


def _register_chart(name: str) -> None:
    def fn(spark, sf_dir):
        section = R.CHARTS[name][0]
        return R.chart({section: _chart_section(spark, sf_dir, section)}, name)

    fn.__doc__ = f"T6: the numbers of the '{name}' bar chart."
    register(f"chart_{name}")(fn)


for _chart in R.CHARTS:
    _register_chart(_chart)


@register("show_group_stats")
def show_group_stats(spark, sf_dir):
    """A2: whether the group section is shown."""
    return R.show_group_section(R.group_stats(prepared(spark, sf_dir), groups(spark, sf_dir)))


@register("queue_grid_wide")
def queue_grid_wide(spark, sf_dir):
    """The display grid of cores: a column for each partition, '-' where a user has no cell."""
    from jobacct.operators.queue import grid_wide
    from jobacct.operators.queue import queue_grid as grid

    long = grid(usage_q(spark, sf_dir))
    names = [r[0] for r in long.where(F.col("partition") != "Total").select("partition").distinct().collect()]
    return grid_wide(long, names)
