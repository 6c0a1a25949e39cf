"""Reports over silver job rows (C2 prepare, A1-A2, A5-A12, F1-F2, T1, T3-T7).

Sums of hours are accumulated in base units (CPU-seconds, MB-seconds) from
the job's integer quantities and scaled once at the end. By P19 that is the
same quantity as summing the per-job hour columns, but it is exact and
independent of row order, so a report reads the same on 8 or 8000 tasks.

Every report is a single ``groupBy`` (partial aggregation before the
shuffle, so a user or state holding a third of all rows costs one map-side
combine, not one hot reducer). Where a global total is attached to grouped rows
it is a one-row aggregate used as a scalar subquery (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobacct.functions.metrics import analysis_days, reserved_hours, wait_seconds
from jobacct.schemas import INCOMPLETE_JOB_STATES, RESERVED_COLUMNS, UNGROUPED

HOUR = 3600.0
GB_HOUR = 1024.0 * 3600.0


# --- base-unit measures -------------------------------------------------------
def cpu_s() -> Column:
    return F.col("elapsed_seconds").cast("double") * F.col("alloc_cpus")


def gpu_s() -> Column:
    """GPU-seconds behind ``gpu_hours_reserved``: a back-filled row (P20) has none."""
    none = F.coalesce(F.col("gpu_hours_reserved"), F.lit(0.0)) == 0
    return F.when(none, F.lit(0.0)).otherwise(F.col("elapsed_seconds").cast("double") * F.col("alloc_gpus"))


def mem_mb_s() -> Column:
    return F.col("req_mem_mb") * F.col("elapsed_seconds")


def cpu_waste_s() -> Column:
    return F.greatest(cpu_s() - F.col("total_cpu_seconds"), F.lit(0.0))


def mem_waste_mb_s() -> Column:
    return F.greatest((F.col("req_mem_mb") - F.col("max_rss_mb")) * F.col("elapsed_seconds"), F.lit(0.0))


def total(c: Column, scale: float) -> Column:
    """Sum that is 0 (not null) over no rows, scaled once."""
    return F.coalesce(F.sum(c), F.lit(0.0)) / scale


def n_unique(c: Column | str) -> Column:
    """Distinct count where null counts as one value (count(distinct) skips it)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.countDistinct(c) + F.coalesce(F.max(c.isNull()).cast("bigint"), F.lit(0))).cast("bigint")


def scalar(one_row: DataFrame) -> Column:
    """A one-row, one-column global aggregate as a Column (scalar subquery):
    computed once, plugged into the plan that uses it; no join."""
    return one_row.scalar()


# --- C2 prepare --------------------------------------------------------------
def backfill_reserved(df: DataFrame) -> DataFrame:
    """P20: when any reserved-hours column is missing recompute all three (GPU
    hours then 0.0); a row read with a declared schema from an old file has
    them null, and is back-filled the same way per row."""
    if set(RESERVED_COLUMNS) - set(df.columns):
        r = reserved_hours("alloc_cpus", "req_mem_mb", F.lit(0.0), "elapsed_seconds")
        return df.withColumns(r)
    old = F.col("cpu_hours_reserved").isNull() | F.col("memory_gb_hours_reserved").isNull() | F.col("gpu_hours_reserved").isNull()
    r = reserved_hours("alloc_cpus", "req_mem_mb", F.lit(0.0), "elapsed_seconds")
    return df.withColumns({k: F.when(old, v).otherwise(F.col(k)) for k, v in r.items()})


def with_group(df: DataFrame, groups: DataFrame | None, skew_safe: bool = True) -> DataFrame:
    """User -> group via a left join; users in no group -> 'ungrouped'.

    ``groups`` must hold one row per user (see ``sources.groups``). Users
    holding a large share of the jobs are served from a bounded broadcast,
    the rest by an ordinary join (``joins.lookup_join``); no hint is put on
    the whole mapping, which is as large as the user base. ``skew_safe=False``
    is for inputs with one row per user (nothing to split)."""
    if groups is None:
        return df.withColumn("group", F.lit(UNGROUPED))
    from jobacct.operators.joins import lookup_join

    g = groups.select("user", F.col("group").alias("__group"))
    j = lookup_join(df, g, ["user"]) if skew_safe else df.join(g, "user", "left")
    return j.withColumn("group", F.coalesce("__group", F.lit(UNGROUPED))).drop("__group")


def with_wait(df: DataFrame) -> DataFrame:
    """Whole seconds from submit to start."""
    return df.withColumn("wait_seconds", wait_seconds("submit_time", "start_time"))


def prepare(silver: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Back-filled reserved hours, group and wait time on each job."""
    return with_wait(with_group(backfill_reserved(silver), groups))


# --- filters -----------------------------------------------------------------
def incomplete_jobs(df: DataFrame) -> DataFrame:
    """jobs in one of the 17 states that can still change."""
    return df.where(F.col("state").isin(*INCOMPLETE_JOB_STATES))


def completed(df: DataFrame) -> DataFrame:
    """F2."""
    return df.where(F.col("state") == "COMPLETED")


# --- aggregations ------------------------------------------------------------
def _usage_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("job_count"),
        total(cpu_s(), HOUR).alias("total_cpu_hours"),
        total(mem_mb_s(), GB_HOUR).alias("total_memory_gb_hours"),
        total(gpu_s(), HOUR).alias("total_gpu_hours"),
        total(cpu_waste_s(), HOUR).alias("cpu_hours_wasted"),
        total(mem_waste_mb_s(), GB_HOUR).alias("memory_gb_hours_wasted"),
    ]


def user_stats(prepared: DataFrame) -> DataFrame:
    """A1 (flagship): per-user usage; efficiencies averaged over COMPLETED only."""
    done = F.col("state") == "COMPLETED"
    return prepared.groupBy("user").agg(
        *_usage_aggs(),
        total(F.col("req_mem_mb"), 1024.0).alias("total_ram_gb"),
        (F.avg("wait_seconds") / HOUR).alias("avg_wait_hours"),
        F.avg(F.when(done, F.col("cpu_efficiency"))).alias("avg_cpu_efficiency"),
        F.avg(F.when(done, F.col("memory_efficiency"))).alias("avg_mem_efficiency"),
    )


def group_stats(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """A2: per-group usage and distinct users.

    With ``groups`` (one row per user) the jobs are first aggregated per user
    (map-side combine), and only the per-user rows are joined to the mapping
    and re-aggregated per group: job rows are never joined, so a user holding
    a third of all jobs costs nothing extra. Base-unit sums make the two-step
    sum exact. Without ``groups``, ``df`` must carry a ``group`` column."""
    if groups is None:
        d = df if "group" in df.columns else with_group(df, None)
        return d.groupBy("group").agg(n_unique("user").alias("unique_users"), *_usage_aggs())
    per_user = df.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(cpu_s()), F.lit(0.0)).alias("cpu"),
        F.coalesce(F.sum(mem_mb_s()), F.lit(0.0)).alias("mem"),
        F.coalesce(F.sum(gpu_s()), F.lit(0.0)).alias("gpu"),
        F.coalesce(F.sum(cpu_waste_s()), F.lit(0.0)).alias("cpu_w"),
        F.coalesce(F.sum(mem_waste_mb_s()), F.lit(0.0)).alias("mem_w"),
    )
    return group_stats_of_users(per_user, groups)


def group_stats_of_users(per_user: DataFrame, groups: DataFrame | None) -> DataFrame:
    """A2 from one row per user: n, cpu, mem, gpu, cpu_w, mem_w in base units."""
    g = with_group(per_user, groups, skew_safe=False)  # one row per user: no hot key
    return g.groupBy("group").agg(
        F.count(F.lit(1)).alias("unique_users"),  # one row per user (null user included once)
        F.sum("n").alias("job_count"),
        (F.sum("cpu") / HOUR).alias("total_cpu_hours"),
        (F.sum("mem") / GB_HOUR).alias("total_memory_gb_hours"),
        (F.sum("gpu") / HOUR).alias("total_gpu_hours"),
        (F.sum("cpu_w") / HOUR).alias("cpu_hours_wasted"),
        (F.sum("mem_w") / GB_HOUR).alias("memory_gb_hours_wasted"),
    )


def show_group_section(stats: DataFrame) -> DataFrame:
    """Whether the group report is shown: not when 'ungrouped' is the only group."""
    return stats.agg(
        ((F.count(F.lit(1)) > 1) | (F.max(F.col("group") != UNGROUPED) == F.lit(True))).alias("show")
    )


def with_job_day(df: DataFrame) -> DataFrame:
    """Day of start, else of submit (UTC); rows with neither dropped."""
    d = F.date_format(F.coalesce("start_time", "submit_time"), "yyyy-MM-dd")
    return df.withColumn("job_date", d).where(F.col("job_date").isNotNull())


def daily_usage(df: DataFrame) -> DataFrame:
    """A5: per day jobs, CPU / GPU / memory hours, distinct users."""
    return with_job_day(df).groupBy("job_date").agg(
        F.count(F.lit(1)).alias("job_count"),
        total(cpu_s(), HOUR).alias("cpu_hours"),
        total(gpu_s(), HOUR).alias("gpu_hours"),
        total(mem_mb_s(), GB_HOUR).alias("memory_gb_hours"),
        n_unique("user").alias("unique_users"),
    )


def daily_usage_recent(daily: DataFrame, k: int = 14) -> DataFrame:
    """The last ``k`` days (a top-k on the tiny per-day table)."""
    return daily.orderBy(F.col("job_date").desc()).limit(k).orderBy("job_date")


#: Efficiencies are counted in buckets of 1 / BUCKETS_PER_PERCENT from 0 to 100 per cent.
BUCKETS_PER_PERCENT = 1000


def efficiency_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Mean / median / min / max of CPU and memory efficiency over COMPLETED
    jobs; no row when there is none. ``median`` is exact (middle-pair mean); with
    ``approx`` it is of a mergeable sketch per date (``efficiency_partials``).

    Jobs are counted by value (partial sums, spread by value), the counts by
    bucket: at most 100 001 buckets of each kind, whose running totals tell which
    one or two hold the middle ranks. Only the values of those are ranked."""
    if approx:
        return efficiency_of_partials(efficiency_partials(df))
    kinds = _KINDS
    each = completed(df).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in kinds.items()))).alias("o"))
    counts = each.select("o.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    # values beyond 0 to 100 fall into the end buckets: the order stays
    bucket = F.least(F.greatest(F.floor(F.col("value") * BUCKETS_PER_PERCENT), F.lit(0)), F.lit(100 * BUCKETS_PER_PERCENT))
    counts = counts.withColumn("bucket", F.when(F.col("value").isNotNull(), bucket).cast("bigint"))  # least and greatest skip nulls
    buckets = counts.groupBy("kind", "bucket").agg(
        F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    one = lambda k, f, c: f(F.when(F.col("kind") == k, F.col(c)))
    seen = lambda k: F.sum(F.when((F.col("kind") == k) & F.col("bucket").isNotNull(), F.col("n")))
    out = buckets.agg(
        F.coalesce(one("cpu", F.sum, "n"), F.lit(0)).alias("completed_jobs"),
        *(c for k in kinds for c in (F.try_divide(one(k, F.sum, "s"), seen(k)).alias(f"{k}_mean"),
                                     one(k, F.min, "lo").alias(f"{k}_min"), one(k, F.max, "hi").alias(f"{k}_max"))),
    )
    med = scalar(_middle(counts.where(F.col("bucket").isNotNull()), buckets.where(F.col("bucket").isNotNull())).agg(
        F.struct(*(one(k, F.max, "median").alias(k) for k in kinds)).alias("m")
    ))
    out = out.where(F.col("completed_jobs") > 0).withColumns({f"{k}_median": med[k] for k in kinds})
    return out.select("completed_jobs", *(f"{k}_{x}" for k in kinds for x in ("mean", "median", "min", "max")))


#: Size parameter of the quantile sketches: rank error below 1 % with 99 % confidence, some 10 KB a sketch.
SKETCH_K = 800
_KINDS = {"cpu": "cpu_efficiency", "mem": "memory_efficiency"}


def efficiency_partials(df: DataFrame) -> DataFrame:
    """A6 by date, mergeable: for each ``job_date`` the number of COMPLETED jobs
    and of each efficiency its sum, count, min, max and quantile sketch (of fixed
    size). One shuffle of one partial row per task and date."""
    per = [F.count(F.lit(1)).alias("completed_jobs")]
    for k, c in _KINDS.items():
        v = F.col(c).cast("double")
        per += [F.sum(v).alias(f"{k}_sum"), F.count(v).alias(f"{k}_n"), F.min(v).alias(f"{k}_min"), F.max(v).alias(f"{k}_max"),
                F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"{k}_sketch")]
    return completed(df).groupBy("job_date").agg(*per)


def efficiency_of_partials(partials: DataFrame) -> DataFrame:
    """The columns of ``efficiency_summary`` from ``efficiency_partials`` of any dates:
    all exact but the medians, which are of the merged sketches. Reads a row a date."""
    agg = [F.coalesce(F.sum("completed_jobs"), F.lit(0)).alias("completed_jobs")]
    for k in _KINDS:
        agg += [F.try_divide(F.sum(f"{k}_sum"), F.sum(f"{k}_n")).alias(f"{k}_mean"), F.min(f"{k}_min").alias(f"{k}_min"),
                F.max(f"{k}_max").alias(f"{k}_max"), F.sum(f"{k}_n").alias(f"{k}_n"),
                F.kll_merge_agg_double(F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_sketch"))).alias(f"{k}_sketch")]
    median = lambda k: F.when(F.col(f"{k}_n") > 0, F.kll_sketch_get_quantile_double(f"{k}_sketch", F.lit(0.5)))
    out = partials.agg(*agg).where(F.col("completed_jobs") > 0)
    out = out.withColumns({f"{k}_median": median(k) for k in _KINDS})
    return out.select("completed_jobs", *(f"{k}_{x}" for k in _KINDS for x in ("mean", "median", "min", "max")))


def _middle(counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(kind, median) from (kind, bucket, value, n) and (kind, bucket, n): the
    mean of the values of ranks (total - 1) div 2 and total div 2."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = buckets.select("kind", "bucket", "n", before(Window.partitionBy("kind").orderBy("bucket")).alias("start"),
                            F.sum("n").over(Window.partitionBy("kind")).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda at: (at <= high) & (at + F.col("n") > low)
    held = ranked.where(holds(F.col("start"))).select("kind", "bucket", "start", "total")  # two rows of a kind at most
    inside = counts.join(F.broadcast(held), ["kind", "bucket"])
    inside = inside.withColumn("at", F.col("start") + before(Window.partitionBy("kind", "bucket").orderBy("value")))
    return inside.where(holds(F.col("at"))).groupBy("kind").agg(((F.min("value") + F.max("value")) / 2).alias("median"))


def user_waste(df: DataFrame) -> DataFrame:
    """Wasted CPU hours and memory GB-hours per user over COMPLETED jobs."""
    return completed(df).groupBy("user").agg(
        total(cpu_waste_s(), HOUR).alias("cpu_wasted"),
        total(mem_waste_mb_s(), GB_HOUR).alias("mem_wasted"),
    )


def top_wasters(df: DataFrame, k: int = 10) -> DataFrame:
    """A7 + T4: the ``k`` users wasting most CPU hours (ties by user)."""
    return user_waste(df).orderBy(F.col("cpu_wasted").desc(), F.col("user")).limit(k)


def state_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("count"))


def top_states_text(df: DataFrame, k: int = 3) -> DataFrame:
    """T5: 'STATE: n, STATE: n, STATE: n' of the ``k`` most frequent states (ties by state)."""
    return states_text(state_counts(df), k)


def states_text(counts: DataFrame, k: int = 3) -> DataFrame:
    """T5 from (state, count)."""
    top = counts.orderBy(F.col("count").desc(), F.col("state")).limit(k)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "state", "count")))
    txt = F.array_join(F.transform(ranked, lambda s: F.concat(s["state"], F.lit(": "), F.format_number(s["count"], 0))), ", ")
    return top.agg(txt.alias("top_states"))


def cluster_summary(prepared: DataFrame) -> DataFrame:
    """One row of cluster totals plus the top-3 states."""
    tot = prepared.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        n_unique("user").alias("unique_users"),
        total(cpu_s(), HOUR).alias("total_cpu_hours"),
        total(gpu_s(), HOUR).alias("total_gpu_hours"),
        total(F.col("req_mem_mb"), 1024.0).alias("total_ram_gb"),
        (F.avg("wait_seconds") / HOUR).alias("avg_wait_hours"),
    )
    return tot.withColumn("top_states", scalar(top_states_text(prepared)))


def state_distribution(df: DataFrame) -> DataFrame:
    """Jobs per state and their share of all jobs (in %). The window runs
    over the per-state table only (one row per state)."""
    return state_shares(state_counts(df))


def state_shares(sc: DataFrame) -> DataFrame:
    """A9 from (state, count)."""
    total = scalar(sc.agg(F.sum("count").alias("_total")))
    return sc.select("state", "count", (F.col("count") / total * 100).alias("percentage"))


def worst_users(df: DataFrame, k: int = 5) -> DataFrame:
    """A10: users with the lowest mean CPU efficiency over COMPLETED jobs."""
    return (
        completed(df).groupBy("user").agg(F.avg("cpu_efficiency").alias("cpu_efficiency"))
        .orderBy(F.col("cpu_efficiency").asc_nulls_first(), F.col("user")).limit(k)
    )


def waste_by_partition(df: DataFrame) -> DataFrame:
    """Wasted CPU hours per partition."""
    return df.groupBy("partition").agg(total(cpu_waste_s(), HOUR).alias("cpu_hours_wasted"))


def analysis_period(df: DataFrame) -> DataFrame:
    """One row ``period_days`` = max(days(max end - min submit) + 1, 1), 7
    when either is unknown. Stays a DataFrame: no driver round trip."""
    return df.agg(analysis_days(F.min("submit_time"), F.max("end_time")).alias("period_days"))


def top_users(stats: DataFrame, k: int = 15) -> DataFrame:
    """Top ``k`` users by CPU hours (ties by user)."""
    return stats.orderBy(F.col("total_cpu_hours").desc(), F.col("user")).limit(k)


def top_share(df: DataFrame, label: str, value: str, n: int = 20, width: int = 50) -> DataFrame:
    """Bar-chart numbers: positive values only, top ``n`` by value with the
    share of the total of ALL positive values, the bar length relative to the
    maximum and the colour band (red > 0.66 max, yellow > 0.33 max, else
    green); labels cut to 15 characters. The window runs over ``df``, which
    is an already aggregated report (one row per user / node / day); totals
    come from a one-row aggregate, the top ``n`` from a distributed top-k."""
    pos = df.where(F.col(value) > 0).select(F.col(label).alias("label"), F.col(value).alias("value"))
    tot = scalar(pos.agg(F.struct(F.sum("value").alias("total"), F.max("value").alias("max")).alias("t")))
    # distributed top-k (each task keeps its n best), then the totals
    top = pos.orderBy(F.col("value").desc(), F.col("label")).limit(n).withColumns({"__total": tot["total"], "__max": tot["max"]})
    v, mx = F.col("value"), F.col("__max")
    return top.select(
        F.left(F.col("label"), F.lit(15)).alias("label"),
        "value",
        (v / F.col("__total") * 100).alias("share_pct"),
        F.when(mx > 0, F.floor(v / mx * width)).otherwise(F.lit(0)).cast("bigint").alias("bar_length"),
        F.when(v > mx * 0.66, F.lit("red")).when(v > mx * 0.33, F.lit("yellow")).otherwise(F.lit("green")).alias("band"),
    )


#: Bar charts of an analysis: name -> (section, label, value, bars).
CHARTS = {
    "node_cpu_share": ("node_stats", "node", "cpu_utilization_pct", 20),
    "node_gpu_share": ("gpu_utilization", "node", "gpu_utilization_pct", 10),
    "user_cpu_share": ("user_stats", "user", "total_cpu_hours", 20),
    "user_gpu_share": ("user_stats", "user", "total_gpu_hours", 10),
    "user_cpu_efficiency": ("user_stats", "user", "avg_cpu_efficiency", 20),
    "user_mem_efficiency": ("user_stats", "user", "avg_mem_efficiency", 20),
    "group_cpu_share": ("group_stats", "group", "total_cpu_hours", 15),
    "group_gpu_share": ("group_stats", "group", "total_gpu_hours", 10),
    "daily_cpu_share": ("daily_usage_recent", "job_date", "cpu_hours", 14),
    "daily_gpu_share": ("daily_usage_recent", "job_date", "gpu_hours", 14),
}


def chart(sections: dict[str, DataFrame], name: str) -> DataFrame:
    """The numbers of one bar chart of ``CHARTS``."""
    section, label, value, n = CHARTS[name]
    return top_share(sections[section], label, value, n)
