"""C5 from sums by day: reports over jobs already added up.

``usage_partials`` has one row for each (job_date, day, user, state) with sums in
base units; the reports below add these up and scale once, so they equal those of
``reports`` over the jobs themselves. Users are in the key, so distinct users
of any window are exact. A job must stand on one date only (see ``sources.daily``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobacct.operators import reports as R
from jobacct.schemas import DATE_COLUMN

KEYS = (DATE_COLUMN, "day", "user", "state")
_SUMS = {"cpu": R.cpu_s, "mem": R.mem_mb_s, "gpu": R.gpu_s, "cpu_w": R.cpu_waste_s, "mem_w": R.mem_waste_mb_s, "ram": lambda: F.col("req_mem_mb")}
#: Means: a sum and the number of values in it.
_MEANS = {"wait": "wait_seconds", "cpu_eff": "cpu_efficiency", "mem_eff": "memory_efficiency"}
_HOURS = {
    "total_cpu_hours": ("cpu", R.HOUR), "total_memory_gb_hours": ("mem", R.GB_HOUR), "total_gpu_hours": ("gpu", R.HOUR),
    "cpu_hours_wasted": ("cpu_w", R.HOUR), "memory_gb_hours_wasted": ("mem_w", R.GB_HOUR),
}


def usage_partials(prepared: DataFrame) -> DataFrame:
    """One row for each KEYS of the jobs; ``day`` is P22 (null for a job with neither time)."""
    day = F.date_format(F.coalesce("start_time", "submit_time"), "yyyy-MM-dd")
    sums = [F.coalesce(F.sum(c()), F.lit(0.0)).alias(k) for k, c in _SUMS.items()]
    means = [x for k, c in _MEANS.items() for x in (F.sum(F.col(c).cast("double")).alias(k), F.count(c).alias(f"{k}_n"))]
    return prepared.withColumn("day", day).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *sums, *means)


def _scaled(c: str, scale: float) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0)) / scale


def _mean(c: str, where: Column | None = None) -> Column:
    of = (lambda x: F.col(x)) if where is None else (lambda x: F.when(where, F.col(x)))
    return F.try_divide(F.sum(of(c)), F.sum(of(f"{c}_n")))


def _jobs() -> Column:
    return F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")


def user_stats(partials: DataFrame) -> DataFrame:
    """A1."""
    done = F.col("state") == "COMPLETED"
    return partials.groupBy("user").agg(
        _jobs().alias("job_count"),
        *(_scaled(*of).alias(name) for name, of in _HOURS.items()),
        _scaled("ram", 1024.0).alias("total_ram_gb"),
        (_mean("wait") / R.HOUR).alias("avg_wait_hours"),
        _mean("cpu_eff", done).alias("avg_cpu_efficiency"),
        _mean("mem_eff", done).alias("avg_mem_efficiency"),
    )


def group_stats(partials: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """A2: per-user sums, then the mapping, as over jobs."""
    per_user = partials.groupBy("user").agg(*(F.sum(c).alias(c) for c in ("n", "cpu", "mem", "gpu", "cpu_w", "mem_w")))
    return R.group_stats_of_users(per_user, groups)


def daily_usage(partials: DataFrame) -> DataFrame:
    """A5."""
    return partials.where(F.col("day").isNotNull()).groupBy(F.col("day").alias("job_date")).agg(
        _jobs().alias("job_count"),
        _scaled("cpu", R.HOUR).alias("cpu_hours"),
        _scaled("gpu", R.HOUR).alias("gpu_hours"),
        _scaled("mem", R.GB_HOUR).alias("memory_gb_hours"),
        R.n_unique("user").alias("unique_users"),
    )


def top_wasters(partials: DataFrame, k: int = 10) -> DataFrame:
    """A7 + T4."""
    waste = R.completed(partials).groupBy("user").agg(_scaled("cpu_w", R.HOUR).alias("cpu_wasted"), _scaled("mem_w", R.GB_HOUR).alias("mem_wasted"))
    return waste.orderBy(F.col("cpu_wasted").desc(), F.col("user")).limit(k)


def state_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy("state").agg(_jobs().alias("count"))


def cluster_summary(partials: DataFrame) -> DataFrame:
    """A8."""
    tot = partials.agg(
        _jobs().alias("total_jobs"),
        R.n_unique("user").alias("unique_users"),
        _scaled("cpu", R.HOUR).alias("total_cpu_hours"),
        _scaled("gpu", R.HOUR).alias("total_gpu_hours"),
        _scaled("ram", 1024.0).alias("total_ram_gb"),
        (_mean("wait") / R.HOUR).alias("avg_wait_hours"),
    )
    return tot.withColumn("top_states", R.scalar(R.states_text(state_counts(partials))))


def state_distribution(partials: DataFrame) -> DataFrame:
    """A9."""
    return R.state_shares(state_counts(partials))
