"""C5 analyze: every report over the recent part of the store.

One pruned scan of the date window, the latest version per job (W1), the
prepared frame (group, back-filled hours, wait) persisted once, then each
section is an independent query on it, as are the numbers of the bar charts
(``reports.CHARTS``) and whether the group section is shown. Empty data gives
empty reports, not an error."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from jobacct.operators import nodes as ND
from jobacct.operators import partials as P
from jobacct.operators import reports as R
from jobacct.session import use_utc
from jobacct.sources import daily, journal
from jobacct.sources.store import PROCESSED, date_window, load_recent


def analyze(spark: SparkSession, root: str, as_of: str | dt.date, days: int = 7, groups: DataFrame | None = None,
            inventory: DataFrame | None = None, persist: bool = True, from_daily: bool = False) -> dict[str, DataFrame]:
    """All sections. ``from_daily``: from the sums by day of a store that keeps
    them (``store.build_daily``), no job is read; equal but for the medians of the
    efficiency summary, which are of merged sketches. The sections of nodes
    (``inventory``) read the jobs either way."""
    use_utc(spark)
    if from_daily:
        journal.recover(spark, root)
        if daily.kept(spark, root):
            return _from_daily(spark, root, as_of, days, groups, inventory)
    jobs = load_recent(spark, root, as_of, days, PROCESSED)
    # jobs are not joined to the group mapping: the group report joins it to
    # per-user rows (see reports.group_stats)
    prepared = R.prepare(jobs)
    if persist:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    users = R.user_stats(prepared)
    per_day = R.daily_usage(prepared)
    out = {
        "daily_usage": per_day,
        "daily_usage_recent": R.daily_usage_recent(per_day),
        "user_stats": users,
        "top_users": R.top_users(users),
        "group_stats": R.group_stats(prepared, groups),
        "efficiency_summary": R.efficiency_summary(prepared),
        "top_wasters": R.top_wasters(prepared),
        "cluster_summary": R.cluster_summary(prepared),
        "state_distribution": R.state_distribution(prepared),
    }
    if inventory is not None:
        out.update(ND.node_report(prepared, inventory))
    return _with_charts(out)


def _from_daily(spark: SparkSession, root: str, as_of: str | dt.date, days: int, groups: DataFrame | None,
                inventory: DataFrame | None) -> dict[str, DataFrame]:
    dates = date_window(as_of, days)
    sums = daily.read(spark, root, daily.USAGE, dates)
    users, per_day = P.user_stats(sums), P.daily_usage(sums)
    out = {
        "daily_usage": per_day,
        "daily_usage_recent": R.daily_usage_recent(per_day),
        "user_stats": users,
        "top_users": R.top_users(users),
        "group_stats": P.group_stats(sums, groups),
        "efficiency_summary": R.efficiency_of_partials(daily.read(spark, root, daily.EFFICIENCY, dates)),
        "top_wasters": P.top_wasters(sums),
        "cluster_summary": P.cluster_summary(sums),
        "state_distribution": P.state_distribution(sums),
    }
    if inventory is not None:
        out.update(ND.node_report(R.prepare(load_recent(spark, root, as_of, days, PROCESSED)), inventory))
    return _with_charts(out)


def _with_charts(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out["show_group_stats"] = R.show_group_section(out["group_stats"])
    out.update({name: R.chart(out, name) for name, (section, *_) in R.CHARTS.items() if section in out})
    return out
