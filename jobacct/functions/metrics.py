"""Per-job metrics (efficiency, waste, reserved hours, wait) as Columns.

The arithmetic follows the order of operations of the semantics being
reproduced so that per-row doubles are bit-identical to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clamp_pct(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0))


def cpu_efficiency(total_cpu: Column | str, elapsed: Column | str, cpus: Column | str) -> Column:
    """min(total_cpu / (elapsed * cpus) * 100, 100); 0 when elapsed or cpus is 0."""
    t, e, c = _c(total_cpu), _c(elapsed), _c(cpus)
    eff = F.least(t / (e.cast("double") * c) * 100, F.lit(100.0))
    return _clamp_pct(F.when((e > 0) & (c > 0), eff).otherwise(F.lit(0.0)))


def memory_efficiency(max_rss: Column | str, req_mem: Column | str) -> Column:
    """min(rss / req * 100, 100); 0 unless both are positive."""
    r, q = _c(max_rss), _c(req_mem)
    eff = F.least(r / q * 100, F.lit(100.0))
    return _clamp_pct(F.when((q > 0) & (r > 0), eff).otherwise(F.lit(0.0)))


def cpu_hours_wasted(total_cpu: Column | str, elapsed: Column | str, cpus: Column | str) -> Column:
    t, e, c = _c(total_cpu), _c(elapsed), _c(cpus)
    return F.greatest(F.lit(0.0), (e.cast("double") * c - t) / 3600)


def memory_gb_hours_wasted(req_mem: Column | str, max_rss: Column | str, elapsed: Column | str) -> Column:
    q, r, e = _c(req_mem), _c(max_rss), _c(elapsed)
    return F.greatest(F.lit(0.0), (q - r) * e / (1024 * 3600))


def reserved_hours(cpus: Column | str, req_mem: Column | str, gpus: Column | str, elapsed: Column | str) -> dict[str, Column]:
    """cpu / memory-GB / gpu hours reserved: amount x elapsed hours."""
    h = _c(elapsed) / 3600
    return {
        "cpu_hours_reserved": _c(cpus) * h,
        "memory_gb_hours_reserved": (_c(req_mem) / 1024) * h,
        "gpu_hours_reserved": _c(gpus) * h,
    }


def wait_seconds(submit: Column | str, start: Column | str) -> Column:
    """Whole seconds from submit to start (truncated); null unless both set."""
    s, b = _c(submit), _c(start)
    return F.when(s.isNotNull() & b.isNotNull(), F.timestamp_diff("SECOND", s, b).cast("bigint"))


def analysis_days(min_submit: Column | str, max_end: Column | str) -> Column:
    """max(floor-days(max_end - min_submit) + 1, 1); 7 when either is null.

    Days are floored like a timedelta's ``.days``."""
    lo, hi = _c(min_submit), _c(max_end)
    days = F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(86_400_000_000)) + 1
    return F.when(lo.isNotNull() & hi.isNotNull(), F.greatest(days, F.lit(1))).otherwise(F.lit(7)).cast("bigint")
