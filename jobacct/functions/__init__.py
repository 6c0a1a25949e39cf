"""Column expressions. Everything here is a pure Catalyst expression (no UDF):
it runs inside whole-stage codegen next to the scan that feeds it."""

from jobacct.functions.metrics import (
    analysis_days,
    cpu_efficiency,
    cpu_hours_wasted,
    memory_efficiency,
    memory_gb_hours_wasted,
    reserved_hours,
    wait_seconds,
)
from jobacct.functions.nodes import expand_nodes
from jobacct.functions.text import (
    cpu_seconds,
    gpu_count,
    gres_gpus,
    is_batch_step,
    is_finished,
    is_main_job,
    job_date,
    job_id_base,
    memory_mb,
    normalize_state,
    partition_cores,
    safe_int,
    safe_timestamp,
    user_or_uid,
)

__all__ = [
    "analysis_days", "cpu_efficiency", "cpu_hours_wasted", "cpu_seconds",
    "expand_nodes", "gpu_count", "gres_gpus", "is_batch_step", "is_finished",
    "is_main_job", "job_date", "job_id_base", "memory_efficiency",
    "memory_gb_hours_wasted", "memory_mb", "normalize_state", "partition_cores",
    "reserved_hours", "safe_int", "safe_timestamp", "user_or_uid", "wait_seconds",
]
