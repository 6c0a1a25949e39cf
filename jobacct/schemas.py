"""Declared schemas and fixed state lists.

The field list and the state lists below are fixed values that must equal the
accounting format and the semantics being reproduced; they are stated plainly
and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: accounting dump fields, in dump order (61) ---------------
ACCOUNTING_FIELDS: tuple[str, ...] = (
    "JobID", "JobIDRaw", "JobName", "User", "UID", "Group", "GID", "Account",
    "Partition", "QOS", "State", "ExitCode", "Submit", "Eligible", "Start",
    "End", "Elapsed", "ElapsedRaw", "CPUTime", "CPUTimeRAW", "TotalCPU",
    "UserCPU", "SystemCPU", "AllocCPUS", "AllocNodes", "NodeList", "ReqCPUS",
    "ReqMem", "ReqNodes", "Timelimit", "TimelimitRaw", "MaxRSS", "MaxVMSize",
    "MaxDiskRead", "MaxDiskWrite", "AveRSS", "AveCPU", "AveVMSize",
    "ConsumedEnergy", "ConsumedEnergyRaw", "Priority", "Reservation",
    "ReservationId", "WorkDir", "Cluster", "ReqTRES", "AllocTRES", "Comment",
    "Constraints", "Container", "DerivedExitCode", "Flags", "Layout",
    "MaxRSSNode", "MaxVMSizeNode", "MinCPU", "NCPUS", "NNodes", "NTasks",
    "Reason", "SubmitLine",
)
N_ACCOUNTING_FIELDS = len(ACCOUNTING_FIELDS)

# --- fixed values: job states ------------------------------------------------
# A date is complete only when none of its jobs is in one of these 17 states.
INCOMPLETE_JOB_STATES: tuple[str, ...] = (
    "RUNNING", "PENDING", "SUSPENDED", "COMPLETING", "CONFIGURING",
    "POWER_UP_NODE", "STAGE_OUT", "SIGNALING", "STOPPED", "UPDATE_DB",
    "REQUEUED", "REQUEUE_FED", "REQUEUE_HOLD", "SPECIAL_EXIT", "RESIZING",
    "RESV_DEL_HOLD", "REVOKED",
)
# A raw row is "finished" unless its (un-normalised) state is one of these 5.
UNFINISHED_RAW_STATES: tuple[str, ...] = (
    "RUNNING", "PENDING", "REQUEUED", "SUSPENDED", "PREEMPTED",
)
# The incremental filter re-reads a stored job only while it is in one of these 3.
ACTIVE_STORED_STATES: tuple[str, ...] = ("RUNNING", "PENDING", "SUSPENDED")
# Placeholder texts that mean "no value" in dumps.
NO_VALUE_TEXTS: tuple[str, ...] = ("", "Unknown", "N/A", "None")
# Queue rows with these oversubscribe values hold whole nodes.
EXCLUSIVE_OVERSUBSCRIBE: tuple[str, ...] = ("NO", "USER")
# Group of users that are in no configured group.
UNGROUPED = "ungrouped"
# Cores assumed for a node that has a GPU line but no CPU line.
DEFAULT_NODE_CPUS = 64

# --- declared schemas --------------------------------------------------------
BRONZE_COMPUTED = ("job_id_base", "is_batch_step", "is_main_job", "is_finished")

BRONZE = T.StructType(
    [T.StructField(f, T.StringType(), True) for f in ACCOUNTING_FIELDS]
    + [
        T.StructField("job_id_base", T.StringType(), True),
        T.StructField("is_batch_step", T.BooleanType(), True),
        T.StructField("is_main_job", T.BooleanType(), True),
        T.StructField("is_finished", T.BooleanType(), True),
    ]
)

SILVER = T.StructType(
    [
        T.StructField("job_id", T.StringType(), True),
        T.StructField("user", T.StringType(), True),
        T.StructField("job_name", T.StringType(), True),
        T.StructField("partition", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("submit_time", T.TimestampType(), True),
        T.StructField("start_time", T.TimestampType(), True),
        T.StructField("end_time", T.TimestampType(), True),
        T.StructField("node_list", T.StringType(), True),
        T.StructField("elapsed_seconds", T.LongType(), True),
        T.StructField("alloc_cpus", T.LongType(), True),
        T.StructField("req_mem_mb", T.DoubleType(), True),
        T.StructField("max_rss_mb", T.DoubleType(), True),
        T.StructField("total_cpu_seconds", T.DoubleType(), True),
        T.StructField("alloc_gpus", T.LongType(), True),
        T.StructField("cpu_efficiency", T.DoubleType(), True),
        T.StructField("memory_efficiency", T.DoubleType(), True),
        T.StructField("cpu_hours_wasted", T.DoubleType(), True),
        T.StructField("memory_gb_hours_wasted", T.DoubleType(), True),
        T.StructField("cpu_hours_reserved", T.DoubleType(), True),
        T.StructField("memory_gb_hours_reserved", T.DoubleType(), True),
        T.StructField("gpu_hours_reserved", T.DoubleType(), True),
        T.StructField("processed_date", T.TimestampType(), True),
        T.StructField("is_complete", T.BooleanType(), True),
    ]
)
SILVER_COLUMNS = tuple(f.name for f in SILVER.fields)
RESERVED_COLUMNS = ("cpu_hours_reserved", "memory_gb_hours_reserved", "gpu_hours_reserved")

# Store layout: both tables are partitioned by the job's own date (yyyy-MM-dd).
DATE_COLUMN = "job_date"
SILVER_STORED = T.StructType(SILVER.fields + [T.StructField(DATE_COLUMN, T.StringType(), True)])
BRONZE_STORED = T.StructType(BRONZE.fields + [T.StructField(DATE_COLUMN, T.StringType(), True)])

QUEUE = T.StructType(
    [
        T.StructField("line_no", T.LongType(), True),
        T.StructField("user", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("nnodes", T.LongType(), True),
        T.StructField("partition", T.StringType(), True),
        T.StructField("cores", T.LongType(), True),
        T.StructField("node", T.StringType(), True),
        T.StructField("oversubscribe", T.StringType(), True),
    ]
)

NODES = T.StructType(
    [
        T.StructField("node", T.StringType(), True),
        T.StructField("cpus", T.LongType(), True),
        T.StructField("gpus", T.LongType(), True),
    ]
)
