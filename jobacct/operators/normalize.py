"""Bronze (raw dump rows) -> silver (one typed row per job).

Per (job date, base job id) the last main row and the last '.batch' row are
picked in ONE aggregation (``max_by`` over the scan sequence, filtered by
step kind), so main/batch merging, last-wins dedupe and the join of the two
cost a single shuffle keyed by job, of the main row's texts packed into one. Other steps ('.extern', '.0', ...) are
dropped before the shuffle. Parsing happens after it, on one row per job.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.functions import metrics as M
from jobacct.functions import text as X
from jobacct.schemas import DATE_COLUMN, SILVER_COLUMNS
from jobacct.sources.accounting import SEQ

MAIN_FIELDS = (
    "JobName", "User", "UID", "Partition", "State", "Submit", "Start", "End", "ElapsedRaw",
    "AllocCPUS", "NodeList", "ReqMem", "AllocTRES", "TotalCPU", "MaxRSS", "is_finished",
)
BATCH_FIELDS = ("TotalCPU", "MaxRSS")


def processed_at_col(processed_at: dt.datetime | str | Column | None) -> Column:
    if processed_at is None:
        return F.current_timestamp()
    if isinstance(processed_at, Column):
        return processed_at
    if isinstance(processed_at, dt.datetime):
        processed_at = processed_at.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp(F.lit(processed_at))


def pick_main_and_batch(bronze: DataFrame, seq: str = SEQ) -> DataFrame:
    """W5 + J1: last main row and last batch row per (job_date, job_id_base).

    Rows without a valid job date are dropped (they belong to no date), and
    so are groups that have a batch row but no main row."""
    b = bronze.withColumn(DATE_COLUMN, X.job_date("Start", "Submit")).where(
        F.col(DATE_COLUMN).isNotNull() & (F.col("is_main_job") | F.col("is_batch_step"))
    )
    main_seq = F.when(F.col("is_main_job"), F.col(seq))
    batch_seq = F.when(F.col("is_batch_step"), F.col(seq))
    texts = [n for n in MAIN_FIELDS if n != "is_finished"]
    line = X.packed(*map(F.col, texts))
    b = b.withColumns({"_line": line, "_odd": F.when(line.isNull(), F.struct(*texts))})
    picked = (
        b.groupBy(DATE_COLUMN, "job_id_base")
        .agg(
            F.max_by(F.struct("_line", "_odd", "is_finished"), main_seq).alias("m"),
            F.max_by(F.struct(*BATCH_FIELDS), batch_seq).alias("b"),
        )
        .where(F.col("m").isNotNull())
    )
    picked = picked.select(DATE_COLUMN, "job_id_base", X.unpacked(F.col("m._line")).alias("_f"), F.col("m._odd").alias("_odd"), F.col("m.is_finished").alias("_finished"), "b")
    fields = [F.coalesce(F.col("_f")[i], F.col("_odd")[n]).alias(n) for i, n in enumerate(texts)]
    return picked.select(DATE_COLUMN, "job_id_base", F.struct(*fields, F.col("_finished").alias("is_finished")).alias("m"), "b")


def silver_from_pairs(pairs: DataFrame, processed_at=None) -> DataFrame:
    """Typed silver row from the picked main / batch structs."""
    return with_metrics(typed_from_pairs(pairs), processed_at)


def typed_from_pairs(pairs: DataFrame) -> DataFrame:
    """Typed columns of the silver row, without its metrics."""
    m = lambda f: F.col(f"m.{f}")
    b_tot, b_rss = F.col("b.TotalCPU"), F.col("b.MaxRSS")
    total_cpu_txt = F.when(b_tot.isNotNull() & (b_tot != ""), b_tot).otherwise(m("TotalCPU"))
    max_rss_txt = F.when(b_rss.isNotNull() & (b_rss != ""), b_rss).otherwise(m("MaxRSS"))
    return pairs.select(
        F.col("job_id_base").alias("job_id"),
        X.user_or_uid(m("User"), m("UID")).alias("user"),
        F.left(m("JobName"), F.lit(50)).alias("job_name"),
        m("Partition").alias("partition"),
        X.normalize_state(m("State")).alias("state"),
        X.safe_timestamp(m("Submit")).alias("submit_time"),
        X.safe_timestamp(m("Start")).alias("start_time"),
        X.safe_timestamp(m("End")).alias("end_time"),
        m("NodeList").alias("node_list"),
        X.safe_int(m("ElapsedRaw")).alias("elapsed_seconds"),
        X.safe_int(m("AllocCPUS")).alias("alloc_cpus"),
        # negative memory text is clamped per row (never drops a whole date)
        F.greatest(X.memory_mb(m("ReqMem")), F.lit(0.0)).alias("req_mem_mb"),
        F.greatest(X.memory_mb(max_rss_txt), F.lit(0.0)).alias("max_rss_mb"),
        X.cpu_seconds(total_cpu_txt).alias("total_cpu_seconds"),
        X.gpu_count(m("AllocTRES")).alias("alloc_gpus"),
        m("is_finished").alias("is_complete"),
        F.col(DATE_COLUMN),
    )


def metrics() -> dict[str, Column]:
    """P16-P19 from the typed columns."""
    e, c, t = F.col("elapsed_seconds"), F.col("alloc_cpus"), F.col("total_cpu_seconds")
    q, r, g = F.col("req_mem_mb"), F.col("max_rss_mb"), F.col("alloc_gpus")
    return {
        "cpu_efficiency": M.cpu_efficiency(t, e, c),
        "memory_efficiency": M.memory_efficiency(r, q),
        "cpu_hours_wasted": M.cpu_hours_wasted(t, e, c),
        "memory_gb_hours_wasted": M.memory_gb_hours_wasted(q, r, e),
        **M.reserved_hours(c, q, g, e),
    }


def with_metrics(typed: DataFrame, processed_at=None) -> DataFrame:
    """P16-P19 on typed columns, then the declared silver column order."""
    out = typed.withColumns({**metrics(), "processed_date": processed_at_col(processed_at)})
    extra = [DATE_COLUMN] if DATE_COLUMN in typed.columns else []
    return out.select(*SILVER_COLUMNS, *extra)


def without_metrics(silver: DataFrame) -> DataFrame:
    """Silver rows (and further columns) for a shuffle: the metrics, half of a row's size, are
    left out where they are what the typed columns give, else kept in ``_metrics``."""
    own = metrics()
    types = {f.name: f.dataType for f in silver.schema.fields}
    same = F.lit(True)
    for n, m in own.items():
        same = same & F.col(n).eqNullSafe(m.cast(types[n]))
    return silver.select(*[n for n in silver.columns if n not in own], F.when(~same, F.struct(*own)).alias("_metrics"))


def restored_metrics(lean: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``without_metrics`` with their metrics, in the columns of ``schema``."""
    own = metrics()
    kept = F.col("_metrics")
    cols = {n: F.when(kept.isNull(), m.cast(schema[n].dataType)).otherwise(kept[n]).alias(n) for n, m in own.items()}
    return lean.select(*[cols.get(n, F.col(n)) for n in schema.names])


def normalize_jobs(bronze: DataFrame, processed_at=None, seq: str = SEQ) -> DataFrame:
    """Bronze -> silver (24 declared columns + ``job_date``)."""
    return silver_from_pairs(pick_main_and_batch(bronze, seq), processed_at)
