"""DuckDB oracle SQL for the registered queries.

Every statement starts from the integer view of ``events`` (``base``) that
the fixtures render into text, and recomputes the expected answer directly
from those integers. Doubles are rounded to 6 places on both sides; node
sums are unrounded.
"""

from __future__ import annotations

from jobacct.checks import fixtures as FX

BASE = """
base AS (
  SELECT event_id AS id, user_id, event_type, props,
    printf('user%03d', user_id) AS user_name,
    CASE event_type WHEN 'view' THEN 'batch' WHEN 'click' THEN 'interactive'
         WHEN 'purchase' THEN 'gpu' WHEN 'signup' THEN 'debug' ELSE 'long' END AS part,
    CASE event_id % 10 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED'
         WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'TIMEOUT' ELSE 'COMPLETED' END AS state,
    date_trunc('second', ts) AS start_ts,
    CAST((event_id * 37) % 7200 AS BIGINT) AS wait_s,
    CAST(CASE WHEN event_id % 10 = 1 THEN 0 ELSE (event_id * 7919) % 86400 END AS BIGINT) AS elapsed,
    CAST(1 + event_id % 64 AS BIGINT) AS cpus,
    CAST(1024 * (1 + event_id % 128) AS BIGINT) AS req_mb,
    CAST((event_id * 13) % (1024 * (1 + event_id % 128)) AS BIGINT) AS rss_mb,
    CAST(floor((CASE WHEN event_id % 10 = 1 THEN 0 ELSE (event_id * 7919) % 86400 END)
         * (1 + event_id % 64) * (event_id % 101) / 100) AS BIGINT) AS tcpu,
    CAST(CASE WHEN event_type = 'purchase' THEN event_id % 5 ELSE 0 END AS BIGINT) AS gpus,
    CAST(1 + (event_id * 7) % 60 AS BIGINT) AS n0,
    CAST(event_id % 4 AS BIGINT) AS nspan
  FROM events
)"""

# One row per job, as the engine's silver table holds it.
JOBS_T = """
{jobs} AS (
  SELECT id, user_id, state, part, start_ts, wait_s, elapsed, cpus, req_mb, rss_mb, tcpu, gpus, n0, nspan,
    CAST(id AS VARCHAR) AS job_id,
    CASE WHEN id % 89 = 7 THEN (CASE WHEN id % 2 = 0 THEN 'MISSING_USER' ELSE 'uid_' || CAST(user_id AS VARCHAR) END)
         ELSE user_name END AS "user",
    CASE WHEN id % 89 = 7 THEN 'ungrouped'
         ELSE CASE user_id % 5 WHEN 0 THEN 'physics' WHEN 1 THEN 'chemistry' WHEN 2 THEN 'biology'
              WHEN 3 THEN 'astronomy' ELSE 'ungrouped' END END AS "group",
    left(event_type || '_' || props || '_' || repeat('x', CAST(id % 40 AS INTEGER)), 50) AS job_name,
    part AS "partition",
    start_ts - to_seconds(wait_s) AS submit_time,
    CASE WHEN id % 10 = 1 THEN NULL ELSE start_ts END AS start_time,
    CASE WHEN id % 10 = 1 OR state = 'RUNNING' THEN NULL ELSE start_ts + to_seconds(elapsed) END AS end_time,
    CASE WHEN id % 10 = 1 THEN '' WHEN nspan = 0 THEN printf('node-%03d', n0)
         ELSE printf('node-[%03d-%03d]', n0, n0 + nspan) END AS node_list,
    elapsed AS elapsed_seconds, cpus AS alloc_cpus, CAST(req_mb AS DOUBLE) AS req_mem_mb,
    CAST(CASE WHEN id % 10 = 1 THEN 0 ELSE rss_mb END AS DOUBLE) AS max_rss_mb,
    CAST(CASE WHEN id % 10 = 1 THEN 0 ELSE tcpu END AS DOUBLE) AS total_cpu_seconds,
    gpus AS alloc_gpus,
    strftime(CASE WHEN id % 10 = 1 THEN start_ts - to_seconds(wait_s) ELSE start_ts END, '%Y-%m-%d') AS job_date
  FROM {base}
),
{metrics} AS (
  SELECT *,
    CASE WHEN elapsed_seconds > 0 AND alloc_cpus > 0
         THEN least(total_cpu_seconds / (CAST(elapsed_seconds AS DOUBLE) * alloc_cpus) * 100, 100.0) ELSE 0.0 END AS cpu_efficiency,
    CASE WHEN req_mem_mb > 0 AND max_rss_mb > 0 THEN least(max_rss_mb / req_mem_mb * 100, 100.0) ELSE 0.0 END AS memory_efficiency,
    CAST(elapsed_seconds AS DOUBLE) * alloc_cpus AS cpu_s,
    CAST(elapsed_seconds AS DOUBLE) * alloc_gpus AS gpu_s,
    req_mem_mb * elapsed_seconds AS mem_mb_s,
    greatest(CAST(elapsed_seconds AS DOUBLE) * alloc_cpus - total_cpu_seconds, 0.0) AS cpu_waste_s,
    greatest((req_mem_mb - max_rss_mb) * elapsed_seconds, 0.0) AS mem_waste_mb_s,
    CASE WHEN start_time IS NOT NULL THEN CAST(wait_s AS BIGINT) END AS wait_seconds
  FROM {jobs}
)"""




def jobs_cte(run: int = 0) -> str:
    """``jobs<r>`` / ``metrics<r>`` CTEs of collection run ``r`` (0: plain)."""
    sfx = "" if run == 0 else str(run)
    return JOBS_T.format(base="base" + sfx, jobs="jobs" + sfx, metrics="metrics" + sfx)


JOBS = jobs_cte(0)

RUN_BASES = """
base1 AS (SELECT * FROM base WHERE id % 20 <> 7),
base2 AS (
  SELECT * REPLACE (CASE
    WHEN state = 'RUNNING' AND (id % 20 = 0 OR strftime(start_ts, '%Y-%m-%d') < '2024-01-08') THEN 'COMPLETED'
    WHEN state = 'PENDING' AND strftime(start_ts - to_seconds(wait_s), '%Y-%m-%d') < '2024-01-08' THEN 'CANCELLED'
    ELSE state END AS state)
  FROM base
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def q(body: str) -> str:
    """A statement over base + jobs + metrics."""
    return with_ctes(BASE, JOBS) + body


SQL: dict[str, str] = {}

SQL["user_stats"] = q("""
SELECT "user", CAST(count(*) AS BIGINT) AS job_count,
  round(sum(cpu_s) / 3600.0, 6) AS total_cpu_hours,
  round(sum(mem_mb_s) / 3686400.0, 6) AS total_memory_gb_hours,
  round(sum(gpu_s) / 3600.0, 6) AS total_gpu_hours,
  round(sum(cpu_waste_s) / 3600.0, 6) AS cpu_hours_wasted,
  round(sum(mem_waste_mb_s) / 3686400.0, 6) AS memory_gb_hours_wasted,
  round(sum(req_mem_mb) / 1024.0, 6) AS total_ram_gb,
  round(avg(wait_seconds) / 3600.0, 6) AS avg_wait_hours,
  round(avg(CASE WHEN state = 'COMPLETED' THEN cpu_efficiency END), 6) AS avg_cpu_efficiency,
  round(avg(CASE WHEN state = 'COMPLETED' THEN memory_efficiency END), 6) AS avg_mem_efficiency
FROM metrics GROUP BY "user"
""")

USAGE = """
  CAST(count(*) AS BIGINT) AS job_count,
  round(sum(cpu_s) / 3600.0, 6) AS total_cpu_hours,
  round(sum(mem_mb_s) / 3686400.0, 6) AS total_memory_gb_hours,
  round(sum(gpu_s) / 3600.0, 6) AS total_gpu_hours,
  round(sum(cpu_waste_s) / 3600.0, 6) AS cpu_hours_wasted,
  round(sum(mem_waste_mb_s) / 3686400.0, 6) AS memory_gb_hours_wasted"""

INCOMPLETE = ("'RUNNING','PENDING','SUSPENDED','COMPLETING','CONFIGURING','POWER_UP_NODE','STAGE_OUT',"
              "'SIGNALING','STOPPED','UPDATE_DB','REQUEUED','REQUEUE_FED','REQUEUE_HOLD','SPECIAL_EXIT',"
              "'RESIZING','RESV_DEL_HOLD','REVOKED'")

SQL["group_stats"] = q(f"""
SELECT "group", CAST(count(DISTINCT "user") AS BIGINT) AS unique_users, {USAGE}
FROM metrics GROUP BY "group"
""")

DAILY = """
SELECT strftime(coalesce(start_time, submit_time), '%Y-%m-%d') AS job_date, CAST(count(*) AS BIGINT) AS job_count,
  round(sum(cpu_s) / 3600.0, 6) AS cpu_hours, round(sum(gpu_s) / 3600.0, 6) AS gpu_hours,
  round(sum(mem_mb_s) / 3686400.0, 6) AS memory_gb_hours, CAST(count(DISTINCT "user") AS BIGINT) AS unique_users
FROM metrics GROUP BY 1"""
SQL["daily_usage"] = q(DAILY)
SQL["daily_usage_recent"] = q(f"SELECT * FROM ({DAILY}) ORDER BY job_date DESC LIMIT 14")

SQL["efficiency_summary"] = q("""
SELECT CAST(count(*) AS BIGINT) AS completed_jobs,
  round(avg(cpu_efficiency), 6) AS cpu_mean, round(median(cpu_efficiency), 6) AS cpu_median,
  round(min(cpu_efficiency), 6) AS cpu_min, round(max(cpu_efficiency), 6) AS cpu_max,
  round(avg(memory_efficiency), 6) AS mem_mean, round(median(memory_efficiency), 6) AS mem_median,
  round(min(memory_efficiency), 6) AS mem_min, round(max(memory_efficiency), 6) AS mem_max
FROM metrics WHERE state = 'COMPLETED' HAVING count(*) > 0
""")

SQL["top_wasters"] = q("""
SELECT "user", round(sum(cpu_waste_s) / 3600.0, 6) AS cpu_wasted, round(sum(mem_waste_mb_s) / 3686400.0, 6) AS mem_wasted
FROM metrics WHERE state = 'COMPLETED' GROUP BY "user" ORDER BY sum(cpu_waste_s) DESC, "user" LIMIT 10
""")

SQL["cluster_summary"] = q("""
SELECT CAST(count(*) AS BIGINT) AS total_jobs, CAST(count(DISTINCT "user") AS BIGINT) AS unique_users,
  round(sum(cpu_s) / 3600.0, 6) AS total_cpu_hours, round(sum(gpu_s) / 3600.0, 6) AS total_gpu_hours,
  round(sum(req_mem_mb) / 1024.0, 6) AS total_ram_gb, round(avg(wait_seconds) / 3600.0, 6) AS avg_wait_hours,
  (SELECT string_agg(state || ': ' || format('{:,}', c), ', ' ORDER BY c DESC, state)
     FROM (SELECT state, count(*) AS c FROM metrics GROUP BY state ORDER BY c DESC, state LIMIT 3)) AS top_states
FROM metrics
""")

SQL["state_distribution"] = q("""
SELECT state, CAST(count(*) AS BIGINT) AS "count",
  round(count(*) / (SELECT count(*) FROM metrics) * 100, 6) AS percentage
FROM metrics GROUP BY state
""")

SQL["worst_users"] = q("""
SELECT "user", round(avg(cpu_efficiency), 6) AS cpu_efficiency FROM metrics WHERE state = 'COMPLETED'
GROUP BY "user" ORDER BY avg(cpu_efficiency) ASC NULLS FIRST, "user" LIMIT 5
""")

SQL["waste_by_partition"] = q("""
SELECT "partition", round(sum(cpu_waste_s) / 3600.0, 6) AS cpu_hours_wasted FROM metrics GROUP BY "partition"
""")

SQL["analysis_period"] = q("""
SELECT CAST(CASE WHEN min(submit_time) IS NOT NULL AND max(end_time) IS NOT NULL
  THEN greatest(floor((epoch_us(max(end_time)) - epoch_us(min(submit_time))) / 86400000000) + 1, 1) ELSE 7 END AS BIGINT) AS period_days
FROM metrics
""")

SQL["top_users"] = q("""
SELECT * FROM (
SELECT "user", CAST(count(*) AS BIGINT) AS job_count,
  round(sum(cpu_s) / 3600.0, 6) AS total_cpu_hours,
  round(sum(mem_mb_s) / 3686400.0, 6) AS total_memory_gb_hours,
  round(sum(gpu_s) / 3600.0, 6) AS total_gpu_hours,
  round(sum(cpu_waste_s) / 3600.0, 6) AS cpu_hours_wasted,
  round(sum(mem_waste_mb_s) / 3686400.0, 6) AS memory_gb_hours_wasted,
  round(sum(req_mem_mb) / 1024.0, 6) AS total_ram_gb,
  round(avg(wait_seconds) / 3600.0, 6) AS avg_wait_hours,
  round(avg(CASE WHEN state = 'COMPLETED' THEN cpu_efficiency END), 6) AS avg_cpu_efficiency,
  round(avg(CASE WHEN state = 'COMPLETED' THEN memory_efficiency END), 6) AS avg_mem_efficiency,
  sum(cpu_s) AS _k
FROM metrics GROUP BY "user") ORDER BY _k DESC, "user" LIMIT 15
""").replace("SELECT * FROM (", "SELECT * EXCLUDE (_k) FROM (")

SQL["top_share"] = q("""
, us AS (SELECT "user", sum(cpu_s) / 3600.0 AS v FROM metrics GROUP BY "user"),
pos AS (SELECT * FROM us WHERE v > 0),
tot AS (SELECT sum(v) AS t, max(v) AS mx FROM pos)
SELECT left("user", 15) AS label, round(v, 6) AS "value", round(v / t * 100, 6) AS share_pct,
  CAST(CASE WHEN mx > 0 THEN floor(v / mx * 50) ELSE 0 END AS BIGINT) AS bar_length,
  CASE WHEN v > mx * 0.66 THEN 'red' WHEN v > mx * 0.33 THEN 'yellow' ELSE 'green' END AS band
FROM pos, tot ORDER BY v DESC, "user" LIMIT 20
""").replace("\n\n, us AS", ", us AS")

SQL["incomplete_jobs"] = q(f"SELECT job_id, state, job_date FROM metrics WHERE state IN ({INCOMPLETE})")

SQL["prepare"] = q("""
SELECT job_id, "user", "group", wait_seconds, round(alloc_cpus * (elapsed_seconds / 3600.0), 6) AS cpu_hours_reserved FROM metrics
""")
SQL["with_group"] = q('SELECT job_id, "user", "group" FROM metrics')
SQL["groups_table"] = with_ctes(BASE) + """
SELECT DISTINCT user_name AS "user", CASE user_id % 5 WHEN 0 THEN 'physics' WHEN 1 THEN 'chemistry'
  WHEN 2 THEN 'biology' ELSE 'astronomy' END AS "group"
FROM base WHERE user_id % 5 < 4
"""
SQL["wait_time"] = q("SELECT job_id, wait_seconds FROM metrics")
SQL["backfill_reserved"] = q("""
SELECT job_id, round(alloc_cpus * (elapsed_seconds / 3600.0), 6) AS cpu_hours_reserved,
  round((req_mem_mb / 1024) * (elapsed_seconds / 3600.0), 6) AS memory_gb_hours_reserved,
  CAST(0.0 AS DOUBLE) AS gpu_hours_reserved FROM metrics
""")
JOB_METRICS = """
  round(cpu_efficiency, 6) AS cpu_efficiency, round(memory_efficiency, 6) AS memory_efficiency,
  round(greatest(0.0, (CAST(elapsed_seconds AS DOUBLE) * alloc_cpus - total_cpu_seconds) / 3600), 6) AS cpu_hours_wasted,
  round(greatest(0.0, (req_mem_mb - max_rss_mb) * elapsed_seconds / 3686400), 6) AS memory_gb_hours_wasted,
  round(alloc_cpus * (elapsed_seconds / 3600.0), 6) AS cpu_hours_reserved,
  round((req_mem_mb / 1024) * (elapsed_seconds / 3600.0), 6) AS memory_gb_hours_reserved,
  round(alloc_gpus * (elapsed_seconds / 3600.0), 6) AS gpu_hours_reserved"""
SQL["job_metrics"] = q(f"SELECT job_id, {JOB_METRICS} FROM metrics")

SILVER_SELECT = f"""
  job_id, "user", job_name, "partition", state,
  strftime(submit_time, '%Y-%m-%d %H:%M:%S') AS submit_time, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,
  strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, node_list, elapsed_seconds, alloc_cpus,
  round(req_mem_mb, 6) AS req_mem_mb, round(max_rss_mb, 6) AS max_rss_mb, round(total_cpu_seconds, 6) AS total_cpu_seconds,
  alloc_gpus, {JOB_METRICS},
  '2024-02-01 06:00:00' AS processed_date, state NOT IN ('RUNNING', 'PENDING') AS is_complete, job_date"""
SQL["normalize_jobs"] = q(f"SELECT {SILVER_SELECT} FROM metrics")
SQL["main_batch_join"] = q("SELECT job_id, state, alloc_cpus, total_cpu_seconds, max_rss_mb FROM metrics")

# every rendered dump line: kind in stale | main | batch | extern | step0
LINES_T = """
{lines} AS (
  SELECT b.*, k.kind,
    CASE k.kind WHEN 'batch' THEN CAST(id AS VARCHAR) || '.batch' WHEN 'extern' THEN CAST(id AS VARCHAR) || '.extern'
      WHEN 'step0' THEN CAST(id AS VARCHAR) || '.0' ELSE CAST(id AS VARCHAR) END AS "JobID",
    CASE WHEN state = 'CANCELLED' THEN 'CANCELLED by ' || CAST(user_id AS VARCHAR) ELSE state END AS state_txt,
    CASE WHEN id % 10 = 1 THEN '' WHEN nspan = 0 THEN printf('node-%03d', n0)
         ELSE printf('node-[%03d-%03d]', n0, n0 + nspan) END AS node_txt,
    strftime(CASE WHEN id % 10 = 1 THEN start_ts - to_seconds(wait_s) ELSE start_ts END, '%Y-%m-%d') AS own_date
  FROM {base} b JOIN (VALUES ('stale'), ('main'), ('batch'), ('extern'), ('step0')) k(kind)
    ON (k.kind = 'main') OR (k.kind = 'stale' AND b.id % 50 = 25)
    OR (b.id % 10 <> 1 AND (k.kind = 'batch' OR (k.kind = 'extern' AND b.id % 7 = 0) OR (k.kind = 'step0' AND b.id % 11 = 0)))
)"""


LINES = LINES_T.format(lines="lines", base="base")


def ql(body: str) -> str:
    return with_ctes(BASE, LINES) + body


SQL["scan_accounting"] = ql("""
SELECT "JobID", "JobID" AS "JobIDRaw",
  CASE WHEN kind IN ('main', 'stale') THEN (CASE WHEN id % 89 = 7 THEN '' ELSE user_name END) ELSE '' END AS "User",
  CASE WHEN kind = 'stale' THEN 'PENDING' ELSE state_txt END AS "State",
  CASE WHEN kind = 'batch' THEN '' ELSE part END AS "Partition",
  node_txt AS "NodeList", CASE WHEN kind = 'stale' THEN '0' ELSE CAST(elapsed AS VARCHAR) END AS "ElapsedRaw"
FROM lines
""")
SQL["scan_day"] = ql("""
SELECT own_date AS job_date, CAST(count(*) AS BIGINT) AS lines,
  CAST(count(*) FILTER (WHERE kind IN ('main', 'stale')) AS BIGINT) AS main_lines,
  CAST(count(*) FILTER (WHERE kind = 'batch') AS BIGINT) AS batch_lines
FROM lines GROUP BY 1
""")
SQL["classify_steps"] = ql("""
SELECT "JobID", CAST(id AS VARCHAR) AS job_id_base, kind = 'batch' AS is_batch_step, kind IN ('main', 'stale') AS is_main_job,
  NOT (CASE WHEN kind = 'stale' THEN 'PENDING' ELSE state_txt END) IN ('RUNNING', 'PENDING', 'REQUEUED', 'SUSPENDED', 'PREEMPTED') AS is_finished
FROM lines
""")
SQL["job_date"] = ql('SELECT "JobID", own_date AS job_date FROM lines')
SQL["normalize_state"] = ql("""
SELECT "JobID", CASE WHEN kind = 'stale' THEN 'PENDING' ELSE state_txt END AS raw_state,
  CASE WHEN kind = 'stale' THEN 'PENDING' ELSE state END AS state
FROM lines WHERE kind IN ('main', 'stale')
""")
SQL["user_fallback"] = ql("""
SELECT "JobID", CASE WHEN id % 89 = 7 THEN (CASE WHEN id % 2 = 0 THEN 'MISSING_USER' ELSE 'uid_' || CAST(user_id AS VARCHAR) END)
  ELSE user_name END AS "user"
FROM lines WHERE kind IN ('main', 'stale')
""")
SQL["parse_memory"] = ql("""
SELECT "JobID", CASE WHEN kind = 'stale' THEN 1.0 ELSE CAST(req_mb AS DOUBLE) END AS req_mem_mb,
  CASE kind WHEN 'batch' THEN CAST(rss_mb AS DOUBLE) WHEN 'step0' THEN 999.0 * 1024 ELSE 0.0 END AS max_rss_mb
FROM lines
""")
SQL["parse_cpu_time"] = ql("""
SELECT "JobID", CASE kind WHEN 'batch' THEN CAST(tcpu AS DOUBLE) WHEN 'extern' THEN 1.0 WHEN 'step0' THEN 777600.0 ELSE 0.0 END AS total_cpu_seconds
FROM lines
""")
SQL["parse_int"] = ql("""
SELECT "JobID", CASE WHEN kind = 'stale' THEN 0 ELSE elapsed END AS elapsed_seconds,
  CASE WHEN kind = 'stale' THEN 1 ELSE cpus END AS alloc_cpus
FROM lines
""")
SQL["parse_timestamp"] = ql("""
SELECT "JobID", strftime(start_ts - to_seconds(wait_s), '%Y-%m-%d %H:%M:%S') AS submit_time,
  CASE WHEN state = 'PENDING' THEN NULL ELSE strftime(start_ts, '%Y-%m-%d %H:%M:%S') END AS start_time,
  CASE WHEN state IN ('PENDING', 'RUNNING') THEN NULL ELSE strftime(start_ts + to_seconds(elapsed), '%Y-%m-%d %H:%M:%S') END AS end_time
FROM lines WHERE kind IN ('main', 'stale')
""")
SQL["parse_gpu"] = ql("SELECT \"JobID\", CASE WHEN kind = 'batch' THEN 0 ELSE gpus END AS alloc_gpus FROM lines")
SQL["partition_cores"] = ql("""
SELECT "JobID", part || '-' || CAST(CASE WHEN kind = 'stale' THEN 1 ELSE cpus END AS VARCHAR) || 'c' AS "partition",
  CAST(CASE WHEN kind = 'stale' THEN 1 ELSE cpus END AS BIGINT) AS cores
FROM lines WHERE kind IN ('main', 'stale')
""")

# --- nodes -------------------------------------------------------------------
NODE_ROWS = """
node_rows AS (
  SELECT printf('node-%03d', k) AS node, (alloc_cpus * (elapsed_seconds / 3600.0)) / (nspan + 1) AS cpu_hours,
    (alloc_gpus * (elapsed_seconds / 3600.0)) / (nspan + 1) AS gpu_hours,
    (elapsed_seconds / 3600.0) / (nspan + 1) AS elapsed_hours
  FROM (SELECT *, unnest(range(n0, n0 + nspan + 1)) AS k FROM metrics WHERE id % 10 <> 1)
),
node_ids AS (SELECT DISTINCT n0 AS n FROM base),
inventory AS (
  SELECT printf('node-%03d', n) AS node, CAST(32 * (1 + n % 4) AS BIGINT) AS cpus,
    CAST(CASE WHEN n % 3 = 0 THEN 4 ELSE 0 END AS BIGINT) AS gpus FROM node_ids
  UNION ALL SELECT printf('gpunode-%03d', n), CAST(64 AS BIGINT), CAST(2 AS BIGINT) FROM node_ids WHERE n % 30 = 0
),
period AS (
  SELECT CAST(CASE WHEN min(submit_time) IS NOT NULL AND max(end_time) IS NOT NULL
    THEN greatest(floor((epoch_us(max(end_time)) - epoch_us(min(submit_time))) / 86400000000) + 1, 1) ELSE 7 END AS BIGINT) AS period_days
  FROM metrics
),
node_stats AS (
  SELECT t.*, i.cpus AS est_cpus, i.cpus * p.period_days * 24 AS cpu_hours_available,
    t.total_cpu_hours / (i.cpus * p.period_days * 24) * 100 AS cpu_utilization_pct
  FROM (SELECT node, sum(cpu_hours) AS total_cpu_hours, sum(gpu_hours) AS total_gpu_hours, sum(elapsed_hours) AS total_elapsed_hours,
          CAST(count(*) AS BIGINT) AS job_count FROM node_rows GROUP BY node) t
  LEFT JOIN inventory i ON t.node = i.node, period p
)"""


def qn(body: str) -> str:
    return with_ctes(BASE, JOBS, NODE_ROWS) + body


NODE_STATS_COLS = """node, round(total_cpu_hours, 6) AS total_cpu_hours, round(total_gpu_hours, 6) AS total_gpu_hours,
  round(total_elapsed_hours, 6) AS total_elapsed_hours, job_count, est_cpus, cpu_hours_available,
  round(cpu_utilization_pct, 6) AS cpu_utilization_pct"""
SQL["node_usage"] = qn("SELECT node, round(cpu_hours, 6) AS cpu_hours, round(gpu_hours, 6) AS gpu_hours, round(elapsed_hours, 6) AS elapsed_hours FROM node_rows")
SQL["node_stats"] = qn(f"SELECT {NODE_STATS_COLS} FROM node_stats")
SQL["top_nodes"] = qn(f"SELECT {NODE_STATS_COLS} FROM node_stats ORDER BY total_cpu_hours DESC, node LIMIT 20")
SQL["nodes_missing_cpu"] = qn("SELECT node, round(total_cpu_hours, 6) AS total_cpu_hours FROM node_stats WHERE est_cpus IS NULL")
SQL["gpu_utilization"] = qn("""
SELECT s.node, round(s.total_gpu_hours, 6) AS total_gpu_hours, i.gpus AS est_gpus, i.gpus * p.period_days * 24 AS gpu_hours_available,
  round(s.total_gpu_hours / (i.gpus * p.period_days * 24) * 100, 6) AS gpu_utilization_pct
FROM node_stats s JOIN inventory i ON s.node = i.node, period p
WHERE s.total_gpu_hours > 0 AND i.gpus > 0
""")
SQL["node_inventory"] = qn("SELECT node, cpus, gpus FROM inventory")
SQL["inventory_summary"] = qn("""
SELECT CAST(count(*) AS BIGINT) AS total_nodes, CAST(sum(cpus) AS BIGINT) AS total_cpus, CAST(sum(gpus) AS BIGINT) AS total_gpus,
  CAST(count(*) FILTER (WHERE gpus > 0) AS BIGINT) AS gpu_nodes FROM inventory
""")
SQL["scan_node_cpus"] = with_ctes(BASE) + """
SELECT DISTINCT printf('node-%03d', n0) AS node, CAST(32 * (1 + n0 % 4) AS BIGINT) AS cpus FROM base
"""
SQL["scan_node_gpus"] = with_ctes(BASE) + """
SELECT DISTINCT printf('node-%03d', n0) AS node, CAST(4 AS BIGINT) AS gpus FROM base WHERE n0 % 3 = 0
UNION ALL SELECT DISTINCT printf('gpunode-%03d', n0), CAST(2 AS BIGINT) FROM base WHERE n0 % 30 = 0
"""
SQL["parse_gres"] = with_ctes(BASE) + """
SELECT node, gres, gpus FROM (
  SELECT DISTINCT n0, printf('node-%03d', n0) AS node,
    CASE n0 % 9 WHEN 0 THEN 'gpu:4' WHEN 3 THEN 'gpu:v100:4(S:0-1)' WHEN 6 THEN 'gpu:a100:4(S:0)' ELSE '(null)' END AS gres,
    CAST(CASE WHEN n0 % 3 = 0 THEN 4 END AS BIGINT) AS gpus FROM base
  UNION ALL SELECT DISTINCT n0, printf('gpunode-%03d', n0), 'gpu:2', CAST(2 AS BIGINT) FROM base WHERE n0 % 30 = 0)
"""
SQL["node_total_cores"] = with_ctes(BASE) + """
SELECT DISTINCT printf('node-%03d', n0) AS node, CAST(32 * (1 + n0 % 4) AS BIGINT) AS cores FROM base
"""
SQL["expand_nodes"] = ql("""
SELECT "JobID", node_txt AS "NodeList",
  CASE WHEN state = 'PENDING' THEN '' ELSE array_to_string(list_transform(range(n0, n0 + nspan + 1), lambda k: printf('node-%03d', k)), ',') END AS nodes
FROM lines WHERE kind IN ('main', 'stale')
""")

# --- live queue ---------------------------------------------------------------
QUEUE = """
q AS (
  SELECT id * 10 AS line_no, user_name AS "user", CASE WHEN state = 'RUNNING' THEN 'R' ELSE 'PD' END AS status,
    nspan + 1 AS nnodes, part AS "partition", cpus AS cores,
    CASE WHEN state = 'RUNNING' THEN (CASE WHEN nspan = 0 THEN printf('node-%03d', n0) ELSE printf('node-[%03d-%03d]', n0, n0 + nspan) END)
         ELSE '(null)' END AS node,
    CASE id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'NO' WHEN 2 THEN 'USER' ELSE 'YES' END AS oversubscribe,
    CASE WHEN state = 'RUNNING' THEN CAST(32 * (1 + n0 % 4) AS BIGINT) ELSE 0 END AS node_cores
  FROM base WHERE state IN ('RUNNING', 'PENDING')
),
counted AS (
  SELECT line_no, "user", "partition", status, node_cores AS cores_val, node_cores AS nodes_val FROM (
    SELECT *, row_number() OVER (PARTITION BY "user", node ORDER BY line_no) AS rn FROM q WHERE oversubscribe IN ('NO', 'USER')) WHERE rn = 1
  UNION ALL
  SELECT line_no, "user", "partition", status, cores, nnodes FROM q WHERE oversubscribe NOT IN ('NO', 'USER')
),
usage AS (
  SELECT "user", "partition", status, CAST(sum(cores_val) AS BIGINT) AS cores, CAST(sum(nodes_val) AS BIGINT) AS nodes,
    min(line_no) AS first_line FROM counted GROUP BY ALL
)"""


def qq(body: str) -> str:
    return with_ctes(BASE, QUEUE) + body


SQL["scan_queue"] = qq('SELECT CAST(line_no AS BIGINT) AS line_no, "user", status, nnodes, "partition", cores, node, oversubscribe FROM q')
SQL["queue_usage_cores"] = qq('SELECT "user", "partition", status, cores FROM usage')
SQL["queue_usage_nodes"] = qq('SELECT "user", "partition", status, nodes FROM usage')
SQL["queue_totals"] = qq("""
SELECT CASE WHEN grouping("user") = 0 THEN 'user_status' WHEN grouping("partition") = 0 THEN 'partition_status' ELSE 'status' END AS level,
  "user", "partition", status, CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(nodes) AS BIGINT) AS nodes
FROM usage GROUP BY GROUPING SETS (("partition", status), (status), ("user", status))
""")
SQL["status_summary"] = qq("""
SELECT "user", "partition", string_agg(status || '=' || CAST(cores AS VARCHAR), ' / ' ORDER BY first_line) AS cores_summary,
  string_agg(status || '=' || CAST(nodes AS VARCHAR), ' / ' ORDER BY first_line) AS nodes_summary
FROM usage GROUP BY "user", "partition"
""")
GRID = """
SELECT "user", "partition", string_agg(status || '=' || CAST(cores AS VARCHAR), ' / ' ORDER BY first_line) AS cores_cell,
  string_agg(status || '=' || CAST(nodes AS VARCHAR), ' / ' ORDER BY first_line) AS nodes_cell
FROM usage GROUP BY "user", "partition"
UNION ALL
SELECT "user", 'Total', string_agg(status || '=' || CAST(c AS VARCHAR), ' / ' ORDER BY k1, k2),
  string_agg(status || '=' || CAST(n AS VARCHAR), ' / ' ORDER BY k1, k2)
FROM (SELECT u."user", u.status, min(p.pf) AS k1, arg_min(u.first_line, p.pf) AS k2, sum(u.cores) AS c, sum(u.nodes) AS n
      FROM usage u JOIN (SELECT "user", "partition", min(first_line) AS pf FROM usage GROUP BY ALL) p USING ("user", "partition")
      GROUP BY u."user", u.status) GROUP BY "user"
UNION ALL
SELECT (SELECT CAST(count(DISTINCT "user") AS VARCHAR) || ' users' FROM usage), "partition",
  string_agg(status || '=' || CAST(c AS VARCHAR), ' / ' ORDER BY f), string_agg(status || '=' || CAST(n AS VARCHAR), ' / ' ORDER BY f)
FROM (SELECT "partition", status, min(first_line) AS f, sum(cores) AS c, sum(nodes) AS n FROM usage GROUP BY ALL) GROUP BY "partition"
UNION ALL
SELECT (SELECT CAST(count(DISTINCT "user") AS VARCHAR) || ' users' FROM usage), 'Total',
  string_agg(status || '=' || CAST(c AS VARCHAR), ' / ' ORDER BY f), string_agg(status || '=' || CAST(n AS VARCHAR), ' / ' ORDER BY f)
FROM (SELECT status, min(first_line) AS f, sum(cores) AS c, sum(nodes) AS n FROM usage GROUP BY ALL)
"""
SQL["queue_grid"] = qq(GRID)
SQL["max_lengths"] = qq(f"""
SELECT CAST(max(length("user")) AS INTEGER) AS "user", CAST(max(length("partition")) AS INTEGER) AS "partition",
  CAST(max(length(cores_cell)) AS INTEGER) AS cores_cell, CAST(max(length(nodes_cell)) AS INTEGER) AS nodes_cell FROM ({GRID})
""")


# --- store and incremental collection ----------------------------------------------
RUNS = [BASE, RUN_BASES, jobs_cte(1), jobs_cte(2)]


def qr(body: str, *extra: str) -> str:
    return with_ctes(*RUNS, *extra) + body


T1, T2 = "'2024-02-01 06:00:00'", "'2024-02-02 06:00:00'"
SQL["write_silver"] = SQL["normalize_jobs"]
SQL["reprocess_missing"] = SQL["normalize_jobs"]
SQL["write_bronze"] = ql("""
SELECT "JobID", "JobID" AS "JobIDRaw", CASE WHEN kind = 'stale' THEN 'PENDING' ELSE state_txt END AS "State", own_date AS job_date FROM lines
""")
SQL["reload_raw"] = ql('SELECT "JobID", own_date AS job_date FROM lines')
SQL["load_recent_raw"] = ql("""SELECT "JobID" AS "JobIDRaw", state_txt AS "State", own_date AS job_date FROM lines WHERE kind <> 'stale'""")
SQL["load_recent_processed"] = qr(f"SELECT job_id, state, {T2} AS processed_date, job_date FROM metrics2")
SQL["latest_per_job"] = SQL["load_recent_processed"]
SQL["upsert_silver"] = SQL["load_recent_processed"]
SQL["load_days"] = qr("SELECT job_id, state, job_date FROM metrics1 UNION ALL SELECT job_id, state, job_date FROM metrics2")
SQL["dedupe_newest_date"] = qr("SELECT job_id, state, job_date FROM metrics2")
COMPLETE = f"""
complete AS (
  SELECT job_date, bool_and(state NOT IN ({INCOMPLETE})) AND job_date < (SELECT strftime(max(ts)::DATE + 2, '%Y-%m-%d') FROM events) AS is_complete FROM metrics2 GROUP BY job_date
)"""
SQL["date_completeness"] = qr("SELECT job_date, is_complete FROM complete", COMPLETE)
SQL["completed_roundtrip"] = qr(f"SELECT job_date, {T2} AS marked_at FROM complete WHERE is_complete", COMPLETE)
SQL["dates_to_collect"] = qr("""
SELECT strftime(d, '%Y-%m-%d') AS job_date FROM (SELECT unnest(range(min(ts)::DATE - INTERVAL 1 DAY, max(ts)::DATE + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS d FROM events)
WHERE strftime(d, '%Y-%m-%d') NOT IN (SELECT job_date FROM complete WHERE is_complete)
""", COMPLETE)
SQL["incremental_filter"] = qr("""
SELECT "JobID", own_date AS job_date FROM lines2 l LEFT JOIN (SELECT job_id, state AS old_state, job_date FROM metrics1) e
  ON e.job_id = CAST(l.id AS VARCHAR) AND e.job_date = l.own_date
WHERE NOT coalesce(e.old_state IS NOT NULL AND e.old_state NOT IN ('RUNNING', 'PENDING', 'SUSPENDED')
  AND (l.kind NOT IN ('main', 'stale') OR (CASE WHEN l.kind = 'stale' THEN 'PENDING' ELSE l.state END) = e.old_state), false)
""", LINES_T.format(lines="lines2", base="base2"))
REPROCESSED = "(id % 20 = 7 OR id IN (SELECT id FROM base WHERE state IN ('RUNNING', 'PENDING')))"
SQL["collect_incremental"] = qr(f"""
SELECT job_id, state, CASE WHEN {REPROCESSED} THEN {T2} ELSE {T1} END AS processed_date,
  strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, total_cpu_seconds, job_date FROM metrics2
""")
SQL["collect_metrics"] = qr(f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM lines2) AS raw_records,
  (SELECT CAST(count(*) AS BIGINT) FROM metrics2 WHERE {REPROCESSED}) AS processed_jobs,
  (SELECT CAST(count(*) AS BIGINT) FROM metrics2 WHERE id % 20 = 7) AS inserted_jobs,
  (SELECT CAST(count(*) AS BIGINT) FROM metrics2 WHERE {REPROCESSED} AND id % 20 <> 7) AS updated_jobs,
  (SELECT CAST(count(*) AS BIGINT) FROM metrics2 WHERE NOT {REPROCESSED}) AS skipped_jobs,
  (SELECT CAST(count(*) AS BIGINT) FROM complete WHERE is_complete) AS completed_dates
""", COMPLETE, LINES_T.format(lines="lines2", base="base2"))
SQL["analyze_user_stats"] = qr(SQL["user_stats"].split("FROM metrics GROUP BY", 1)[0].split("\nSELECT", 1)[1].join(["SELECT", ""]) + " FROM metrics2 GROUP BY \"user\"")

# --- pseudonymisation ---------------------------------------------------------------
PSEUDO = """
pl AS (
  SELECT *, id * 10 + CASE kind WHEN 'stale' THEN 0 WHEN 'main' THEN 1 WHEN 'batch' THEN 2 WHEN 'extern' THEN 3 ELSE 4 END AS line_seq,
    CASE WHEN kind = 'batch' THEN 'batch' ELSE event_type || '_' || props || '_' || repeat('x', CAST(id % 40 AS INTEGER)) END AS jname,
    CASE WHEN kind IN ('main', 'stale') AND id % 89 <> 7 THEN user_name ELSE '' END AS uname,
    CASE WHEN kind = 'batch' THEN '' ELSE part END AS pname
  FROM lines
),
occ AS (
  SELECT 'job' AS kind, jname AS value, line_seq * 1024 + 2 * 16 AS pos_key FROM pl
  UNION ALL SELECT 'user', uname, line_seq * 1024 + 3 * 16 FROM pl WHERE uname <> ''
  UNION ALL SELECT 'user', 'hpc', line_seq * 1024 + 5 * 16 FROM pl
  UNION ALL SELECT 'user', 'research', line_seq * 1024 + 7 * 16 FROM pl
  UNION ALL SELECT 'node', printf('node-%03d', k), line_seq * 1024 + 25 * 16 + (k - n0) FROM (SELECT *, unnest(range(n0, n0 + nspan + 1)) AS k FROM pl WHERE id % 10 <> 1)
  UNION ALL SELECT 'cluster', 'alpha', line_seq * 1024 + 44 * 16 FROM pl
  UNION ALL SELECT 'partition', pname, line_seq * 1024 + 8 * 16 FROM pl WHERE pname <> ''
),
firsts AS (SELECT kind, value, min(pos_key) AS first_at FROM occ GROUP BY kind, value),
ranked AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY first_at) - 1 AS idx FROM firsts),
amap AS (
  SELECT kind, value, CASE
    WHEN kind = 'user' AND idx < 26 THEN ['alice','bob','charlie','diana','eve','frank','grace','henry','iris','jack','kate','liam','maya',
      'noah','olivia','peter','quinn','rachel','sam','tina','uma','victor','wendy','xavier','yara','zoe'][idx + 1]
    WHEN kind = 'user' THEN printf('user%03d', idx) WHEN kind = 'job' THEN printf('job_%04d', idx)
    WHEN kind = 'node' THEN printf('node-%03d', idx) WHEN kind = 'cluster' THEN printf('cluster-%02d', idx)
    ELSE printf('partition-%02d', idx) END AS alias
  FROM ranked
),
nodes_out AS (
  SELECT line_seq, string_agg(a.alias, ',' ORDER BY k) AS nl FROM (SELECT line_seq, unnest(range(n0, n0 + nspan + 1)) AS k FROM pl WHERE id % 10 <> 1) x
  JOIN amap a ON a.kind = 'node' AND a.value = printf('node-%03d', x.k) GROUP BY line_seq
)"""
SQL["pseudonymize"] = ql(f"""
, {PSEUDO.strip()}
SELECT p."JobID", j.alias AS "JobName", coalesce(u.alias, p.uname) AS "User", g.alias AS "Group", r.alias AS "Account",
  coalesce(pa.alias, p.pname) AS "Partition", c.alias AS "Cluster", coalesce(n.nl, p.node_txt) AS "NodeList",
  '/work/project' AS "WorkDir", 'sbatch script.sh' AS "SubmitLine"
FROM pl p
JOIN amap j ON j.kind = 'job' AND j.value = p.jname
LEFT JOIN amap u ON u.kind = 'user' AND u.value = p.uname
JOIN amap g ON g.kind = 'user' AND g.value = 'hpc'
JOIN amap r ON r.kind = 'user' AND r.value = 'research'
LEFT JOIN amap pa ON pa.kind = 'partition' AND pa.value = p.pname
JOIN amap c ON c.kind = 'cluster' AND c.value = 'alpha'
LEFT JOIN nodes_out n ON n.line_seq = p.line_seq
""").replace(")\n\n, pl AS", "),\npl AS")
# two dumps in turn: the aliases of both at once
SQL["pseudonymize_next"] = with_ctes(*RUNS, LINES_T.format(lines="lines1", base="base1"), LINES_T.format(lines="lines2", base="base2"), """
both_runs AS (SELECT *, 0 AS run FROM lines1 UNION ALL SELECT *, 1 AS run FROM lines2)""",
    PSEUDO.replace("FROM lines\n", "FROM both_runs\n").replace("SELECT *, id * 10 +", "SELECT *, run * 100000000000 + id * 10 +")) + SQL["pseudonymize"].split(PSEUDO.strip(), 1)[1] + "WHERE p.run = 1\n"
ALIAS = PSEUDO.split("firsts AS", 1)[1].split("nodes_out AS", 1)[0].rstrip().rstrip(",")
SQL["pseudonymize_texts"] = with_ctes(BASE, QUEUE, """
n AS (SELECT DISTINCT n0 AS n FROM base),
inv AS (
  SELECT 1 AS text, n * 10 AS seq, printf('node-%03d', n) AS nm, ',1' AS rest FROM n WHERE n % 10 = 3
  UNION ALL SELECT 1, n * 10 + 1, printf('node-%03d', n), ',' || CAST(32 * (1 + n % 4) AS VARCHAR) FROM n
  UNION ALL SELECT 1, n * 10 + 2, printf('node-%03d', n), ',unknown' FROM n WHERE n % 10 = 7
  UNION ALL SELECT 2, n * 10, printf('node-%03d', n), ',gpu:a100:2,gpu:v100:2' FROM n WHERE n % 20 = 0
  UNION ALL SELECT 2, n * 10 + 1, printf('node-%03d', n), ',' || CASE n % 9 WHEN 0 THEN 'gpu:4' WHEN 3 THEN 'gpu:v100:4(S:0-1)' WHEN 6 THEN 'gpu:a100:4(S:0)' ELSE '(null)' END FROM n
  UNION ALL SELECT 2, n * 10 + 2, printf('gpunode-%03d', n), ',gpu:2' FROM n WHERE n % 30 = 0
),
bad AS (SELECT id * 10 + 1 AS seq, user_name AS nm FROM base WHERE state IN ('RUNNING', 'PENDING') AND id % 500 = 3),
occ AS (
  SELECT 'user' AS kind, "user" AS value, line_no * 8 AS pos_key FROM q
  UNION ALL SELECT 'user', nm, seq * 8 FROM bad
  UNION ALL SELECT 'partition', "partition", line_no * 8 + 3 FROM q
  UNION ALL SELECT 'node', node, line_no * 8 + 5 FROM q WHERE node <> '(null)'
  UNION ALL SELECT 'node', nm, text * 1000000000000 + seq * 8 FROM inv
  UNION ALL SELECT 'node', printf('node-%03d', n), 3 * 1000000000000 + n * 80 FROM n
),
firsts AS""" + ALIAS + """,
al AS (SELECT kind, value, alias FROM amap)""") + """
SELECT 0 AS text, CAST(-1 AS BIGINT) AS seq, '{header}' AS value
UNION ALL SELECT 0, CAST(line_no AS BIGINT), u.alias || '/' || status || '/' || nnodes || '/' || p.alias || '/' || cores || '/' || coalesce(d.alias, node) || '/' || oversubscribe
  FROM q JOIN al u ON u.kind = 'user' AND u.value = q."user" JOIN al p ON p.kind = 'partition' AND p.value = q."partition" LEFT JOIN al d ON d.kind = 'node' AND d.value = q.node
UNION ALL SELECT 0, CAST(seq AS BIGINT), alias || '/R/x' FROM bad JOIN al ON kind = 'user' AND value = nm
UNION ALL SELECT text, CAST(seq AS BIGINT), alias || rest FROM inv JOIN al ON kind = 'node' AND value = nm
UNION ALL SELECT 3, CAST(n * 10 AS BIGINT), 'NodeName=' || alias || ' Arch=x86_64 CoresPerSocket=16' FROM n JOIN al ON kind = 'node' AND value = printf('node-%03d', n)
UNION ALL SELECT 3, CAST(n * 10 + 1 AS BIGINT), '   CPUAlloc=0 CPUEfctv=8 CPUTot=' || CAST(32 * (1 + n % 4) AS VARCHAR) || ' CPULoad=0.01' FROM n
UNION ALL SELECT 3, CAST(n * 10 + 2 AS BIGINT), '   RealMemory=515000 AllocMem=0 FreeMem=1000' FROM n
""".replace("{header}", FX.QUEUE_HEADER)
SQL["stream_split_files"] = qr(f"SELECT job_id, state, {T1} AS processed_date, total_cpu_seconds, max_rss_mb, job_date FROM metrics1")
_EVEN = "CAST(substr(job_date, 9, 2) AS INT) % 2 = 0"
SQL["collect_rebuild"] = qr(f"""
SELECT job_id, state, processed_date, total_cpu_seconds, job_date FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY processed_date DESC, job_date DESC) AS rn FROM (
    SELECT job_id, state, {T1} AS processed_date, total_cpu_seconds, job_date FROM metrics1 WHERE {_EVEN}
    UNION ALL SELECT job_id, state, {T2}, total_cpu_seconds, job_date FROM metrics2 WHERE {REPROCESSED} AND ({_EVEN} OR job_date NOT IN (SELECT job_date FROM metrics1))
    UNION ALL SELECT job_id, state, {T2}, total_cpu_seconds, job_date FROM metrics1 WHERE NOT {_EVEN}))
WHERE rn = 1
""")
SQL["stream_collect"] = qr(f"SELECT job_id, state, {T1} AS processed_date, job_date FROM metrics1")


def _on_run2(key: str, nodes: bool = False) -> str:
    body = SQL[key].split(with_ctes(BASE, JOBS, NODE_ROWS) if nodes else with_ctes(BASE, JOBS), 1)[1]
    body = body.replace("FROM metrics ", "FROM metrics2 ").replace("FROM metrics\n", "FROM metrics2\n").replace("FROM metrics)", "FROM metrics2)")
    if nodes:
        return with_ctes(*RUNS, NODE_ROWS.replace("FROM metrics", "FROM metrics2")) + body
    return qr(body)


for _k in ("group_stats", "daily_usage", "efficiency_summary", "top_wasters", "cluster_summary", "state_distribution"):
    SQL[f"analyze_{_k}"] = _on_run2(_k)
for _k in ("node_stats", "gpu_utilization"):
    SQL[f"analyze_{_k}"] = _on_run2(_k, nodes=True)

for _k in ("user_stats", "group_stats", "daily_usage", "top_wasters", "cluster_summary", "state_distribution"):
    SQL[f"analyze_daily_{_k}"] = SQL[f"analyze_{_k}"]

SQL["store_stats"] = with_ctes(BASE, JOBS, LINES_T.format(lines="lines", base="base"), """
parts AS (
  SELECT 'processed/job_date=' || job_date AS part, CAST(count(*) AS BIGINT) AS n FROM metrics GROUP BY 1
  UNION ALL SELECT 'raw/job_date=' || own_date, CAST(count(*) AS BIGINT) FROM lines GROUP BY 1
)""") + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM parts) AS data_files, (SELECT max(part) FROM parts) AS latest_file,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT n FROM parts ORDER BY part DESC LIMIT 5)) AS recent_records
"""


def _chart_sql(source: str, label: str, value: str, n: int, ctes) -> str:
    """Numbers of a bar chart over (l, v)."""
    body = f"""
, us AS (SELECT {label} AS l, {value} AS v FROM {source}),
pos AS (SELECT * FROM us WHERE v > 0),
tot AS (SELECT sum(v) AS t, max(v) AS mx FROM pos)
SELECT left(l, 15) AS label, round(v, 6) AS "value", round(v / t * 100, 6) AS share_pct,
  CAST(CASE WHEN mx > 0 THEN floor(v / mx * 50) ELSE 0 END AS BIGINT) AS bar_length,
  CASE WHEN v > mx * 0.66 THEN 'red' WHEN v > mx * 0.33 THEN 'yellow' ELSE 'green' END AS band
FROM pos, tot ORDER BY v DESC, l LIMIT {n}
"""
    return ctes(body).replace("\n\n, us AS", ", us AS")


_BY_USER, _BY_GROUP = 'metrics GROUP BY "user"', 'metrics GROUP BY "group"'
_LAST_DAYS = """(SELECT strftime(coalesce(start_time, submit_time), '%Y-%m-%d') AS d, sum(cpu_s) / 3600.0 AS c, sum(gpu_s) / 3600.0 AS g
  FROM metrics GROUP BY 1 ORDER BY 1 DESC LIMIT 14)"""
_GPU_UTIL = """(SELECT s.node, s.total_gpu_hours / (i.gpus * p.period_days * 24) * 100 AS u FROM node_stats s JOIN inventory i ON s.node = i.node, period p
  WHERE s.total_gpu_hours > 0 AND i.gpus > 0)"""
_DONE = "avg(CASE WHEN state = 'COMPLETED' THEN {} END)"
for _k, _args in {
    "node_cpu_share": ("node_stats", "node", "cpu_utilization_pct", 20, qn),
    "node_gpu_share": (_GPU_UTIL, "node", "u", 10, qn),
    "user_cpu_share": (_BY_USER, '"user"', "sum(cpu_s) / 3600.0", 20, q),
    "user_gpu_share": (_BY_USER, '"user"', "sum(gpu_s) / 3600.0", 10, q),
    "user_cpu_efficiency": (_BY_USER, '"user"', _DONE.format("cpu_efficiency"), 20, q),
    "user_mem_efficiency": (_BY_USER, '"user"', _DONE.format("memory_efficiency"), 20, q),
    "group_cpu_share": (_BY_GROUP, '"group"', "sum(cpu_s) / 3600.0", 15, q),
    "group_gpu_share": (_BY_GROUP, '"group"', "sum(gpu_s) / 3600.0", 10, q),
    "daily_cpu_share": (_LAST_DAYS, "d", "c", 14, q),
    "daily_gpu_share": (_LAST_DAYS, "d", "g", 14, q),
}.items():
    SQL[f"chart_{_k}"] = _chart_sql(*_args)
SQL["show_group_stats"] = q("""SELECT count(DISTINCT "group") > 1 OR bool_or("group" <> 'ungrouped') AS "show" FROM metrics""")
_CELLS = ", ".join(
    f"coalesce(max(cores_cell) FILTER (WHERE \"partition\" = '{p}'), '-') AS \"{p}\"" for p in ("batch", "debug", "gpu", "interactive", "long", "Total")
)
SQL["queue_grid_wide"] = f'SELECT "user", {_CELLS} FROM ({SQL["queue_grid"]}) GROUP BY "user"'

SQL["file_stats"] = with_ctes(BASE, JOBS, LINES_T.format(lines="lines", base="base")) + """
SELECT 'processed' AS kind, job_date, CAST(count(*) AS BIGINT) AS n_rows, true AS sized FROM metrics GROUP BY job_date
UNION ALL SELECT 'raw', own_date, CAST(count(*) AS BIGINT), true FROM lines GROUP BY own_date
"""
SQL["unreadable_files"] = with_ctes(BASE, JOBS, LINES_T.format(lines="lines", base="base")) + """
SELECT min(own_date) AS job_date, 'text.parquet' AS file, CAST(18 AS BIGINT) AS bytes, 'not a Parquet file' AS reason, true AS rest_loaded FROM lines
UNION ALL SELECT max(own_date), 'broken.parquet', CAST(15 AS BIGINT), 'truncated', true FROM lines
"""
SQL["efficiency_summary_approx"] = q("""
SELECT CAST(count(*) AS BIGINT) AS completed_jobs,
  round(avg(cpu_efficiency), 6) AS cpu_mean, round(min(cpu_efficiency), 6) AS cpu_min, round(max(cpu_efficiency), 6) AS cpu_max,
  round(avg(memory_efficiency), 6) AS mem_mean, round(min(memory_efficiency), 6) AS mem_min, round(max(memory_efficiency), 6) AS mem_max,
  true AS cpu_median_close, true AS mem_median_close
FROM metrics WHERE state = 'COMPLETED' HAVING count(*) > 0
""")
SQL["collect_summary"] = SQL["analyze_daily_usage"]
