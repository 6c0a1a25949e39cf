"""C1 on hand-made dump lines: array jobs, batch merge and fallbacks,
ignored steps, last-wins duplicates, orphan batch lines."""

from pyspark.sql import functions as F

from jobacct.operators.normalize import normalize_jobs
from jobacct.schemas import ACCOUNTING_FIELDS
from jobacct.sources.accounting import parse_accounting_lines


def line(**kv):
    base = {f: "" for f in ACCOUNTING_FIELDS}
    base.update({"User": "alice", "UID": "1000", "Partition": "cpu", "State": "COMPLETED",
                 "Submit": "2025-08-20T09:00:00", "Start": "2025-08-20T10:00:00", "End": "2025-08-20T11:00:00",
                 "ElapsedRaw": "3600", "AllocCPUS": "4", "ReqMem": "4096M", "NodeList": "n[1-2]"})
    base.update(kv)
    return "|".join(base[f] for f in ACCOUNTING_FIELDS)


def test_normalize_edge_cases(spark):
    lines = [
        line(JobID="77_1", TotalCPU="00:10:00", MaxRSS="1G"),               # array task, main values as fallback
        line(JobID="77_1.batch", TotalCPU="02:00:00", MaxRSS=""),          # batch wins for CPU, empty RSS falls back
        line(JobID="77_2", State="CANCELLED by 1000", ElapsedRaw="0"),     # array task without batch
        line(JobID="77_1.extern", TotalCPU="99:00:00", MaxRSS="99G"),      # other steps ignored
        line(JobID="88", State="PENDING", ElapsedRaw="1", AllocCPUS="1"),  # stale copy ...
        line(JobID="88", State="RUNNING", End="Unknown"),                  # ... the later line wins
        line(JobID="99.batch", TotalCPU="01:00:00"),                       # batch line without a main line
        line(JobID="55", User="", UID=""),                                 # no user at all
        "too|few|fields",
    ]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq long")
    rows = {r.job_id: r for r in normalize_jobs(parse_accounting_lines(df), processed_at="2025-08-21 00:00:00").collect()}
    assert set(rows) == {"77_1", "77_2", "88", "55"}
    a = rows["77_1"]
    assert a.total_cpu_seconds == 7200.0 and a.max_rss_mb == 1024.0
    assert a.cpu_efficiency == 50.0 and a.memory_efficiency == 25.0
    assert a.cpu_hours_reserved == 4.0 and a.memory_gb_hours_reserved == 4.0
    assert rows["77_2"].state == "CANCELLED" and rows["77_2"].cpu_efficiency == 0.0
    r88 = rows["88"]
    assert (r88.state, r88.alloc_cpus, r88.elapsed_seconds, r88.end_time, r88.is_complete) == ("RUNNING", 4, 3600, None, False)
    assert rows["55"].user == "MISSING_USER"
    assert {r.job_date for r in rows.values()} == {"2025-08-20"}
