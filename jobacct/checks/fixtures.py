"""Accounting inputs derived from the ``events`` test table.

Every event becomes one batch job; its integer attributes are rendered into
the text formats a scheduler prints (accounting dump, queue snapshot, node
inventories, node descriptions), and the engine parses that text back. The
oracle (``jobacct.checks.oracle``) computes the same answers straight from the
integers, so a match checks the text parsers as well as the operators.

All of it is lazy Spark work over ``events``; it grows with the table.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.schemas import ACCOUNTING_FIELDS
from jobacct.session import checkpoint_root, path_exists

# bump when the rendering below changes (materialised dumps are keyed by it)
FIXTURE_VERSION = 3
# events per dump file (about 18 MB of text, 1.5 MB compressed): dump files grow in number, not in size
EVENTS_PER_FILE = 20_000
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"

# --- fixed values of the derivation (shared with the oracle SQL) ------------
PARTITION_OF_EVENT_TYPE = {"view": "batch", "click": "interactive", "purchase": "gpu", "signup": "debug"}
OTHER_PARTITION = "long"
STATE_OF_ID_MOD_10 = {0: "RUNNING", 1: "PENDING", 2: "FAILED", 3: "CANCELLED", 4: "TIMEOUT"}
OTHER_STATE = "COMPLETED"
GROUP_OF_USER_MOD_5 = {0: "physics", 1: "chemistry", 2: "biology", 3: "astronomy"}
OVERSUBSCRIBE_OF_ID_MOD_4 = {0: "OK", 1: "NO", 2: "USER", 3: "YES"}
QUEUE_HEADER = "USER/ST/NODES/PARTITION/CPUS/NODELIST/OVERSUBSCRIBE"
N_INVENTORY_NODES = 60
# second collection run: jobs of dates before this one settle
SETTLE_BEFORE = "2024-01-08"
FMT = "yyyy-MM-dd'T'HH:mm:ss"


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, spread over the cluster's cores when its files give
    fewer splits than that (one small file is one split; each event renders
    into several dump lines, so the rendering needs the parallelism). A
    table already read in many splits is used as it is: no shuffle."""
    path = events_path(sf_dir)
    ev = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    # split estimate from the file size (metadata only, no planning)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024)).rstrip("b").rstrip("B") or 134217728)
    if size // max(split, 1) + 1 < cores:
        ev = ev.repartition(cores)
    return ev


def _case(col: Column, mapping: dict, other: str) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(other))


def job_base(ev: DataFrame, *keep: str) -> DataFrame:
    """Integer attributes of the job behind each event (FIXTURES.md §4), and the columns ``keep``."""
    i = F.col("event_id")
    pending = (i % 10) == 1
    elapsed = F.when(pending, F.lit(0)).otherwise((i * 7919) % 86400).cast("bigint")
    cpus = (1 + i % 64).cast("bigint")
    req_mb = (1024 * (1 + i % 128)).cast("bigint")
    start_s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select(
        i.alias("id"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("props"),
        F.format_string("user%03d", F.col("user_id")).alias("user_name"),
        _case(F.col("event_type"), PARTITION_OF_EVENT_TYPE, OTHER_PARTITION).alias("part"),
        _case(i % 10, STATE_OF_ID_MOD_10, OTHER_STATE).alias("state"),
        start_s.alias("start_s"),
        ((i * 37) % 7200).cast("bigint").alias("wait_s"),
        elapsed.alias("elapsed"),
        cpus.alias("cpus"),
        req_mb.alias("req_mb"),
        ((i * 13) % req_mb).cast("bigint").alias("rss_mb"),
        F.floor(elapsed * cpus * (i % 101) / 100).cast("bigint").alias("tcpu"),
        F.when(F.col("event_type") == "purchase", i % 5).otherwise(0).cast("bigint").alias("gpus"),
        (1 + (i * 7) % 60).cast("bigint").alias("n0"),
        (i % 4).cast("bigint").alias("nspan"),
        *keep,
    )


def _ts(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), FMT)


def _clock(sec: Column) -> Column:
    """Seconds -> '[D-]HH:MM:SS'."""
    d = F.floor(sec / 86400)
    hms = F.format_string("%02d:%02d:%02d", F.floor((sec % 86400) / 3600), F.floor((sec % 3600) / 60), sec % 60)
    return F.when(d > 0, F.concat(d.cast("string"), F.lit("-"), hms)).otherwise(hms)


def _node_list(n0: Column, nspan: Column) -> Column:
    one = F.format_string("node-%03d", n0)
    rng = F.format_string("node-[%03d-%03d]", n0, n0 + nspan)
    return F.when(nspan == 0, one).otherwise(rng)


def _req_mem(i: Column, req_mb: Column) -> Column:
    unit = i % 3
    num = (
        F.when(unit == 0, F.concat((req_mb * 1024).cast("string"), F.lit("K")))
        .when(unit == 1, F.concat(req_mb.cast("string"), F.lit("M")))
        .otherwise(F.concat((req_mb / 1024).cast("bigint").cast("string"), F.lit("G")))
    )
    suffix = F.when(i % 5 == 0, F.lit("n")).when(i % 5 == 1, F.lit("c")).otherwise(F.lit(""))
    return F.concat(num, suffix)


def _rss(i: Column, rss_mb: Column) -> Column:
    return F.when(i % 2 == 0, F.concat((rss_mb * 1024).cast("string"), F.lit("K"))).otherwise(
        F.concat(rss_mb.cast("string"), F.lit("M"))
    )


def _run_state(b: DataFrame, run: int) -> DataFrame:
    """State of each job as seen by collection run 1 or 2.

    Run 1 misses the jobs with id % 20 = 7 (they appear in run 2). In run 2,
    running jobs with id % 20 = 0 or an older start date complete and pending
    jobs submitted before ``SETTLE_BEFORE`` are cancelled."""
    if run == 1:
        return b.where(F.col("id") % 20 != 7)
    day = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd")
    st = F.col("state")
    done = (st == "RUNNING") & ((F.col("id") % 20 == 0) | (day(F.col("start_s")) < SETTLE_BEFORE))
    gone = (st == "PENDING") & (day(F.col("start_s") - F.col("wait_s")) < SETTLE_BEFORE)
    return b.withColumn("state", F.when(done, F.lit("COMPLETED")).when(gone, F.lit("CANCELLED")).otherwise(st))


def _line_kinds(i: Column) -> Column:
    """Kinds of the dump lines of job ``i``, in line order: 0 stale main, 1 main,
    2 batch, 3 extern, 4 step 0, 5 to 7 malformed (empty, 60 and 62 fields)."""
    # a job pending in run 0 never starts: a later run may cancel it, but its
    # Start stays 'Unknown' and it has no nodes and no batch step
    started, dirty = ~(i % 10 == 1), i % 500 == 3
    when = (i % 50 == 25, F.lit(True), started, started & (i % 7 == 0), started & (i % 11 == 0), dirty, dirty, dirty)
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(when)]))


def accounting_lines(spark: SparkSession, sf_dir: str, run: int = 0, files: int = 0) -> DataFrame:
    """The accounting dump as text lines ``(value, seq)``.

    run 0: every job as in FIXTURES.md; run 1 / 2: the two collection runs.
    Per job: a main line, a '.batch' line (not for pending jobs), an '.extern'
    line for id % 7 = 0 and a '.0' step for id % 11 = 0 (both must be
    ignored); for id % 50 = 25 a stale earlier copy of the main line (the
    later one must win); for id % 500 = 3 an empty, a 60-field and a 62-field
    line (all must be dropped).

    ``files``: in line order over that many partitions. The events are dealt and
    sorted, and each line is rendered from its event where it is written: no
    text is shuffled or sorted."""
    used = ("event_id", "ts", "user_id", "event_type", "props")
    ev = spark.read.parquet(events_path(sf_dir)).select(*used).repartitionByRange(files, "event_id") if files else events(spark, sf_dir)
    ev = ev.select(*used, F.explode(_line_kinds(F.col("event_id"))).alias("kind"))
    ev = ev.withColumn("seq", F.col("event_id") * 10 + F.col("kind"))
    if files:
        ev = ev.sortWithinPartitions("seq")
    b = job_base(ev, "kind", "seq")
    if run:
        b = _run_state(b, run)
    i, kind = F.col("id"), F.col("kind")
    st = F.col("state")
    pending, running = i % 10 == 1, st == "RUNNING"
    fallback = i % 89 == 7
    user_txt = F.when(fallback, F.lit("")).otherwise(F.col("user_name"))
    uid_txt = F.when(fallback & (i % 2 == 0), F.lit("")).otherwise(F.col("user_id").cast("string"))
    state_txt = F.when(st == "CANCELLED", F.concat(F.lit("CANCELLED by "), F.col("user_id").cast("string"))).otherwise(st)
    submit = _ts(F.col("start_s") - F.col("wait_s"))
    start = F.when(pending, F.lit("Unknown")).otherwise(_ts(F.col("start_s")))
    end = F.when(pending | running, F.lit("Unknown")).otherwise(_ts(F.col("start_s") + F.col("elapsed")))
    nodes_txt = F.when(pending, F.lit("")).otherwise(_node_list(F.col("n0"), F.col("nspan")))
    tres = F.concat(
        F.lit("cpu="), F.col("cpus").cast("string"), F.lit(",mem="), F.col("req_mb").cast("string"),
        F.lit("M,node="), (F.col("nspan") + 1).cast("string"), F.lit(",billing="), F.col("cpus").cast("string"),
        F.when(F.col("gpus") > 0, F.concat(F.lit(",gres/gpu="), F.col("gpus").cast("string"))).otherwise(F.lit("")),
    )
    name = F.concat(F.col("event_type"), F.lit("_"), F.col("props"), F.lit("_"), F.repeat(F.lit("x"), (i % 40).cast("int")))
    tcpu_txt = F.concat(_clock(F.col("tcpu")), F.when(i % 3 == 0, F.lit(".250")).otherwise(F.lit("")))
    s = lambda v: v.cast("string")
    stale, batch, extern, step0 = (kind == k for k in (0, 2, 3, 4))
    step = batch | extern | step0
    # texts that several fields share, once per line
    b = b.withColumns({
        "jid": F.concat(s(i), F.when(batch, F.lit(".batch")).when(extern, F.lit(".extern")).when(step0, F.lit(".0")).otherwise(F.lit(""))),
        "submit": submit, "tres": tres, "cpus_txt": s(F.col("cpus")), "nn": s(F.col("nspan") + 1),
    })
    jid, submit, tres, cpus, nn = (F.col(c) for c in ("jid", "submit", "tres", "cpus_txt", "nn"))
    batch_tres = F.concat(F.lit("cpu="), cpus, F.lit(",mem="), s(F.col("req_mb")), F.lit("M,node=1"))
    vals = {
        "JobID": jid, "JobIDRaw": jid, "JobName": F.when(batch, F.lit("batch")).otherwise(name),
        "User": F.when(step, F.lit("")).otherwise(user_txt), "UID": F.when(batch, F.lit("")).otherwise(uid_txt),
        "Group": F.lit("hpc"), "GID": F.lit("1000"), "Account": F.lit("research"),
        "Partition": F.when(batch, F.lit("")).otherwise(F.col("part")), "QOS": F.lit("normal"),
        "State": F.when(stale, F.lit("PENDING")).otherwise(state_txt), "ExitCode": F.lit("0:0"),
        "Submit": submit, "Eligible": submit, "Start": start, "End": end,
        "Elapsed": _clock(F.col("elapsed")), "ElapsedRaw": F.when(stale, F.lit("0")).otherwise(s(F.col("elapsed"))),
        "CPUTime": _clock(F.col("elapsed") * F.col("cpus")), "CPUTimeRAW": s(F.col("elapsed") * F.col("cpus")),
        "TotalCPU": F.when(batch, tcpu_txt).when(extern, F.lit("00:00:01")).when(step0, F.lit("9-00:00:00")).otherwise(F.lit("")),
        "UserCPU": F.lit(""), "SystemCPU": F.lit(""),
        "AllocCPUS": F.when(stale, F.lit("1")).otherwise(cpus), "AllocNodes": nn, "NodeList": nodes_txt, "ReqCPUS": cpus,
        "ReqMem": F.when(stale, F.lit("1M")).otherwise(_req_mem(i, F.col("req_mb"))), "ReqNodes": nn,
        "Timelimit": F.lit("1-00:00:00"), "TimelimitRaw": F.lit("1440"),
        "MaxRSS": F.when(batch, _rss(i, F.col("rss_mb"))).when(extern, F.lit("0")).when(step0, F.lit("999G")).otherwise(F.lit("")),
        "MaxVMSize": F.lit(""), "MaxDiskRead": F.lit(""), "MaxDiskWrite": F.lit(""),
        "AveRSS": F.lit(""), "AveCPU": F.lit(""), "AveVMSize": F.lit(""), "ConsumedEnergy": F.lit("0"),
        "ConsumedEnergyRaw": F.lit("0"), "Priority": s(1000 + i % 97), "Reservation": F.lit(""),
        "ReservationId": F.lit(""), "WorkDir": F.concat(F.lit("/home/"), F.col("user_name"), F.lit("/run")),
        "Cluster": F.lit("alpha"), "ReqTRES": tres, "AllocTRES": F.when(batch, batch_tres).otherwise(tres), "Comment": F.lit(""),
        "Constraints": F.lit(""), "Container": F.lit(""), "DerivedExitCode": F.lit("0:0"),
        "Flags": F.lit("SchedMain"), "Layout": F.lit(""), "MaxRSSNode": F.lit(""), "MaxVMSizeNode": F.lit(""),
        "MinCPU": F.lit(""), "NCPUS": cpus, "NNodes": nn, "NTasks": F.lit(""),
        "Reason": F.lit("None"), "SubmitLine": F.lit("sbatch run.sh"),
    }
    line = F.concat_ws("|", *[vals[f] for f in ACCOUNTING_FIELDS])
    short = F.concat_ws("|", *[F.lit("x")] * (len(ACCOUNTING_FIELDS) - 1))
    value = F.when(kind == 5, F.lit("")).when(kind == 6, short).otherwise(F.concat(line, F.when(kind == 7, F.lit("|extra")).otherwise(F.lit(""))))
    return b.select(value.alias("value"), "seq")


def queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live-queue snapshot ``(value, line_no)``: a header, then one
    'user/ST/nnodes/partition/cores/node/oversubscribe' line per running (R)
    or pending (PD) job in id order; plus a malformed line for id % 500 = 3."""
    b = job_base(events(spark, sf_dir)).where(F.col("state").isin("RUNNING", "PENDING"))
    i = F.col("id")
    running = F.col("state") == "RUNNING"
    node = F.when(running, _node_list(F.col("n0"), F.col("nspan"))).otherwise(F.lit("(null)"))
    line = F.concat_ws(
        "/", F.col("user_name"), F.when(running, F.lit("R")).otherwise(F.lit("PD")),
        (F.col("nspan") + 1).cast("string"), F.col("part"), F.col("cpus").cast("string"), node,
        _case(i % 4, OVERSUBSCRIBE_OF_ID_MOD_4, "YES"),
    )
    bad = F.concat_ws("/", F.col("user_name"), F.lit("R"), F.lit("x"))
    arr = F.array(
        F.struct(line.alias("value"), (i * 10).alias("line_no")),
        F.when(i % 500 == 3, F.struct(bad.alias("value"), (i * 10 + 1).alias("line_no"))),
    )
    body = b.select(F.explode(arr).alias("l")).where(F.col("l").isNotNull()).select("l.value", "l.line_no")
    header = spark.createDataFrame([(QUEUE_HEADER, -1)], "value string, line_no bigint")
    return header.unionByName(body.select("value", F.col("line_no").cast("bigint")))


def _node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct first-node numbers of all jobs (node-001 .. node-060)."""
    return job_base(events(spark, sf_dir)).select(F.col("n0").alias("n")).distinct()


def _cpus_of(n: Column) -> Column:
    return (32 * (1 + n % 4)).cast("bigint")


def node_cpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'node,cpus' lines ``(value, line_no)``: one per node, an earlier wrong
    line for n % 10 = 3 (last wins) and a non-numeric one for n % 10 = 7."""
    n = F.col("n")
    name = F.format_string("node-%03d", n)
    arr = F.array(
        F.when(n % 10 == 3, F.struct(F.concat(name, F.lit(",1")).alias("value"), (n * 10).alias("line_no"))),
        F.struct(F.concat(name, F.lit(","), _cpus_of(n).cast("string")).alias("value"), (n * 10 + 1).alias("line_no")),
        F.when(n % 10 == 7, F.struct(F.concat(name, F.lit(",unknown")).alias("value"), (n * 10 + 2).alias("line_no"))),
    )
    return _node_ids(spark, sf_dir).select(F.explode(arr).alias("l")).where(F.col("l").isNotNull()).select("l.*")


def node_gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'node,gres' lines: GPUs on every third node in three GRES spellings,
    '(null)' elsewhere; a comma list (3 parts, skipped) before the real line
    for n % 20 = 0; a GPU-only node 'gpunode-NNN' for n % 30 = 0."""
    n = F.col("n")
    name = F.format_string("node-%03d", n)
    gres = (
        F.when(n % 9 == 0, F.lit("gpu:4"))
        .when(n % 9 == 3, F.lit("gpu:v100:4(S:0-1)"))
        .when(n % 9 == 6, F.lit("gpu:a100:4(S:0)"))
        .otherwise(F.lit("(null)"))
    )
    arr = F.array(
        F.when(n % 20 == 0, F.struct(F.concat(name, F.lit(",gpu:a100:2,gpu:v100:2")).alias("value"), (n * 10).alias("line_no"))),
        F.struct(F.concat(name, F.lit(","), gres).alias("value"), (n * 10 + 1).alias("line_no")),
        F.when(n % 30 == 0, F.struct(F.format_string("gpunode-%03d,gpu:2", n).alias("value"), (n * 10 + 2).alias("line_no"))),
    )
    return _node_ids(spark, sf_dir).select(F.explode(arr).alias("l")).where(F.col("l").isNotNull()).select("l.*")


def node_description_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node description text ``(node, line_no, value)``, three lines per node,
    the second one carrying 'CPUTot=<cpus>'."""
    n = F.col("n")
    name = F.format_string("node-%03d", n)
    arr = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("NodeName="), name, F.lit(" Arch=x86_64 CoresPerSocket=16")).alias("value")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("   CPUAlloc=0 CPUEfctv=8 CPUTot="), _cpus_of(n).cast("string"), F.lit(" CPULoad=0.01")).alias("value")),
        F.struct(F.lit(2).alias("k"), F.lit("   RealMemory=515000 AllocMem=0 FreeMem=1000").alias("value")),
    )
    return _node_ids(spark, sf_dir).select(name.alias("node"), F.explode(arr).alias("l")).select(
        "node", F.col("l.k").cast("bigint").alias("line_no"), F.col("l.value").alias("value")
    )


def group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group configuration as ``(group_order, group, user)`` rows: users by
    user_id % 5 (4 is in no group). Users with id % 5 = 1 and id % 3 = 0 are
    also listed under the earlier 'physics' group: the later group wins."""
    u = job_base(events(spark, sf_dir)).select("user_id", "user_name").distinct()
    m = F.col("user_id") % 5
    grp = _case(m, GROUP_OF_USER_MOD_5, "")
    order = m.cast("bigint")
    arr = F.array(
        F.when(m < 4, F.struct(order.alias("group_order"), grp.alias("group"))),
        F.when((m == 1) & (F.col("user_id") % 3 == 0), F.struct(F.lit(0).cast("bigint").alias("group_order"), F.lit("physics").alias("group"))),
    )
    return u.select("user_name", F.explode(arr).alias("g")).where(F.col("g").isNotNull()).select(
        "g.group_order", "g.group", F.col("user_name").alias("user")
    )


def dump_path(spark: SparkSession, sf_dir: str, run: int = 0) -> str:
    """Folder of text files holding the rendered accounting dump.

    Rendered once per (test table, run) into the shared checkpoint folder, in
    line order (file name order then line order is dump order), and read back
    through the text source like any dump. The files are compressed and hold
    ``EVENTS_PER_FILE`` events each: a task sorts and writes as much for a large
    table as for a small one."""
    ev = events_path(sf_dir)
    st = os.stat(ev) if os.path.exists(ev) else None
    ident = f"{FIXTURE_VERSION}|{os.path.abspath(ev)}|{run}|{st.st_size if st else ''}|{st.st_mtime_ns if st else ''}"
    key = hashlib.sha1(ident.encode()).hexdigest()[:16]
    path = f"{checkpoint_root(spark).rstrip('/')}/jobacct/dumps/{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        n = max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(ev).count() // EVENTS_PER_FILE))
        out = accounting_lines(spark, sf_dir, run, files=n).select("value")
        # the 61 fields make one generated method of over 8000 bytes, which HotSpot
        # never compiles: with this limit Spark makes small methods of them instead
        limit = spark.conf.get(HUGE_METHOD, None)
        spark.conf.set(HUGE_METHOD, "8000")
        try:
            out.write.mode("overwrite").option("compression", "gzip").text(path)
        finally:
            spark.conf.set(HUGE_METHOD, limit) if limit else spark.conf.unset(HUGE_METHOD)
    return path
