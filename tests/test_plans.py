"""User-facing plans over text files, streaming vs batch, alias consistency."""

import os
import tempfile

from pyspark.sql import functions as F

from jobacct.plans import queries as Q


def _write(lines):
    d = tempfile.mkdtemp(prefix="jobacct-test-")
    p = os.path.join(d, "dump.txt")
    with open(p, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return p


def test_current_and_nodes_from_text(spark):
    from jobacct.plans.current import current, nodes

    q = _write(["USER/ST/NODES/PARTITION/CPUS/NODELIST/OVERSUBSCRIBE", "alice/R/1/cpu/4/n1/OK", "alice/R/1/cpu/8/n2/NO",
                "alice/PD/1/cpu/2/n2/NO", "bob/R/2/gpu/16/n3/YES", "garbage"])
    cores = spark.createDataFrame([("n2", 64)], "node string, cores long")
    r = current(spark, q, cores)
    u = {(x.user, x.partition, x.status): (x.cores, x.nodes) for x in r["usage"].collect()}
    # the second exclusive row of alice on n2 is skipped; exclusive rows count the node's cores in both modes
    assert u == {("alice", "cpu", "R"): (68, 65), ("bob", "gpu", "R"): (16, 2)}
    grid = {x.user: x for x in r["cores_grid"].collect()}
    assert grid["alice"].gpu == "-" and grid["bob"].cpu == "-" and grid["2 users"].Total == r["grid"].where("user = '2 users' and partition = 'Total'").first().cores_cell
    cpu = _write(["n1,32", "n2,64", "n1,48"])
    gpu = _write(["n2,gpu:4", "g9,gpu:a100:2(S:0)"])
    n = nodes(spark, cpu, gpu)
    assert [tuple(x) for x in n["inventory"].collect()] == [("g9", 64, 2), ("n1", 48, 0), ("n2", 64, 4)]


def test_stream_equals_batch(spark, sf_small):
    s = {tuple(r) for r in Q.QUERIES["stream_collect"](spark, sf_small).collect()}
    b = Q.silver(spark, sf_small, run=1)
    b = {(r.job_id, r.state, "2024-02-01 06:00:00", r.job_date) for r in b.collect()}
    assert s == b


def test_aliases_consistent_across_columns(spark, sf_small):
    from jobacct.operators.privacy import pseudonymize

    out, amap = pseudonymize(spark, Q.bronze(spark, sf_small))
    users = {r.value: r.alias for r in amap.where("kind = 'user'").collect()}
    assert users["hpc"] == "bob" and users["research"] == "charlie"  # first appearances on the first line
    row = out.where(F.col("Group") != "").select("Group", "Account").first()
    assert (row.Group, row.Account) == ("bob", "charlie")
    # each original maps to exactly one alias and back
    assert len(set(users.values())) == len(users)


def test_empty_inputs(spark):
    """Empty data gives empty results, not errors."""
    from jobacct.plans.analyze import analyze
    from jobacct.plans.collect import collect, reprocess_missing
    from jobacct.schemas import BRONZE
    from jobacct.sources import store as ST

    root = Q._store(spark)
    reports = analyze(spark, root, "2024-01-10", 7, persist=False)
    assert reports["user_stats"].count() == 0 and reports["efficiency_summary"].count() == 0
    assert reports["cluster_summary"].collect()[0].total_jobs == 0
    empty = spark.createDataFrame([], BRONZE).withColumn(
        "seq", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pos"))
    )
    m = collect(spark, empty, root, "2024-01-10", 2, "2024-01-11 00:00:00").collect()[0]
    assert (m.raw_records, m.processed_jobs, m.completed_dates) == (0, 0, 0)
    assert reprocess_missing(spark, root).count() == 0
    assert ST.load_recent(spark, root, "2024-01-10", 7).count() == 0


def test_grid_wide_pivot(spark):
    from jobacct.operators.queue import grid_wide, queue_grid, queue_usage

    q = spark.createDataFrame(
        [(1, "bob", "R", 1, "cpu", 4, "n1", "OK"), (2, "alice", "PD", 1, "gpu", 8, "n2", "YES"), (3, "alice", "R", 2, "gpu", 16, "n3", "YES"),
         (4, "bob", "PD", 1, "cpu", 2, "n1", "OK")],
        "line_no long, user string, status string, nnodes long, partition string, cores long, node string, oversubscribe string",
    )
    cores = spark.createDataFrame([], "node string, cores long")
    wide = {r.user: r for r in grid_wide(queue_grid(queue_usage(q, cores)), ["gpu", "cpu"]).collect()}
    assert wide["alice"].cpu == "-" and wide["alice"].gpu == "PD=8 / R=16" and wide["alice"].Total == "PD=8 / R=16"
    assert wide["bob"].cpu == "R=4 / PD=2" and wide["bob"].gpu == "-"
    assert wide["2 users"].Total == "R=20 / PD=10" and wide["2 users"].cpu == "R=4 / PD=2"
