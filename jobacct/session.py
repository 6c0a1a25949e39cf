"""Session helpers: time zone, scratch space on the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def use_utc(spark: SparkSession) -> None:
    """Timestamps are instants and naive dump times are UTC: pin the session
    zone (a runtime conf) before building any plan."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``
    (or already registered on the context).

    Only when a local session has none (tests) is a private folder created
    and registered as the context's checkpoint dir; on a cluster a folder of
    one machine would lose what other executors write, so that is an error."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return str(root)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return str(current)
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobacct-ckpt-"))
    return str(sc.getCheckpointDir())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/jobacct/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (local,
    HDFS or object store alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench: UTC, AQE on, UI off."""
    b = (
        SparkSession.builder.master(master)
        .appName("jobacct")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("JOBACCT_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
