"""Several table changes published in one step.

A run writes whole partitions of every table it changes under
``<root>/journal/<run>/<table>/<partition>`` (read by nobody), then a manifest
that names them, by one rename. From then on the run counts as done: ``publish``
moves each partition to its place (of an added one its files, beside those that
are there), removes dropped ones and deletes the folder.
Each of these steps may be repeated, so a run that was killed after its manifest
is finished by the next one (``recover``), and one killed before it is rolled
back by deleting its folder: the tables never held any of it. The merged rows are
written once; publishing moves folders.

One run at a time writes to a store (as the collection plans do). Per run the
driver handles one name for each partition that changed: dates and blocks of job
numbers, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER, MANIFEST = "journal", "manifest.json"
# Parquet files of the store and of staged tables
COMPRESSION = "zstd"


class Files:
    """The Hadoop file system of a store: local, HDFS or object store alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return bool(self.fs.exists(self.path(p)))

    def names(self, p: str) -> list[str]:
        if not self.exists(p):
            return []
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self.path(p)))

    def move(self, source: str, target: str) -> None:
        """Put ``source`` in the place of ``target``; nothing to do where that was done before."""
        if not self.exists(source):
            return
        self.delete(target)
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def write(self, p: str, text: str) -> None:
        """The whole file or none: written beside its place, then renamed."""
        part = f"{p}.part"
        out = self.fs.create(self.path(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(self.path(part), self.path(p)):
            raise OSError(f"cannot write {p}")

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Run:
    """The changes of one run. ``write`` the new partitions of each table,
    ``drop`` partitions, then ``publish``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/{FOLDER}/{uuid.uuid4().hex}"
        self.files = Files(spark, self.root)
        self.dropped: list[str] = []
        self.added: list[str] = []

    def write(self, df: DataFrame, table: str, partition: str, dealt: bool = False) -> DataFrame:
        """Write ``df`` as the new content of the partitions it holds rows of
        (REBALANCE: a large partition is split over several tasks, small ones
        are merged; ``dealt``: ``df`` is that already), beside what the run wrote
        there before; gives what was written."""
        path = f"{self.path}/{table}"
        df = df if dealt else df.hint("rebalance", partition)
        df.write.mode("append").option("compression", COMPRESSION).partitionBy(partition).parquet(path)
        return self.spark.read.schema(df.schema).option("basePath", path).parquet(path)

    def add(self, table: str, partition: str, values: list[str]) -> None:
        """What is written to these partitions comes to the rows they hold instead of replacing them."""
        self.added += [f"{table}/{partition}={v}" for v in values]

    def partitions(self, table: str) -> list[str]:
        """Values of the partitions written for ``table``."""
        return [n.partition("=")[2] for n in self.files.names(f"{self.path}/{table}") if "=" in n]

    def drop(self, table: str, partition: str, values: list[str]) -> None:
        self.dropped += [f"{table}/{partition}={v}" for v in values]

    def dropped_of(self, table: str) -> list[str]:
        """Values of the partitions dropped from ``table``."""
        return [x.partition("=")[2] for x in self.dropped if x.startswith(f"{table}/")]

    def publish(self) -> None:
        tables = self.files.names(self.path)
        moved = [f"{t}/{n}" for t in tables for n in self.files.names(f"{self.path}/{t}") if "=" in n]
        beside = set(self.added)
        moved = [f for n in moved for f in ([f"{n}/{x}" for x in self.files.names(f"{self.path}/{n}")] if n in beside else [n])]
        self.files.write(f"{self.path}/{MANIFEST}", json.dumps({"move": moved, "drop": self.dropped}))
        finish(self.files, self.root, self.path)


def finish(files: Files, root: str, run: str) -> None:
    """Carry out the manifest of a run, as far as it was not."""
    todo = json.loads(files.read(f"{run}/{MANIFEST}"))
    for name in todo["move"]:
        files.move(f"{run}/{name}", f"{root}/{name}")
    for name in todo["drop"]:
        files.delete(f"{root}/{name}")
    files.delete(run)


def recover(spark: SparkSession, root: str) -> dict[str, int]:
    """Finish runs that have their manifest, roll back those that have not."""
    root = root.rstrip("/")
    files, done = Files(spark, root), {"finished": 0, "rolled_back": 0}
    for name in files.names(f"{root}/{FOLDER}"):
        run = f"{root}/{FOLDER}/{name}"
        if files.exists(f"{run}/{MANIFEST}"):
            finish(files, root, run)
            done["finished"] += 1
        else:
            files.delete(run)
            done["rolled_back"] += 1
    return done
