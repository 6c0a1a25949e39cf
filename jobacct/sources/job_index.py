"""Where a job is stored.

``<root>/jobs/job_block=B/`` holds (job_id, job_date) of every stored job, in blocks
of ``BLOCK`` job numbers. Schedulers number jobs in sequence, so the jobs of a
collection lie in the few blocks of the newest numbers and those of jobs that
waited: looking up their dates opens these blocks and nothing else, and the store
is then read on these dates alone. Ids that do not start with a number fall in
one of ``OTHER`` blocks below zero by their hash.

The index is part of each published run (see ``journal``). A store without one
(written before there was an index, or by a plain ``write_silver``) gets it by
one pass over the id column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.schemas import DATE_COLUMN
from jobacct.session import path_exists

JOBS, BLOCK_COLUMN = "jobs", "job_block"
BLOCK, OTHER = 100_000, 1000
SCHEMA = T.StructType([T.StructField("job_id", T.StringType()), T.StructField(DATE_COLUMN, T.StringType()), T.StructField(BLOCK_COLUMN, T.LongType())])


def block_of(job_id: Column) -> Column:
    number = F.regexp_extract(job_id, r"^(\d{1,18})", 1).try_cast("bigint")
    return F.coalesce(F.floor(number / BLOCK), -1 - F.pmod(F.xxhash64(job_id), F.lit(OTHER)))


def entries(silver: DataFrame) -> DataFrame:
    """Index rows of stored jobs."""
    return silver.select("job_id", DATE_COLUMN, block_of(F.col("job_id")).alias(BLOCK_COLUMN)).distinct()


def _blocks(ids: DataFrame) -> list[int]:
    """Blocks of job ids: one number for each ``BLOCK`` job numbers."""
    return sorted(r[0] for r in ids.select(block_of(F.col("job_id"))).distinct().collect())


def _read(spark: SparkSession, root: str, blocks: list[int]) -> DataFrame:
    path = f"{root.rstrip('/')}/{JOBS}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path).where(F.col(BLOCK_COLUMN).isin(blocks))


def ensure(spark: SparkSession, root: str, silver: DataFrame) -> None:
    """Build the index of a store that has none."""
    path = f"{root.rstrip('/')}/{JOBS}"
    if not path_exists(spark, path):
        entries(silver).hint("rebalance", BLOCK_COLUMN).write.partitionBy(BLOCK_COLUMN).mode("overwrite").parquet(path)


def lookup(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(job_id, job_date) of the jobs of ``ids`` that are stored."""
    ids = ids.select("job_id").distinct()
    return _read(spark, root, _blocks(ids)).join(ids, "job_id", "left_semi").select("job_id", DATE_COLUMN)


def merged(spark: SparkSession, root: str, new: DataFrame) -> DataFrame:
    """The touched blocks after the jobs of ``new`` (job_id, job_date) were stored."""
    old = _read(spark, root, _blocks(new)).join(new.select("job_id").distinct(), "job_id", "left_anti")
    return old.select(*SCHEMA.names).unionByName(entries(new).select(*SCHEMA.names))
