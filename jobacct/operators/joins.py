"""Skew-safe lookup join.

A lookup (fact -> mapping on a key) where a few key values may hold a large
share of the fact rows (the same group, cluster or job name on most lines).
A shuffle join would send all rows of such a value to one task. Here the
keys holding at least 1/``max_hot`` of the rows are found with a partial
aggregation; there can be at most ``max_hot`` of them, so their slice of the
mapping is broadcast with a proven size bound and joined without a shuffle.
The remaining rows go through an ordinary (shuffle or AQE-chosen) join, in
which no key holds more than 1/``max_hot`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobacct.operators.reports import scalar


def hot_keys(fact: DataFrame, keys: list[str], max_hot: int = 1000) -> DataFrame:
    """Key values holding >= 1/max_hot of the rows (at most ``max_hot`` rows)."""
    counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = scalar(counts.agg(F.sum("_n").alias("_total")))
    return counts.where(F.col("_n") * max_hot >= total).select(*keys)


def lookup_join(fact: DataFrame, mapping: DataFrame, keys: list[str], how: str = "left", max_hot: int = 1000) -> DataFrame:
    """``fact`` joined to ``mapping`` (at most one row per key) on ``keys``."""
    hot = F.broadcast(hot_keys(fact, keys, max_hot).withColumn("_hot", F.lit(True)))
    flagged = fact.join(hot, keys, "left")
    hot_rows = flagged.where(F.col("_hot").isNotNull()).drop("_hot")
    cold_rows = flagged.where(F.col("_hot").isNull()).drop("_hot")
    hot_map = mapping.join(hot.drop("_hot"), keys, "left_semi")
    return hot_rows.join(F.broadcast(hot_map), keys, how).unionByName(cold_rows.join(mapping, keys, how))
