"""Research-group mapping -> one (user, group) row per user.

The configuration maps group -> users; a user listed under several groups
belongs to the LAST of them. Duplicates are resolved here, before any join,
so the join with jobs cannot multiply rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def groups_from_pairs(pairs: DataFrame) -> DataFrame:
    """``(group_order, group, user)`` rows -> ``(user, group)``, last group wins."""
    return pairs.groupBy("user").agg(F.max_by("group", "group_order").alias("group"))


def groups_table(spark: SparkSession, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """From a configuration mapping (its order is the group order)."""
    rows = [(i, g, u) for i, (g, users) in enumerate(mapping.items()) for u in users]
    pairs = spark.createDataFrame(rows, "group_order bigint, group string, user string")
    return groups_from_pairs(pairs)
