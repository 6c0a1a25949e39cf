"""Skew-safe lookup, bar-chart numbers and raw-store upsert."""

from pyspark.sql import functions as F

from jobacct.operators.joins import hot_keys, lookup_join
from jobacct.operators.reports import top_share


def test_lookup_join_hot_key(spark):
    fact = spark.range(1000).select(F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), "id")
    mapping = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "key string, v long"))
    assert [r.key for r in hot_keys(fact, ["key"], 100).collect()] == ["hot"]
    got = sorted(lookup_join(fact, mapping, ["key"]).select("id", "v").collect())
    want = sorted(fact.join(mapping, "key", "left").select("id", "v").collect())
    assert got == want and len(got) == 1000


def test_top_share(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 0.0), ("d", -1.0), ("e", 1.0), ("a-very-long-user-name", 2.0)], "u string, v double")
    rows = top_share(df, "u", "v", n=3, width=50).collect()
    assert [r.label for r in rows] == ["a", "b", "a-very-long-use"]
    assert abs(rows[0].share_pct - 10 / 18 * 100) < 1e-9  # share of ALL positive values
    assert [r.bar_length for r in rows] == [50, 25, 10]
    assert [r.band for r in rows] == ["red", "yellow", "green"]


def test_raw_upsert_replaces_refetched_lines(spark, sf_small):
    from jobacct.plans import queries as Q
    from jobacct.sources import store as ST

    root = Q._store(spark)
    raw = Q._dated_bronze(spark, sf_small)
    ST.upsert_raw(spark, root, raw)
    n = ST.read_table(spark, root, ST.RAW).count()
    ST.upsert_raw(spark, root, raw.where(F.col("JobIDRaw").endswith("0")))
    assert ST.read_table(spark, root, ST.RAW).count() == n
