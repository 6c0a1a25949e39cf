"""Text parsers: the expected values the reference's own tests assert, plus
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobacct.functions import text as X
from jobacct.functions.nodes import expand_nodes


def one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_memory_mb(spark):
    got = one(spark, X.memory_mb, ["1.5G", "500", "0.5T", "2048K", "invalid", None, "4096M", "4Gn", "8Gc", "0", "N/A", "G", "-5G", " 2G", "1.2.3"])
    assert got == [1536.0, 500 / 1024, 524288.0, 2.0, 0.0, 0.0, 4096.0, 4096.0, 8192.0, 0.0, 0.0, 0.0, -5120.0, 2048.0, 0.0]


def test_cpu_seconds(spark):
    got = one(spark, X.cpu_seconds, ["01:30:45.123", "30:45", "2-12:30:00", "1-00:00:00", "", None, "INVALID", "UNLIMITED", "1-2-3", "x-01:00:00", "3-xx:00:00", "5", "1:2:3:4"])
    assert got == [5445.0, 1845.0, 217800.0, 86400.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 259200.0, 0.0, 0.0]


def test_safe_int(spark):
    assert one(spark, X.safe_int, ["-123", "123abc", None, "42", ""]) == [0, 0, 0, 42, 0]


def test_gpu_count(spark):
    got = one(spark, X.gpu_count, ["billing=4,gres/gpu=3,node=1", "gres/gpu=invalid", "cpu=4,gres/gpu:a100=2", "", None, "gres/gpu=2,gres/gpu=5"])
    assert got == [3, 0, 0, 0, 0, 2]


def test_gres_gpus(spark):
    got = one(spark, X.gres_gpus, ["gpu:4", "gpu:v100:8(S:0-1)", "gpu:a100:4(S:0)", "(null)", "gpu:x"])
    assert got == [4, 8, 4, None, None]


def test_partition_cores(spark):
    assert one(spark, X.partition_cores, ["cpu-32", "gpu", "a1b22", None]) == [32, 0, 1, 0]


def test_job_date(spark):
    df = spark.createDataFrame(
        [("2025-08-20T10:00:00", "2025-08-19T09:00:00"), ("Unknown", "2025-08-19T09:00:00"), ("202-08-20", "2025-8-20"),
         ("2025-08-20", None), (None, None), ("garbage-text", "2025-08-18T00:00:00")],
        "s string, b string",
    )
    got = [r[0] for r in df.select(X.job_date("s", "b")).collect()]
    assert got == ["2025-08-20", "2025-08-19", None, "2025-08-20", None, "2025-08-18"]


def test_state_and_user(spark):
    assert one(spark, X.normalize_state, ["CANCELLED by 123", "COMPLETED"]) == ["CANCELLED", "COMPLETED"]
    df = spark.createDataFrame([("", "1001"), ("  ", ""), ("bob", "5"), (None, None)], "u string, i string")
    assert [r[0] for r in df.select(X.user_or_uid("u", "i")).collect()] == ["uid_1001", "MISSING_USER", "bob", "MISSING_USER"]


def test_safe_timestamp(spark):
    got = one(spark, X.safe_timestamp, ["2025-08-19T10:30:00", "2025-08-19T10:30:00+02:00", "Unknown", "2025", "2025-8-1", None])
    assert got[0] == dt.datetime(2025, 8, 19, 10, 30)
    assert got[1] == dt.datetime(2025, 8, 19, 8, 30)
    assert got[2:] == [None, None, None, None]


NODE_CASES = [
    ("node-[1-3,10,20-22]", ["node-1", "node-2", "node-3", "node-10", "node-20", "node-21", "node-22"]),
    ("node-[001-003,005,007-009]", ["node-001", "node-002", "node-003", "node-005", "node-007", "node-008", "node-009"]),
    ("node001", ["node001"]),
    ("rig-[3-4,6-7]", ["rig-3", "rig-4", "rig-6", "rig-7"]),
    ("a,b", ["a,b"]),
    ("", []),
    ("None", []),
    ("N/A", []),
    (None, []),
    ("n[5-3]", []),
    ("n[x-y]", ["nx-y"]),
    ("n[abc]", ["nabc"]),
    ("n[1-2]extra,m[3]", ["n1", "n2"]),
    ("n[1-2", ["n1", "n2"]),
    ("n[-5]", ["n-5"]),
    ("n[08-11]", ["n08", "n09", "n10", "n11"]),
    ("n[098-101]", ["n098", "n099", "n100", "n101"]),
    ("n[1, 2]", ["n1", "n2"]),
    ("n[]", ["n"]),
    ("n[0-2]", ["n0", "n1", "n2"]),
    ("n[1-1]", ["n1"]),
    ("n[1,1]", ["n1", "n1"]),
    ("n[5-]", ["n5-"]),
]


@pytest.mark.parametrize("text,expected", NODE_CASES)
def test_expand_nodes(spark, text, expected):
    assert one(spark, expand_nodes, [text])[0] == expected


def test_expand_hundred_nodes(spark):
    assert len(one(spark, expand_nodes, ["gpu-[001-100]"])[0]) == 100
