"""Property tests: rendered values parse back to the numbers they came from."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobacct.functions import text as X
from jobacct.functions.nodes import expand_nodes

SETTINGS = settings(max_examples=8, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 23), st.integers(0, 59), st.integers(0, 59), st.booleans()), min_size=1, max_size=40))
def test_cpu_time_roundtrip(spark, vals):
    rows = []
    for d, h, m, s, frac in vals:
        txt = (f"{d}-" if d else "") + f"{h:02d}:{m:02d}:{s:02d}" + (".500" if frac else "")
        rows.append((txt, float(d * 86400 + h * 3600 + m * 60 + s)))
    df = spark.createDataFrame(rows, "t string, want double")
    assert df.where(X.cpu_seconds("t") != F.col("want")).count() == 0


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from(["K", "M", "G", "T", ""]), st.sampled_from(["", "n", "c"])), min_size=1, max_size=40))
def test_memory_roundtrip(spark, vals):
    factor = {"K": 1 / 1024, "M": 1.0, "G": 1024.0, "T": 1024.0 * 1024, "": 1 / 1024}
    rows = [(f"{n}{u}{sfx}", n * factor[u] if u != "K" and u != "" else n / 1024) for n, u, sfx in vals]
    df = spark.createDataFrame(rows, "t string, want double")
    got = df.select(X.memory_mb("t").alias("g"), "want", "t").collect()
    for r in got:
        want = 0.0 if r.t in ("0",) else r.want
        assert abs(r.g - want) <= 1e-9 * max(1.0, abs(want)), r


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 20), st.booleans()), min_size=1, max_size=20))
def test_node_range_roundtrip(spark, vals):
    rows, want = [], []
    for lo, span, pad in vals:
        hi = lo + span
        w = max(len(str(hi)), 1) + 1 if pad else 0
        lo_txt = str(lo).zfill(w) if pad else str(lo)
        rows.append((f"gpu[{lo_txt}-{hi}]",))
        want.append([f"gpu{str(i).zfill(len(lo_txt)) if pad else i}" for i in range(lo, hi + 1)])
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(expand_nodes("t")).collect()]
    assert got == want
