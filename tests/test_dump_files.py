"""The rendered dump: its files grow in number with the table, not in size."""

import glob
import gzip

from pyspark.sql import functions as F

from jobacct.checks import fixtures as FX


def write_events(spark, path, n):
    i = F.col("id")
    rows = spark.range(n).select(
        ((i * 7) % n).alias("event_id"), F.timestamp_seconds(1704067200 + i * 977).alias("ts"), (i % 30).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "purchase"))), (i % 3 + 1).cast("int")).alias("event_type"),
        i.cast("double").alias("value"), F.concat(F.lit("p"), i.cast("string")).alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_files_of_a_bounded_number_of_events_in_line_order(spark, tmp_path, monkeypatch):
    sf = write_events(spark, tmp_path / "sf", 1000)
    monkeypatch.setattr(FX, "EVENTS_PER_FILE", 50)
    files = sorted(glob.glob(f"{FX.dump_path(spark, sf)}/part-*".removeprefix("file:")))
    assert len(files) > 15
    assert spark.conf.get(FX.HUGE_METHOD, "65535") == "65535"  # set for the rendering alone
    texts = [gzip.open(f, "rt").read().splitlines() for f in files]
    mains = [[int(line.split("|")[0]) for line in t if line.count("|") == 60 and line.split("|")[0].isdigit()] for t in texts]
    assert max(len(set(m)) for m in mains) <= 150
    ids = [j for m in mains for j in m]
    assert ids == sorted(ids) and set(ids) == set(range(1000))
    assert sum(map(len, texts)) == FX.accounting_lines(spark, sf).count()


def test_events_are_dealt_and_sorted_not_text(spark, tmp_path):
    sf = write_events(spark, tmp_path / "sf", 100)
    plan = FX.accounting_lines(spark, sf, 2, files=3)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    place = lambda what: next(k for k, line in enumerate(plan) if what in line)
    value = max(k for k, line in enumerate(plan) if "AS value#" in line)
    assert value < place("Sort [") < place("RepartitionByExpression")


def test_lines_of_one_job(spark, tmp_path):
    sf = write_events(spark, tmp_path / "sf", 600)
    lines = {r.seq: r.value for r in FX.accounting_lines(spark, sf, files=2).where("seq between 250 and 259 or seq between 5030 and 5039").collect()}
    main = lines[251].split("|")
    assert sorted(lines) == [250, 251, 252, 5031, 5032, 5035, 5036, 5037]
    stale, batch = lines[250].split("|"), lines[252].split("|")
    assert [main[0], stale[0], batch[0]] == ["25", "25", "25.batch"] and stale[10] == "PENDING" and main[10] == "COMPLETED"
    assert batch[2:5] == ["batch", "", ""] and batch[20] and not main[20]
    assert lines[5035] == "" and lines[5036].count("|") == 59 and lines[5037] == lines[5031] + "|extra"
