"""The corpus pipeline, stage by stage, against brute force on a small table."""

from __future__ import annotations

import corpus_pipeline as CP
from conftest import odd_rows, prose
from test_near_dup import brute
from test_rules_and_leaks import brute_hits

from jobacct.llm import secrets as S

TEXTS = [
    (100, prose(11) + "\ntoken = \"abcdef0123456789abcdef01\" end", "en", "a", 1),
    (101, prose(12) + "\n" + " ".join(f"leak{i}" for i in range(14)) + "\n" + prose(13), "en", "a", 1),
]
ITEMS = [(1, " ".join(f"leak{i}" for i in range(12))), (2, "never seen words here at all in any text of them")]


def write(spark, tmp_path):
    d = str(tmp_path)
    from conftest import BENCH, DOCS

    docs = spark.createDataFrame(odd_rows() + TEXTS, DOCS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, BENCH).write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, tmp_path):
    d = write(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for i, (name, f) in enumerate(CP.STAGES):
        before = docs.collect()
        docs = f(spark, docs, d)
        docs.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        after = docs.collect()
        if i < 4:
            assert docs.columns == names, name
        if i == 0:
            from jobacct.llm import quality_rules as Q

            kept = [r.doc_id for r in Q.judge(spark, spark.createDataFrame(before, docs.schema)).where("kept").collect()]
            assert sorted(kept, key=repr) == sorted((r.doc_id for r in after), key=repr) and set(after) <= set(before)
        elif i == 1:
            comp = {r[0]: r[2] for r in brute([(r.doc_id, r.text) for r in before], 5)}
            assert sorted((r.doc_id for r in after), key=repr) == sorted((r.doc_id for r in before if comp[r.doc_id] == r.doc_id), key=repr)
        elif i == 2:
            assert all(brute_hits(r.text, ITEMS)[1] == 0 for r in after)
            clean = {r.doc_id: r for r in before if brute_hits(r.text, ITEMS)[1] == 0}
            assert all(r == clean[r.doc_id] for r in after if r.doc_id in clean) and clean.keys() <= {r.doc_id for r in after}
            assert any(r.doc_id == 101 and "leak" in r.text for r in after)  # the two words beyond the passage stay
        elif i == 3:
            assert len(after) == len(before) and all(not S.find(r.text)[1] for r in after)
            assert any("[assign]" in r.text for r in after)
            texts = [r.text for r in after]
        else:
            assert sorted(r.decoded for r in after) == sorted(texts) and all(r.n_ids == len(r.ids) for r in after)


def test_run_and_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path)
    out = CP.run(spark, d)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_ids", "decoded"] and out.count() > 3
    e = str(tmp_path / "empty")
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{e}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").limit(0).write.parquet(f"{e}/benchmark.parquet")
    assert CP.run(spark, e).count() == 0
    assert CP.ORACLE_SQL is None and [n for n, _ in CP.STAGES][1] == "near duplicates"


def test_columns_named_like_results_are_carried(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"ids": F.lit("x"), "decoded": F.lit(7), "keep0": F.lit("k")})
    out = CP.encode(spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "doc_ids", "doc_decoded", "keep0", "ids", "n_ids", "decoded"]
    assert {(r.doc_ids, r.doc_decoded, r.keep0) for r in out.collect()} == {("x", 7, "k")} and out.where("decoded is null").count() == 0
