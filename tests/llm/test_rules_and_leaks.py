"""Operators 2 and 9 (and all SQL of this subpackage) against DuckDB and brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from jobacct.llm import decontamination as D
from jobacct.llm import quality_rules as Q
from jobacct.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str | None) -> str:
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def brute_hits(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = WORD.findall(lower(t))
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, " ".join(f"b{i}" for i in range(25))), (2, "short item"), (10, "Short ITEM"), (3, ""), (4, None), (5, "été 9 " * 6), (6, " ".join(f"b{i}" for i in range(12)))]
LEAK = " ".join(f"B{i}" for i in range(3, 20))


@pytest.fixture()
def tables(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = spark.createDataFrame(
        [(20, "x y " + LEAK + "; z", "en", "a", 1), (21, "short-item! a short b item", "en", "a", 1), (22, "é été 9 été 9 été 9 été 9 été 9 été 9 x", "fr", "a", 1), (23, LEAK + ".", "en", "a", 1), (24, LEAK + "." * 3 + " tail " * 30, "en", "a", 1)],
        odd.schema,
    )
    return odd.unionByName(more), bench


def test_hits_against_brute_force(spark, tables):
    docs, bench = tables
    text = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.scan(spark, docs, bench).collect()), key=repr)
    assert got == sorted(((i, *brute_hits(t, ITEMS)) for i, t in text), key=repr)
    assert D.scan(spark, docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.scan(spark, docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_filtered_windows_of_a_large_benchmark(spark, tables, monkeypatch, full):
    """Beyond the broadcast bound, and with a filter so full that it lets every window through, results stay."""
    docs, bench = tables
    a = sorted(map(repr, D.scan(spark, docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 10)
    if full:
        monkeypatch.setattr(D, "key_filter", lambda spark, keys: (spark.createDataFrame([(0, [-1] * D.BLOCK_WORDS)], "block long, bits array<bigint>"), 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, D.scan(spark, docs, bench).collect())) == a
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_holds_every_key_and_few_others(spark):
    from pyspark.sql import functions as F

    n = 40_000
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    held, blocks = D.key_filter(spark, keys)
    assert blocks == n * D.KEY_BITS // (64 * D.BLOCK_WORDS) + 1 == held.count()
    assert held.where(F.size("bits") != D.BLOCK_WORDS).isEmpty()
    block, word, mask = D._probe(F.col("key"), blocks)
    passes = lambda k: k.join(F.broadcast(held), (block == held["block"]) & (F.get("bits", word).bitwiseAND(mask) == mask)).count()
    assert passes(keys) == n
    assert passes(spark.range(n, 11 * n).select(F.xxhash64("id").alias("key"))) < 0.01 * 10 * n


def test_cleaned_documents(spark, tables):
    docs, bench = tables
    docs = docs.selectExpr("*", "1 as n_hit", "'q' as runs", "7 as _llm_id", "8 as _llm_digest", "9 as _llm_hit", "'z' as c0")  # names of the operator's own columns
    out = D.clean_documents(spark, docs, bench)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert D.scan(spark, out, bench).where("n_hit > 0").count() == 0
    assert 23 not in rows and 20 not in rows  # mostly benchmark: gone
    assert rows[24].text == "." * 3 + " tail " * 30 and rows[24].n_chars == len(rows[24].text) and rows[24].runs == "q"
    assert {(r._llm_id, r._llm_digest, r._llm_hit, r.c0) for r in rows.values()} == {(7, 8, 9, "z")}
    untouched = {r.doc_id: r for r in docs.where("doc_id < 20").collect()}
    assert all(rows[i] == r for i, r in untouched.items())


def brute_measures(t: str | None) -> tuple:
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in three if three.count(x) > 1} if len(three) < 2000 else {x for x, n in __import__("collections").Counter(three).items() if n > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(three) if x in many for k in range(3)}))


def test_measures_and_verdicts(spark, odd, empty):
    rows = Q.judge(spark, odd).collect()
    texts = sorted(map(brute_measures, (r.text for r in odd.collect())))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == texts
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert Q.judge(spark, empty).count() == 0
    extra = odd.selectExpr("*", "1 as n_words", "2 as symbols_pm", "3 as base_failed")
    out = Q.filter_documents(spark, extra)
    assert out.columns == extra.columns and {(r.n_words, r.symbols_pm, r.base_failed) for r in out.collect()} == {(1, 2, 3)}
    assert out.count() == sum(r.kept for r in rows)


def test_thresholds_adapt_to_their_source(spark):
    """A source whose texts all carry symbols keeps them; the same texts stand out elsewhere."""
    plain = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, marked, "en", "wiki", 1) for i in range(300)] + [(1000 + i, plain, "en", "news", 1) for i in range(300)] + [(5000, marked, "en", "news", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in Q.judge(spark, df).where("kept").collect()}
    assert 5000 not in kept and len(kept) == 600


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, sf_small)
    assert sorted(df.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in df.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


def test_native_plans_have_no_python(spark, sf_small):
    for name in ("op2_decontamination", "op9_quality_rules"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_digest_of_items():
    assert hashlib.sha256(b"10,2").hexdigest() != hashlib.sha256(b"2,10").hexdigest() and sorted(["2", "10"]) == ["10", "2"]


def test_buckets_have_no_last_one(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 512, 1023, 1024, 1025, 2047, 2048, 2051, 10_000, 10_007, 3_000_000, 2**40 + 12345]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", Q.bucket(F.col("v")).alias("b")).collect()}
    for v, b in got.items():
        assert b == (v >> max(v.bit_length() - 10, 0)) << max(v.bit_length() - 10, 0)
        assert b <= v and 512 * (v - b) < max(v, 1)
    assert got[10_000] != got[3_000_000]


def test_mean_length_rule_where_words_are_long(spark):
    """A script without blanks: "words" of about 3000 characters are usual there, ten times as many stand out."""
    usual = [(i, " ".join("字" * (2900 + (i * 37 + j * 11) % 200) + str(j) for j in range(60)), "zh", "a") for i in range(40)]
    odd_one = [(100, " ".join("字" * 40_000 + str(j) for j in range(60)), "zh", "a"), (101, " ".join("字" * 90 + str(j) for j in range(60)), "zh", "a")]
    df = spark.createDataFrame(usual + odd_one, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judge(spark, df).collect()}
    assert all(kept[i] for i in range(40)) and not kept[100] and not kept[101]
