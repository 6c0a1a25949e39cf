"""Operator 6 against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import odd_rows

from jobacct.llm import common
from jobacct.llm import near_dup as N


def shingle_set(text: str | None, k: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple], k: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing every pair."""
    sets = [shingle_set(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[top(i)] = min(r[0], ids.get(top(i), r[0]))
    return sorted(((r[0], len(sets[i]), ids.get(top(i))) for i, r in enumerate(rows)), key=repr)


def result(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_group(n: int, words: int, edits: int, seed: int) -> list[str]:
    """A text and n - 1 copies with some words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_groups_of_near_copies(spark, k):
    texts = [t for s, (n, e) in enumerate([(40, 5), (60, 12), (3, 1), (2, 0), (30, 30)]) for t in near_group(n, 150, e, s)]
    texts += ["a b", "a b", "A b", "a b c", "", None]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(N.near_duplicates(spark, df, k=k)) == brute(rows, k)


def test_given_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(N.near_duplicates(spark, docs, k=4)) == brute(rows, 4)


def test_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert result(N.near_duplicates(spark, odd)) == brute(rows, 5)
    assert N.near_duplicates(spark, empty).count() == 0
    kept = N.filter_documents(spark, odd.selectExpr("*", "'z' as _llm_x"))
    assert kept.columns == [*odd.columns, "_llm_x"]
    # the copy and the near copy of document 1 go, its repeated row stays with it
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 4, 5, 6, 7, 8, 9, 10, None, None], key=repr)


def test_blocks_find_what_no_centre_links(spark, monkeypatch):
    """A chain a-b-c...: the bucket's centre is near few members; small blocks."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows, t = [], list(base)
    for i in range(40):
        for p in rng.sample(range(200), 4):
            t[p] = f"c{i}_{p}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(spark, df, k=4)) == brute(rows, 4)


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    a, b = np.unique(items[:4000]), np.unique(items[1000:])
    assert (N.merge(N.sketch(a), N.sketch(b)) == N.sketch(np.unique(items))).all()
    pairs = []
    for share in (0.2, 0.5, 0.8, 0.9, 1.0):
        n = 2000
        both = int(2 * n * share / (1 + share))
        x, y = items[:n], np.concatenate([items[:both], items[n : 2 * n - both]])
        pairs.append((N.sketch(np.unique(x)), N.sketch(np.unique(y)), len(x), len(y)))
    ra, rb = (np.array([p[i] for p in pairs]) for i in (0, 1))
    na, nb = (np.array([p[i] for p in pairs], float) for i in (2, 3))
    assert N.plausible(ra, rb, na, nb).tolist() == [False, False, True, True, True]


def test_unrelated_sets_share_no_band():
    """By the rate at which registers of unrelated sets of one size agree, a
    pair shares some band less than once in 10**9."""
    rng = np.random.default_rng(4)
    regs = np.array([N.sketch(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(400)])
    pairs = [(i, j) for i in range(400) for j in range(i)]
    equal = np.mean([(regs[i] == regs[j]).mean() for i, j in pairs])
    assert N.BANDS * equal**N.ROWS < 1e-9 and equal < 0.0004
    assert len(np.unique(N.bands_of(regs))) == 400 * N.BANDS


def test_band_keys():
    rng = np.random.default_rng(6)
    regs = np.array([N.sketch(rng.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(3)])
    regs[1, : N.ROWS] = regs[0, : N.ROWS]
    keys = N.bands_of(regs)
    assert (keys & 63).tolist() == [list(range(N.BANDS))] * 3
    assert keys[0, 0] == keys[1, 0] and len(np.unique(keys)) == 3 * N.BANDS - 1


def test_staged_tables_are_deleted(spark, sf_small, tmp_path, monkeypatch):
    count = iter(range(1000))
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{next(count)}")
    N.near_duplicates(spark, spark.read.parquet(f"{sf_small}/documents.parquet")).count()
    assert next(count) > 8
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["llm-near-components", "llm-near-rows"]
