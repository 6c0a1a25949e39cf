"""Operator 11 against a trie built turn by turn in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from jobacct.llm import prefix_trie as T
from jobacct.llm.queries import hundreds, op11_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows: list[tuple], share: bool = True) -> set[tuple]:
    convs: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + v[h:]
    nodes: dict[tuple, list[int]] = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = set()

    def below(k):
        todo, saved, leaves = [k], 0, 0
        while todo:
            n = todo.pop()
            saved += (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
            leaves += n not in kids
            todo += kids.get(n, [])
        return leaves, saved

    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df) -> set[tuple]:
    rows = df.select(*COLUMNS).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations() -> list[tuple]:
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, -3, -100, -150, 5000]:
        n = 1 + c * 7 % 6
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c // 3 % 4}") for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(6)]  # copies
    rows += [(c, t, "user", f"same {t}") for c in range(400, 420) for t in range(c % 6 + 1)]  # prefixes of them
    rows += [(7, None, None, None), (7, None, "a", None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 1, "user", "no id"), (8, 3, "user", "日本 é😀"), (9, 1, "a", "bc"), (10, 1, "ab", "c")]
    rows += [(150, t, "user", f"long {t % 11}") for t in range(300)] + [(151, t, "user", f"long {t % 11}") for t in range(297)]
    return rows


@pytest.mark.parametrize("share", [True, False])
def test_equals_the_plain_trie(spark, share):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    trie = T.build(spark, df, shared=hundreds if share else T.own_turns)
    assert found(trie.nodes) == brute(rows, share)


def test_conversation_over_many_ranges(spark):
    """A conversation that holds most rows lies in several ranges and slices."""
    rows = [(100, t, "user", f"x{t * t % 101}") for t in range(9000)] + [(c, t, "user", f"x{t * t % 101}") for c in (2, 101, 102, 103) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = T.numbered(spark, df, "conv_id", "turn", "role", "text")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.where("conv_id = 100").select("part").distinct().count() > 1
    assert [r.place for r in placed.where("conv_id = 100").orderBy("place").collect()] == list(range(1, 9001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = found(T.build(spark, df, shared=hundreds).nodes)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    small = [r for r in rows if r[0] != 100 or r[1] < 60]  # the plain version is quadratic; the top of both tries is one
    want = {(r[:5], r[7]) for r in brute(small) if 0 < r[1] < 50}
    assert {(r[:5], r[7]) for r in nodes if 0 < r[1] < 50} == want
    assert max(r[1] for r in nodes) == 9000


def test_end_list_of_many_pieces(spark):
    """Identical conversations whose ids fill several pieces, some below zero."""
    ids = [*range(-9000, 9000, 3), 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "conv_id bigint").select("conv_id", F.lit(1).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    r = {x.depth: x for x in T.build(spark, df).nodes.collect()}
    assert r[1].ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert (r[1].n_convs, r[0].n_children, r[0].n_leaves, r[0].saved_tokens) == (len(ids), 1, 1, len(ids) - 1)


def test_hash_composes():
    h = [T.turn_hash("u", str(i)) for i in range(20)]
    acc = [0]
    for x in h:
        acc.append((acc[-1] * T.BASE + x) % T.MOD)
    tail = 0
    for x in h[12:]:
        tail = (tail * T.BASE + x) % T.MOD
    assert T.joined(acc[12], tail, 8) == acc[20]
    assert T.turn_hash("a", "bc") != T.turn_hash("ab", "c")


def test_carried_over_whole_ranges():
    """A conversation that fills ranges of its own is carried through all of them."""
    p = T._pack
    ends = [(0, 1, (5, 2, p(7), 10)), (1, 5, (5, 3, p(9), 20)), (2, 5, (6, 1, p(4), 5)), (3, 8, (8, 1, p(4), 5))]
    over = T.carried(ends)
    assert over == {1: (5, 2, 7, 10), 2: (5, 5, T.joined(7, 9, 3), 30)}


def test_sequences_and_ends(spark):
    rows = conversations()
    trie = T.build(spark, spark.createDataFrame(rows, SCHEMA), shared=hundreds)
    seqs = {r.rep: r for r in trie.sequences.collect()}
    ends = trie.ends.collect()
    assert sorted(e.conv_id for e in ends) == sorted({r[0] for r in rows} - {None})
    assert all(sum(e.rep == k for e in ends) == r.weight for k, r in seqs.items())
    want = {(n[0], n[1]) for n in brute(rows) if n[4] == 0}
    assert {(r.rep, r.depth) for r in seqs.values() if r.leaf} == want


def test_empty_and_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.build(spark, empty).nodes.count() == 0
    names = ["part", "place", "hash", "chars", "upto", "skip", "base", "d", "rep", "weight", "slice", "_hot"]
    rows = conversations()[:60]
    df = spark.createDataFrame(rows, SCHEMA)
    df.select("*", *(F.lit("x").alias(c) for c in names)).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(op11_prefix_trie(spark, str(tmp_path))) == brute(rows)
