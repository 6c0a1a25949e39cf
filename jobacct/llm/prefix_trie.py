"""Operator 11: prefix trie of conversations by whole-sequence collapse.

1. **Turns.** The table is range-partitioned and sorted by (conversation, turn,
   role, text); each task streams its range and gives every turn its place in
   the conversation, a rolling hash of all turns up to it (127 bits) and the
   code points up to it. A conversation that crosses a range border is carried
   on from the one row per range that says how the range ends. No conversation
   is ever held as a whole, however long.
2. **Rebuilding.** ``shared(conv_id)`` names for each conversation another one
   and how many of its first turns (``MOST_SHARED`` at most) replace as many of
   the own ones. The rolling hash composes, so the hash of a rebuilt
   conversation needs one row of each side and no turns.
3. **Collapse.** Identical rebuilt conversations become one sequence with a
   weight, its smallest member (the representative) and its list of ends.
   From here on a group of copies of any size is one sequence.
4. **Prefixes.** Only representatives have their prefixes written out. Grouped
   by (depth, hash) they are the nodes. Sequences that are proper prefixes of
   another one go by an anti-join with the inner nodes; the rest are the leaves.
5. **Weighted sums.** With L the code points of a sequence, b those before a
   node's last turn and w the weight, the subtree of a node holds
   sum(w (L - b)) code points with repeats. Every node belongs to its smallest
   representative, which so owns the end of its path from some depth on: counted
   once, the subtree holds sum(L - max(b, b of that depth)). The difference is
   what sharing prefixes saves. Children and leaves are sums of the same rows.

Skew: copies are one sequence; every grouping is summed before its shuffle;
lookups of turns are keyed by (conversation, place // ``SLICE_TURNS``), and the
lookup of a parent that very many sequences share is split by ``lookup_join``.
End lists are put together from pieces of ids that differ in their low
``PIECE_BITS`` bits only; one task streams the pieces of a list through SHA-256.
Every table that two steps read is staged in the shared folder.

Odd inputs: rows without a conversation id belong to no conversation and are
left out. Null turns come first, equal ones are ordered by role, then text (so
repeated rows are turns of their own); null role or text is empty. A
conversation may be rebuilt without turns; it ends at the root. An empty table
has no nodes. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.llm.common import stage
from jobacct.operators.joins import lookup_join

MOST_SHARED = 5  # turns that a conversation can take from another one
SLICE_TURNS = 4096  # turns of one conversation that share a join key
PIECE_BITS = 12  # low bits of the ids that one piece of an end list may differ in
MOD = 2**127 - 1
BASE = 0x5D0F3C6A9B1E47F2C8A3D6B50E7914F1
_POWERS = [pow(BASE, k, MOD) for k in range(4096)]
NONE = bytes(16)  # hash of no turns


def power(k: int) -> int:
    return _POWERS[k] if k < len(_POWERS) else pow(BASE, k, MOD)


def joined(first: int, second: int, n_second: int) -> int:
    """Hash of a sequence followed by another one of ``n_second`` turns."""
    return (first * power(n_second) + second) % MOD


def turn_hash(role: str, text: str) -> int:
    r = role.encode("utf-8", "surrogatepass")
    h = hashlib.blake2b(b"%d:" % len(r) + r + text.encode("utf-8", "surrogatepass"), digest_size=16)
    return int.from_bytes(h.digest(), "big") % MOD


def _pack(h: int) -> bytes:
    return h.to_bytes(16, "big")


_int = lambda b: int.from_bytes(b, "big")


# --- 1: places, rolling hashes -------------------------------------------------------------
TURN = "conv_id bigint, part int, place bigint, hash binary, chars bigint, upto bigint"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, role, text) in order: place, hash and code points since the range or the conversation began."""
    conv, place, acc, upto = None, 0, 0, 0
    for batch in batches:
        ids, parts, roles, texts = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for c, role, text in zip(ids, roles, texts, strict=True):
            if c != conv:
                conv, place, acc, upto = c, 0, 0, 0
            place, acc, upto = place + 1, (acc * BASE + turn_hash(role, text)) % MOD, upto + len(text)
            out.append((place, _pack(acc), len(text), upto))
        cols = zip(*out, strict=True) if out else ((), (), (), ())
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["conv_id", "part", "place", "hash", "chars", "upto"])


def carried(ends: list[tuple]) -> dict[int, tuple[int, int, int, int]]:
    """What each range takes over: range -> (conv_id, place, hash, code points).
    ``ends``: (range, its first conversation, (its last one, place, hash, code points)), one for each range."""
    out: dict[int, tuple[int, int, int, int]] = {}
    before: tuple[int, int, int, int] | None = None
    for part, first, (last, place, h, upto) in sorted(ends):
        if before is not None and before[0] == first:
            out[part] = before
        h = _int(h)
        if first == last and part in out:
            _, p0, h0, u0 = out[part]
            place, h, upto = p0 + place, joined(h0, h, place), u0 + upto
        before = (last, place, h, upto)
    return out


def numbered(spark: SparkSession, turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """TURN: every turn with its place from 1, the hash of all turns up to it, its code points and those up to it."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), "role", "text")
    local = stage(spark, rows.mapInArrow(_running, TURN), "trie-turns")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "hash", "upto")).alias("last"))
    over = carried([(r.part, r.first, tuple(r.last)) for r in ends.collect()])  # a row for each range of the shuffle

    def whole(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = [k for p in set(parts.tolist()) & over.keys() for k in ((parts == p) & (ids == over[p][0])).nonzero()[0].tolist()]
            if not rows:
                yield batch
                continue
            place, h, upto = (batch.column(k).to_pylist() for k in (2, 3, 5))
            for k in rows:
                _, p0, h0, u0 = over[int(parts[k])]
                place[k], h[k], upto[k] = p0 + place[k], _pack(joined(h0, _int(h[k]), place[k])), u0 + upto[k]
            cols = [batch.column(0), batch.column(1), pa.array(place, pa.int64()), pa.array(h, pa.binary()), batch.column(4), pa.array(upto, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return local.mapInArrow(whole, TURN) if over else local


# --- 2: rebuilt conversations --------------------------------------------------------------
REBUILT = "conv_id bigint, n bigint, skip bigint, taken bigint, depth bigint, hash binary, total bigint, shift binary, moved bigint"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, n, skip, last, skipped, head): how long the rebuilt
    conversation is, its hash and code points, and what turns a hash of own
    turns up to place p into one of the rebuilt conversation:
    hash + shift * BASE**(p - skip); likewise ``moved`` for code points."""
    zero = (NONE, 0)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            head = [(h["hash"], h["upto"]) for h in r["head"] or ()][: r["skip"]]
            own = max(0, r["n"] - r["skip"])
            (hh, hu), (sh, su) = head[-1] if head else zero, (r["skipped"]["hash"], r["skipped"]["upto"]) if r["skipped"] else zero
            shift = (_int(hh) - _int(sh)) % MOD
            if own:
                h, total = (_int(r["last"]["hash"]) + shift * power(own)) % MOD, hu - su + r["last"]["upto"]
            else:
                h, total = _int(hh), hu
            out.append((r["conv_id"], r["n"], r["skip"], len(head), len(head) + own, _pack(h), total, _pack(shift), hu - su))
        cols = zip(*out, strict=True) if out else [()] * 9
        names = ["conv_id", "n", "skip", "taken", "depth", "hash", "total", "shift", "moved"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("hash", "shift") else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)


def _conversations(spark: SparkSession, turns: DataFrame, shared: Callable[[Column], tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """REBUILT and base, a row for each conversation, staged; and the first turns of the bases."""
    c = F.col("conv_id")
    base, skip = shared(c)
    state = F.struct("place", "hash", "upto")
    convs = turns.withColumn("skip", skip.cast("bigint")).groupBy("conv_id").agg(
        F.first("skip").alias("skip"),
        F.max(state).alias("last"),
        F.max(F.when(F.col("place") <= F.col("skip"), state)).alias("skipped"),
        F.sort_array(F.collect_list(F.when(F.col("place") <= MOST_SHARED, F.struct("place", "hash", "chars", "upto")))).alias("first"),
    )
    convs = stage(spark, convs.withColumn("n", F.col("last.place")).withColumn("base", base.cast("bigint")), "trie-convs")
    used = convs.where("skip > 0").select(F.col("base").alias("conv_id")).distinct()
    heads = convs.join(used, "conv_id").select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    both = lookup_join(convs, heads, ["base"]).select("conv_id", "n", "skip", "last", "skipped", "head")
    made = both.mapInArrow(_rebuild, REBUILT)
    return stage(spark, made.join(convs.select("conv_id", "base"), "conv_id"), "trie-rebuilt"), heads


# --- 3: collapse ----------------------------------------------------------------------------
def ends_of(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """(depth, hash, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node, comma-joined."""
    pieces = convs.groupBy("depth", "hash", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "hash", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("depth", "hash").sortWithinPartitions("depth", "hash", "piece")

    def run(batches):
        key, sha = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"depth": key[0], "hash": key[1], "ends_sha256": sha.hexdigest()}])
        for batch in batches:
            done = []
            for d, h, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (d, h) != key:
                    if sha:
                        done.append(row())
                    key, sha = (d, h), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if sha:
            yield row()

    return pieces.mapInArrow(run, "depth bigint, hash binary, ends_sha256 string")


# --- 4: prefixes of representatives -----------------------------------------------------------
def _slices(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(n) / SLICE_TURNS))).alias("slice")


def _slice_of(c: str) -> Column:
    return F.floor(F.col(c) / SLICE_TURNS).alias("slice")


def _prefixes(spark: SparkSession, turns: DataFrame, seqs: DataFrame, heads: DataFrame) -> DataFrame:
    """(rep, d, hash, chars, before, total, weight, depth): every prefix of every sequence, the empty one included; staged."""
    rest = ["weight", "depth", "total"]
    who = seqs.where("n > skip").select(F.col("rep").alias("conv_id"), "skip", "taken", "shift", "moved", *rest, _slices("n"))
    own = turns.select("conv_id", "place", "hash", "chars", "upto", _slice_of("place")).join(who, ["conv_id", "slice"]).where("place > skip")
    own = own.select(
        F.col("conv_id").alias("rep"), (F.col("place") - F.col("skip") + F.col("taken")).alias("d"), "hash", "chars",
        (F.col("upto") + F.col("moved") - F.col("chars")).alias("before"), *rest, "shift", (F.col("place") - F.col("skip")).alias("on"),
    )

    def moved(batches):
        for batch in batches:
            h, s, on = (batch.column(k).to_pylist() for k in (2, 8, 9))
            h = [a if b == NONE else _pack((_int(a) + _int(b) * power(k)) % MOD) for a, b, k in zip(h, s, on, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(h, pa.binary()), *batch.columns[3:8]], names=batch.schema.names[:8])

    own = own.mapInArrow(moved, "rep bigint, d bigint, hash binary, chars bigint, before bigint, weight bigint, depth bigint, total bigint")
    taken = lookup_join(seqs.where("taken > 0"), heads, ["base"], "inner").select("rep", *rest, F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    taken = taken.select("rep", F.col("t.place").alias("d"), "t.hash", "t.chars", (F.col("t.upto") - F.col("t.chars")).alias("before"), *rest)
    zero = F.lit(0).cast("bigint")
    root = seqs.select("rep", zero.alias("d"), F.lit(NONE).alias("hash"), zero.alias("chars"), zero.alias("before"), *rest)
    return stage(spark, own.unionByName(taken).unionByName(root), "trie-prefixes")


# --- 5: the trie --------------------------------------------------------------------------------
@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    chars (of the last turn), saved_tokens, ends_sha256, a row for each node.
    ``sequences``: rep, weight, depth, leaf, a row for each distinct rebuilt
    conversation. ``ends``: rep, conv_id, a row for each conversation and the sequence it is."""

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def own_turns(c: Column) -> tuple[Column, Column]:
    """Conversations as they are."""
    return c, F.lit(0)


def build(
    spark: SparkSession,
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    shared: Callable[[Column], tuple[Column, Column]] = own_turns,
) -> Trie:
    """The trie of all conversations of ``turns``. ``shared``: from the
    conversation id the one whose first turns it takes over, and how many (0 to ``MOST_SHARED``)."""
    rows = numbered(spark, turns, conv_id, turn, role, text)
    convs, heads = _conversations(spark, rows, shared)
    rep = F.min(F.struct("conv_id", "n", "skip", "taken", "shift", "moved", "base", "total")).alias("r")
    seqs = convs.groupBy("depth", "hash").agg(F.count(F.lit(1)).alias("weight"), rep)
    seqs = stage(spark, seqs.select("depth", "hash", "weight", F.col("r.conv_id").alias("rep"), "r.n", "r.skip", "r.taken", "r.shift", "r.moved", "r.base", "r.total"), "trie-sequences")
    prefixes = _prefixes(spark, rows, seqs, heads)
    shape = prefixes.groupBy("d", "hash").agg(F.min("rep").alias("owner"), F.max("before").alias("before"), F.max(F.col("d") < F.col("depth")).alias("inner"))
    shape = stage(spark, shape, "trie-shape")
    inner = shape.where("inner").select(F.col("d").alias("depth"), "hash")
    leaves = seqs.join(inner, ["depth", "hash"], "left_anti").select("rep", F.lit(1).cast("bigint").alias("leaf"))
    owners = shape.groupBy("owner").agg(F.min(F.struct("d", "before")).alias("o")).select(F.col("owner").alias("rep"), F.col("o.d").alias("from"), F.col("o.before").alias("from_before"))
    marks = seqs.select("rep", "weight", "depth").join(leaves, "rep", "left").join(owners, "rep", "left")
    marks = stage(spark, marks.withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("bigint"))), "trie-marks")
    per_slice = marks.select("rep", "leaf", "from", "from_before", _slices("depth"))
    marked = prefixes.withColumn("slice", _slice_of("d")).join(per_slice, ["rep", "slice"])
    once = F.when(F.col("from").isNotNull(), F.col("total") - F.greatest("before", "from_before")).otherwise(0)
    child = (F.col("from") <= F.col("d") + 1) & (F.col("d") < F.col("depth"))
    nodes = marked.groupBy("d", "hash").agg(
        F.min("rep").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.when(child, 1).otherwise(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.max("chars").alias("chars"),
        (F.sum(F.col("weight") * (F.col("total") - F.col("before"))) - F.sum(once)).alias("saved_tokens"),
    )
    # a node has its owner's parent, but the owner's first one hangs on another owner's path
    above = marked.where("d = from - 1 and d > 0").select("rep", F.col("from").alias("d"), F.col("d").alias("pd"), F.col("hash").alias("ph"))
    above = lookup_join(stage(spark, above, "trie-above"), shape.select(F.col("d").alias("pd"), F.col("hash").alias("ph"), F.col("owner").alias("above")), ["pd", "ph"])
    above = above.select(F.col("rep").alias("conv_id"), "d", "above")
    first = convs.agg(F.min("conv_id")).scalar()
    parent = F.when(F.col("d") == 1, first).when(F.col("d") > 1, F.coalesce("above", "conv_id"))
    ends = ends_of(spark, convs).withColumnRenamed("depth", "d")
    nodes = nodes.join(above, ["conv_id", "d"], "left").join(ends, ["d", "hash"], "left")
    nodes = nodes.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "chars", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    members = convs.select("depth", "hash", "conv_id")
    return Trie(nodes, marks.select("rep", "weight", "depth", (F.col("leaf") == 1).alias("leaf")), lookup_join(members, seqs.select("depth", "hash", "rep"), ["depth", "hash"]).select("rep", "conv_id"))
