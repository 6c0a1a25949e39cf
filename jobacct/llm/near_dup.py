"""Operator 6: near duplicates by SetSketch registers.

1. Each text gives its set of distinct k-word shingles (64-bit hashes) and
   a SetSketch of ``M`` registers: the minimum over the set of an exponential
   variate, truncated to an exponentially spaced grid of base ``B`` (two bytes
   a register). Maxima of registers are the sketch of a union (``merge``).
2. Equal sets are one class (128-bit digest, then a number), so a group of copies
   of any size is one node from here on. No class is ever expanded into pairs.
3. Registers are banded: classes that agree on all ``ROWS`` registers of one of
   ``BANDS`` bands share a bucket. A pair of similarity 0.8 shares none with
   probability (1 - 0.8**5)**40 = 1.2e-7, a pair over 0.9 below 1e-15. The grid
   is so fine that two unrelated sets of one size agree in a register with
   probability 0.00025, in a whole band with 1e-18: buckets hold texts that share
   text, however large the corpus.
4. In each bucket every member is held against one centre, the member with
   the most bucket neighbours (the original of a group of near copies). The
   joint likelihood of the two sketches, sizes known, drops pairs for which a
   similarity of 0.8 is e**-10 as likely as the best one (a
   true link fails this about once in 200 000); the others are
   confirmed on full sets. Confirmed links form components.
5. Buckets that still hold more than one component are compared in blocks of
   bounded size, pair by pair inside a task: first on the sketches, then the
   members that have a possible partner again with their full sets. Only
   confirmed links come out. So a group of near copies costs its size, and
   only what the links left apart costs comparisons (a group of n texts that
   are almost, but not quite, similar enough costs n**2 / 2 sketch comparisons,
   spread over its blocks).

Components come from large-star / small-star rounds over staged tables. Skew:
copies are one node, bucket sizes and centres are partial aggregates, hot join
keys are split by AQE.

Odd inputs: null and blank texts have an empty set, n_shingles 0 and only
themselves in their component. Null ids: a component's id is its smallest
non-null id (null if there is none), kept is null-safe equality. Rows that
share a doc_id are one document and stay or go together. An empty table gives
no rows. Extra columns pass ``filter_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from jobacct.llm.common import SLICE, sized, stage, staging

WORDS, THRESHOLD = 5, 80  # words of a shingle unless the caller says otherwise; per cent of the union
BANDS, ROWS = 40, 5
M = BANDS * ROWS  # registers of a sketch, all of them banded
B, A = 1.001, 20.0  # base of the register grid, rate of the variates
REG = np.uint16
SLACK = 10.0  # log-likelihood by which a similarity under the threshold must win for a pair to go
BLOCK = 1024  # members of a bucket in one block; a member is copied once for each block of its bucket
CACHE = 400_000  # word hashes that a task remembers
_MIX = np.random.default_rng(20240601).integers(0, 2**32, (2, M), dtype=np.uint32) | np.uint32(1)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, their whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    acc = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        acc = (acc ^ w[i : i + len(acc)]) * _K1
        acc ^= acc >> np.uint64(29)
    acc = acc * _K2
    return np.unique(acc ^ (acc >> np.uint64(32)))


def sketch(items: np.ndarray) -> np.ndarray:
    """M registers of a set of well-mixed 64-bit hashes."""
    top = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(M, 2**32 - 1, np.uint32)
    for at in range(0, len(top), 2048):
        x = top[None, at : at + 2048] ^ _MIX[0][:, None]
        x *= _MIX[1][:, None]
        np.minimum(low, x.min(axis=1), out=low)
    variate = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1.0 - np.log(variate) / np.log(B)), 0, 65535).astype(REG)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands_of(regs: np.ndarray) -> np.ndarray:
    """For each sketch (a row of registers) a key for each band; its last six bits are the band."""
    rows = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    acc = np.full(rows.shape[:2], ROWS, np.uint64)
    for i in range(ROWS):
        acc = (acc ^ rows[:, :, i]) * _K1
        acc ^= acc >> np.uint64(29)
        acc *= _K2
        acc ^= acc >> np.uint64(32)
    return ((acc & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 101)


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float = THRESHOLD / 100, slack: float = SLACK) -> np.ndarray:
    """For pairs of sketches (rows of registers) and set sizes: whether a
    similarity of ``threshold`` or more is at least e**-slack as likely as the
    most likely one (joint likelihood of registers larger, smaller, equal)."""
    m = ra.shape[1]
    gt, eq = (ra > rb).sum(axis=1), (ra == rb).sum(axis=1)
    lt = m - gt - eq
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    pb = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (B - 1) / B) / np.log(B)
    p, q = pb(u - v * _GRID), pb(v - u * _GRID)
    ok = (_GRID <= np.minimum(u / v, v / u) + 1e-9)  # no larger similarity at these sizes
    log = lambda x: np.log(np.maximum(x, 1e-12))
    like = gt[:, None] * log(p) + lt[:, None] * log(q) + eq[:, None] * log(1 - p - q)
    like = np.where(ok, like, -np.inf)
    return like[:, _GRID >= threshold - 1e-9].max(axis=1) >= like.max(axis=1) - slack


def size_fits(na, nb):
    """Sizes that allow the threshold at all."""
    return 100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb)


# --- Spark side -----------------------------------------------------------------------
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, part.column(part.num_columns - 1).to_pylist()


def classes_of(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """_id, _digest of the text, n_shingles, content (null: empty set), regs: row by row."""
    src = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_digest"), F.col(text).alias("_text"))

    def run(batches):
        hashes = WordHashes()
        for part, texts in _texts(batches):
            sets = [shingles(t, hashes, k) for t in texts]
            content = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            regs = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary()), pa.array(regs, pa.binary())],
                names=["_id", "_digest", "n_shingles", "content", "regs"],
            )

    return src.mapInArrow(run, f"_id {docs.schema[doc_id].dataType.simpleString()}, _digest bigint, n_shingles bigint, content binary, regs binary")


def _members(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(key, cls, size): classes in buckets of two or more. The buckets are
    counted first; one of two is then known by its least and greatest class,
    and only for larger ones are the bands read again."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                t = batch.slice(at, 1024)
                keys = bands_of(np.frombuffer(b"".join(t.column(1).to_pylist()), REG))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(t.column(0).to_numpy(), BANDS))], names=["key", "cls"])

    rows = classes.select("cls", "regs").mapInArrow(run, "key bigint, cls bigint")
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    buckets = stage(spark, buckets.where("size > 1"), "near-buckets")
    two = buckets.where("size = 2").select("key", F.explode(F.array("lo", "hi")).alias("cls"), "size")
    more = rows.join(sized(buckets.where("size > 2").select("key", "size")), "key").select("key", "cls", "size")
    return stage(spark, two.unionByName(more), "near-members")


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias("n" + x), F.col("regs").alias("r" + x))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                t = batch.slice(at, 4096)
                na, nb = (np.asarray(t.column(i), np.float64) for i in (2, 3))
                ra, rb = (np.frombuffer(b"".join(t.column(i).to_pylist()), REG).reshape(-1, M) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(plausible(ra, rb, na, nb)))

    return rows.mapInArrow(run, "a bigint, b bigint")


def _sets(spark: SparkSession, docs: DataFrame, classes: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(cls, items): the full sets of the classes in ``wanted`` (cls), from one document of each."""
    who = classes.join(wanted.distinct(), "cls").select("cls", F.col("doc._id").alias("w_id"), F.col("doc._digest").alias("w_digest"))
    who = sized(stage(spark, who, "near-wanted"))  # few: texts stay where they are; many: texts are shuffled by id
    d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_digest"), F.col(text).alias("_text"))
    rows = d.join(who, d["_id"].eqNullSafe(who["w_id"]) & (d["_digest"] == who["w_digest"])).select("cls", "_text")

    def run(batches):
        hashes = WordHashes()
        for part, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, hashes, k).tobytes() for t in texts], pa.binary())], names=["cls", "items"])

    out = rows.mapInArrow(run, "cls bigint, items binary")
    return stage(spark, out.dropDuplicates(["cls"]), "near-sets")  # repeated rows give a class twice


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("items").alias("s" + x))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                t = batch.slice(at, SLICE)
                ok = []
                for sa, sb in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(cls, root) for the nodes of ``edges`` (a, b): root is the smallest
    node that can be reached. Large-star and small-star rounds, staged, until
    every node hangs on its root."""
    e = stage(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
        new = stage(spark, small.select(F.col("s.b").alias("a"), F.col("s.m").alias("b")).where("a != b").distinct(), "near-edges")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.select(F.col("a").alias("cls"), F.col("b").alias("root"))
        e = new


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list]]:
    """Rows (key, i, j, own, cls, root, n, regs, ...) sorted by key, i, j, as one list for each."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)

    for (key, i, j), group in groupby(rows(), lambda r: r[:3]):
        yield key, i, j, list(group)


def _open_pairs(key: int, i: int, j: int, g: list) -> Iterator[tuple[int, np.ndarray]]:
    """For each row x of a group the rows y that sketches allow it to be
    linked to: of another component, in a bucket of the first band that both
    share; within a block each pair once, else from block i to block j."""
    band = key & 63
    regs = np.frombuffer(b"".join(r[7] for r in g), REG).reshape(-1, M)
    n = np.array([r[6] for r in g], np.float64)
    own = np.array([r[3] for r in g])
    names = {c: k for k, c in enumerate(dict.fromkeys(r[5] for r in g))}
    root = np.array([names[r[5]] for r in g])
    for x in range(len(g)):
        y = np.arange(x + 1, len(g)) if i == j else np.flatnonzero(own == j) if own[x] == i else np.empty(0, int)
        y = y[(root[y] != root[x]) & size_fits(n[x], n[y])]
        if len(y) and band:
            z = slice(0, band * ROWS)
            y = y[~(regs[x, z] == regs[y, z]).reshape(len(y), band, ROWS).all(axis=2).any(axis=1)]
        if len(y):
            y = y[plausible(np.broadcast_to(regs[x], (len(y), M)), regs[y], np.full(len(y), n[x]), n[y])]
        if len(y):
            yield x, y


BLOCK_ROW = "key bigint, i int, j int, own int, cls bigint, root bigint, n bigint, regs binary"


def _blocks(spark: SparkSession, members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets with several components that sketches allow a link
    to another component: BLOCK_ROW, once for each pair of blocks. A bucket is
    dealt into blocks of about BLOCK members by hash; a pair of blocks is one
    small group, compared inside a task. No pair of members leaves it."""
    rooted = _rooted(members, roots)
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rows = rooted.join(split, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(classes.select("cls", "n", "regs"), "cls").select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "n", "regs"
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for key, i, j, g in _groups(batches):
            alive = sorted({k for x, y in _open_pairs(key, i, j, g) for k in (x, *y.tolist())})
            if alive:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, g[k], strict=True)) for k in alive], schema=schema)

    schema = to_arrow_schema(rows.schema)
    return stage(spark, rows.mapInArrow(run, BLOCK_ROW), "near-blocks")


def _block_edges(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between components, found inside the blocks on
    full sets; links between what a block has linked before are left out."""
    rows = blocks.join(sets, "cls").select("key", "i", "j", "own", "cls", "root", "n", "regs", "items")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for key, i, j, g in _groups(batches):
            up: dict[int, int] = {}

            def top(c: int, up=up) -> int:
                while c in up:
                    c = up[c]
                return c

            edges = []
            for x, ys in _open_pairs(key, i, j, g):
                sx = np.frombuffer(g[x][8], np.uint64)
                for y in ys:
                    rx, ry = top(g[x][5]), top(g[y][5])
                    if rx == ry:
                        continue
                    sy = np.frombuffer(g[y][8], np.uint64)
                    both = len(np.intersect1d(sx, sy, assume_unique=True))
                    if 100 * both >= THRESHOLD * (len(sx) + len(sy) - both):
                        up[rx] = ry
                        edges.append((g[x][4], g[y][4]))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


def _components_of(spark: SparkSession, docs: DataFrame, full: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(content, component_id) of every distinct set."""
    distinct = full.groupBy("content").agg(
        F.min("_id").alias("least_id"), F.min(F.struct("_id", "_digest")).alias("doc"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")
    )
    classes = stage(spark, distinct.withColumn("cls", F.monotonically_increasing_id()), "near-classes")  # numbers are fixed by writing them
    members = _members(spark, classes)
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    centres = members.join(degree, "cls").groupBy("key").agg(F.max(F.struct("degree", "cls")).alias("c")).select("key", F.col("c.cls").alias("b"))
    star = members.join(centres, "key").where("cls != b").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    pairs = stage(spark, _candidates(star, classes), "near-star-pairs")
    edges = _confirmed(pairs, _sets(spark, docs, classes, _both(pairs), doc_id, text, k))
    roots = components(spark, edges)
    blocks = _blocks(spark, members, roots, classes)
    found = stage(spark, _block_edges(blocks, _sets(spark, docs, classes, blocks.select("cls"), doc_id, text, k)), "near-block-edges")
    if not found.isEmpty():
        roots = components(spark, found.unionByName(roots.select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    ids = classes.select("content", "cls", "least_id")
    linked = _rooted(ids.join(roots.select("cls").union(roots.select("root")).distinct(), "cls"), roots)
    least = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    named = linked.join(least, "root").select("cls", "component")
    return ids.join(named, "cls", "left").select("content", F.coalesce("component", "least_id").alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """doc_id, _digest, n_shingles, component_id, kept: one row per row."""
    with staging(spark):
        rows = stage(spark, classes_of(docs, doc_id, text, k), "near-rows", out=True)
        full = rows.where("content is not null")
        named = stage(spark, _components_of(spark, docs, full, doc_id, text, k), "near-components", out=True)
    some = full.join(named, "content").select("_id", "_digest", "n_shingles", "component_id")
    none = rows.where("content is null").select("_id", "_digest", "n_shingles", F.col("_id").alias("component_id"))
    return some.unionByName(none).select(F.col("_id").alias("doc_id"), "_digest", "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they were."""
    with staging(spark):
        gone = near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias("_llm_id"), F.col("_digest").alias("_llm_digest")).distinct()
        gone = sized(stage(spark, gone, "near-gone", out=True))
    on: Column = docs["doc_id"].eqNullSafe(gone["_llm_id"]) & (F.xxhash64(docs["text"]) == gone["_llm_digest"])
    return docs.join(gone, on, "left_anti")
