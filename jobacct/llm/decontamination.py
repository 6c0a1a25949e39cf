"""Operator 2 [native]: benchmark decontamination by hashed token windows.

* Benchmark items become their distinct windows of 10 words (the whole item
  if it has fewer), each with a 64-bit key made of its words' hashes. A count of
  rows and bytes proves the window table small before it is broadcast. Of a larger
  one a blocked Bloom filter of the keys is broadcast, of a size fixed by the number
  of keys and never over ``MOST_BLOCKS`` blocks of 4 KB. Either way a key stands once,
  with its items apart, so an item repeated a thousand times does not multiply hits.
* Every document's windows of those lengths stream through the table or filter in
  the task that read the document. What passes is verified word by word against the
  window's text: at once, or after a shuffle of the windows that passed the filter
  (hits, and well under 1 % of the others until the filter is full), the keys that
  hold a large share of them apart from the rest. Only hits are kept.
* Per document, hit places merge into runs of words (``start``, ``end``
  exclusive) and the items whose windows occur are listed.

Documents are told apart by id and text digest together, so null or repeated
ids are safe and repeated rows get the same result each. Null, empty and
word-free texts have no words and no hits; items without words have no
windows. An empty benchmark leaves every document clean. Extra columns are
dropped by ``scan`` and kept by ``clean_documents``. Nothing is cut: long texts
are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobacct.llm.common import BROADCAST_ROWS, stage, words_of
from jobacct.operators.joins import lookup_join

N = 10
#: A table of windows is broadcast up to ``BROADCAST_ROWS`` rows and this many bytes of text.
BROADCAST_BYTES = 32 << 20
#: The filter: words of 64 bits in a block, bits for each key, blocks at most (32 MB, 16 million keys; fuller beyond).
BLOCK_WORDS, KEY_BITS, MOST_BLOCKS = 512, 16, 8192
#: Share of hit words from which a document goes as a whole.
DROP_SHARE = 0.5
#: Between words, with either case of letters being part of a word.
_GAP, _WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _key(hashes: Column, i: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(hashes, i + k) for k in range(length)))


def _places(length: int) -> Column:
    """All windows of a document of one length: (key, first word, length)."""
    h = F.col("hashes")
    return F.transform(_starts(F.size(h), length), lambda i: F.struct(_key(h, i, length).alias("key"), i.alias("i"), F.lit(length).alias("n")))


def benchmark_windows(spark: SparkSession, benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """(key, window, item) rows, staged, and the window lengths that occur (10 at most)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    items = items.withColumn("len", F.least(F.size("words"), F.lit(N))).where("len > 0").withColumn("hashes", _hashes(F.col("words")))
    key = F.lit(None).cast("long")
    for length in range(1, N + 1):
        key = F.when(F.col("len") == length, _key(F.col("hashes"), F.col("i"), length)).otherwise(key)
    rows = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))))
    rows = rows.select(key.alias("key"), F.concat_ws(" ", F.slice("words", F.col("i") + 1, F.col("len"))).alias("window"), "len", "item")
    windows = stage(spark, rows.distinct(), "decontamination-windows")
    return windows, sorted(r[0] for r in windows.select("len").distinct().collect())


def small(windows: DataFrame) -> bool:
    """Whether rows with a column ``window`` are few and short enough to be broadcast."""
    n, size = windows.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _probe(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block, word in it and the four bits of that word that stand for a key."""
    h = F.xxhash64(key)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))
    return F.pmod(key, F.lit(blocks)), F.shiftrightunsigned(h, 24).bitwiseAND(BLOCK_WORDS - 1).cast("int"), mask


def key_filter(spark: SparkSession, keys: DataFrame) -> tuple[DataFrame, int]:
    """(block, bits array<bigint>) of all ``keys`` (column key), staged, and the number of blocks."""
    blocks = min(MOST_BLOCKS, max(1, -(-keys.count() * KEY_BITS // (64 * BLOCK_WORDS))))
    block, word, mask = _probe(F.col("key"), blocks)
    held = keys.select(block.alias("block"), word.alias("word"), mask.alias("mask"))
    at = F.col("id")
    none = spark.range(blocks * BLOCK_WORDS).select(F.floor(at / BLOCK_WORDS).alias("block"), (at % BLOCK_WORDS).cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = held.unionByName(none).groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    row = F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"])  # BLOCK_WORDS entries each
    return stage(spark, words.groupBy("block").agg(row.alias("bits")), "decontamination-filter"), blocks


def with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with _llm_id and _llm_digest, which tell documents apart."""
    return docs.withColumns({"_llm_id": F.col(doc_id), "_llm_digest": F.xxhash64(F.col(text))})


def _on(a: DataFrame, b: DataFrame) -> Column:
    return a["_llm_id"].eqNullSafe(b["_llm_id"]) & (a["_llm_digest"] == b["_llm_digest"])


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """_llm_id, _llm_digest, n_hit, runs array<struct<start,end>> (words), items
    array<string>: one row per document with a verified hit, staged."""
    windows, lengths = benchmark_windows(spark, benchmark, item_id, item_text)
    d = with_key(docs, doc_id, text).select("_llm_id", "_llm_digest", words_of(F.col(text)).alias("words"))
    d = d.withColumn("hashes", _hashes(F.col("words")))
    places = [F.array().cast("array<struct<key:bigint,i:int,n:int>>"), *(_places(n) for n in lengths)]
    d = d.select("_llm_id", "_llm_digest", "words", F.flatten(F.array(*places)).alias("places"))
    distinct = windows.select("key", "window").distinct()
    own = F.concat_ws(" ", F.slice("words", F.col("i") + 1, F.col("n")))
    # explode_outer: for explode, the optimizer would compute ``places`` a second time in a filter on its size
    rows = d.select("_llm_id", "_llm_digest", "words", F.explode_outer("places").alias("p")).select("_llm_id", "_llm_digest", "words", "p.key", "p.i", "p.n")
    if small(distinct):
        # verified on key matches only: as an equality, the text would become a second join key, built for every window
        found = rows.join(F.broadcast(distinct), "key").where(F.startswith(own, F.col("window")) & F.startswith(F.col("window"), own))
    else:
        held, blocks = key_filter(spark, windows.select("key").distinct())
        block, word, mask = _probe(F.col("key"), blocks)
        passed = rows.join(F.broadcast(held), (block == held["block"]) & (F.get("bits", word).bitwiseAND(mask) == mask))
        passed = stage(spark, passed.select("_llm_id", "_llm_digest", "key", "i", "n", own.alias("own")), "decontamination-passed")
        found = lookup_join(passed, distinct, ["key"], "inner").where(F.col("own") == F.col("window"))
    found = stage(spark, found.select("_llm_id", "_llm_digest", "key", "window", "i", "n"), "decontamination-hits")
    # sets, so that repeated rows add nothing; what a document gathers is bounded by its text
    spans = found.groupBy("_llm_id", "_llm_digest").agg(F.collect_set(F.struct("i", "n")).alias("spans"))
    spans = spans.withColumn("at", F.expr("array_sort(array_distinct(flatten(transform(spans, s -> sequence(s.i, s.i + s.n - 1)))))"))
    spans = spans.withColumn("starts", F.expr("filter(at, (x, k) -> k = 0 or get(at, k - 1) < x - 1)"))
    spans = spans.withColumn("ends", F.expr("filter(at, (x, k) -> k = size(at) - 1 or get(at, k + 1) > x + 1)"))
    spans = spans.select("_llm_id", "_llm_digest", F.size("at").cast("long").alias("n_hit"), F.expr("zip_with(starts, ends, (s, e) -> struct(s as start, e + 1 as end))").alias("runs"))
    listed = windows.select("key", "window", "item")
    listed = F.broadcast(listed) if small(listed) else listed
    items = found.select("_llm_id", "_llm_digest", "key", "window").distinct().join(listed, ["key", "window"])
    items = items.groupBy("_llm_id", "_llm_digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stage(spark, spans.join(items, _on(spans, items)).select(spans["_llm_id"], spans["_llm_digest"], "n_hit", "runs", "items"), "decontamination-documents")


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, runs, items: one row per row of ``docs``."""
    h = hits(spark, docs, benchmark, doc_id, text, item_id, item_text)
    d = with_key(docs, doc_id, text).select("_llm_id", "_llm_digest", F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    return d.join(h, _on(d, h), "left").select(
        d["_llm_id"].alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")).alias("runs"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_runs(text: Column, runs: Column) -> Column:
    """``text`` without the words of ``runs`` and the separators before each."""
    parts = F.regexp_extract_all(text, F.lit(f"({_GAP})({_WORD})"), F.lit(0))  # one a word, its separators first
    tail = F.regexp_extract(text, f"({_GAP})$", 1)
    # what stands before, between and after the runs
    froms = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    tos = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(parts)))
    left = F.zip_with(froms, tos, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), ""))
    return F.concat(F.array_join(left, ""), tail)


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without benchmark passages: hit words leave the text (n_chars
    follows), a document goes when they are DROP_SHARE or more of its words.
    Documents without hits stay as they are."""
    h = hits(spark, docs, benchmark).select("_llm_id", "_llm_digest", F.col("n_hit").alias("_llm_hit"), F.col("runs").alias("_llm_runs"))
    # columns of docs by place, so that none of them can clash with the names here
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = with_key(docs.select(*(F.col(f"`{c}`").alias(k) for c, k in at.items())), at["doc_id"], at["text"])
    hit, runs, whole = F.col("_llm_hit"), F.col("_llm_runs"), d[at["text"]]
    j = d.join(h, _on(d, h), "left").where(hit.isNull() | (hit < DROP_SHARE * F.size(words_of(whole))))
    text = F.when(hit.isNull(), whole).otherwise(without_runs(whole, runs))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit.isNull(), d[at["n_chars"]]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return j.select(*(new.get(c, d[k]).alias(c) for c, k in at.items()))
