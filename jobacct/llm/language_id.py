"""Operator 8: language identification by bit-sliced n-gram Bloom filters.

* Training: character n-grams (3 and 4, letters only, word ends marked) of
  all training rows are counted per language by partial sums in the tasks and
  one grouped sum; an n-gram belongs to the languages in which its rate is at
  least SHARE of its rate in the language that uses it most; one that makes up
  less than MIN_RATE of a language's n-grams does not count there, so that no
  language holds more than 1 / MIN_RATE.
* Filter: slots, each a bitmask with one bit per language (a word for each 64
  languages); an n-gram of languages L sets the bits of L in its HASHES slots
  (the grouped bit_or of slots is the union of partial filters). One probe - the AND of HASHES slots -
  returns all languages that hold the n-gram.
* Decision: popcounts of a text's distinct n-grams per language, corrected for
  false positives: with fill f of a language's slice a foreign n-gram hits with
  probability f**HASHES, so members = (hits - n f**HASHES) / (1 - f**HASHES).
  The language with the largest corrected count wins (ties: name order); the
  score is its share of all corrected counts.

The filter has SLOTS_PER_GRAM slots or more for each n-gram that the largest
language counts, a power of two from 2**20 to 2**24 whatever the corpus (8 to
128 MB for each 64 languages); it goes to the tasks with the code. A language
counts 1 / MIN_RATE n-grams at most, so its slice is never more than a fifth
full at 2**24 slots. A slice in which more than MOST_FALSE of foreign n-grams
hit takes no part in a decision. lang, source and doc_id are no inputs of a
prediction.

Odd inputs: null texts and texts without a letter give ``und`` and score 0; so
do all texts if no training row has an n-gram. A text of which no n-gram is
known gets the language with most n-grams learnt (ties: name order), score 0.
Any number of languages. Repeated rows are predicted alike; extra columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.llm.common import SLICE, fold_1_of_3, map_batches

SLOT_BITS, HASHES = 20, 3  # 2**SLOT_BITS slots at least
SLOTS_PER_GRAM = 10  # of the language that holds most n-grams: a slice is 26 % full at most
SHARE = 0.35  # of the top rate, from which a language holds an n-gram
MOST_FALSE = 0.5  # a slice in which more foreign n-grams hit tells nothing
MIN_RATE = 1e-6  # an n-gram that rare in a language does not count there
WORD = 64  # languages of a mask word
BLOCK = 4096  # slots of a row that the driver reads
UND = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")
_K = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """64-bit hashes of all character 3- and 4-grams of the lower-cased words, each word between spaces."""
    s = " " + _NO_LETTER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in (3, 4):
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ c[i : i + len(h)]) * _K
                h ^= h >> np.uint64(32)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(h: np.ndarray, n: int = 1 << SLOT_BITS) -> np.ndarray:
    """HASHES slot numbers below ``n`` (a power of two up to 2**24) per n-gram, by double hashing."""
    a = (h >> np.uint64(40)).astype(np.int64)
    b = (h & np.uint64(0xFFFFFF)).astype(np.int64) | 1
    return (a[:, None] + np.arange(HASHES) * b[:, None]) & (n - 1)


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (_lang, _t): partial counts for each Arrow batch, then one grouped sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list] = {}
            sums: dict[str, list] = {}
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(grams(t or ""))
                for lang, hs in texts.items():
                    sums.setdefault(lang, []).append(np.unique(np.concatenate(hs), return_counts=True))
                texts = {}
            for lang, parts in sums.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return training.select("_lang", "_t").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(spark: SparkSession, training: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Language names, the filter (slots x mask words) and the number of the
    language with most n-grams."""
    from jobacct.llm.common import stage

    counts = stage(spark, gram_counts(training), "language-grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    names = sorted(totals)
    if not names:
        return names, np.zeros((1 << SLOT_BITS, 1), np.uint64), 0
    words = -(-len(names) // WORD)
    bit = F.create_map(*(F.lit(x) for i, l in enumerate(names) for x in (l, i)))[F.col("lang")]
    total = F.create_map(*(F.lit(x) for l in names for x in (l, float(totals[l] or 1))))[F.col("lang")]
    rated = counts.withColumns({"rate": F.col("n") / total, "bit": bit}).where(F.col("rate") >= MIN_RATE)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("of"))  # a language once
    held = F.expr(f"""inline(transform(sequence(0, {words - 1}), w -> struct(w AS word,
        aggregate(of, 0L, (m, x) -> if(x.rate >= {SHARE} * top AND x.bit div {WORD} = w, m | shiftleft(1L, x.bit % {WORD}), m)) AS mask)))""")

    most = rated.groupBy("bit").count().agg(F.max("count")).first()[0] or 0  # 1 / MIN_RATE at most
    size = 1 << max(SLOT_BITS, (most * SLOTS_PER_GRAM - 1).bit_length())
    masks = np.zeros((size, words), np.uint64)

    def probe(batches):
        for batch in batches:
            at = slots(np.asarray(batch.column(0)).astype(np.uint64), size).ravel()
            word, mask = (np.repeat(np.asarray(batch.column(i)), HASHES) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word), pa.array(mask)], names=["slot", "word", "mask"])

    cells = top.select("gram", held).where("mask <> 0").mapInArrow(probe, "slot bigint, word int, mask bigint")
    cells = cells.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    rows = cells.groupBy(F.expr(f"slot div {BLOCK}"), "word").agg(F.collect_list("slot").alias("slots"), F.collect_list("mask").alias("masks"))
    for r in rows.select("word", "slots", "masks").toLocalIterator():  # size / BLOCK rows a word, of BLOCK slots at most
        masks[np.array(r.slots), r.word] = np.array(r.masks, np.int64).view(np.uint64)
    return names, masks, max(range(len(names)), key=lambda i: totals[names[i]])


class Decider:
    """``masks``: one word for each slot, or a row of words; ``default``: the
    language of a text of which nothing is known."""

    def __init__(self, names: list[str], masks: np.ndarray, default: int = 0):
        self.names, self.masks, self.default = names, masks.reshape(len(masks), -1), default
        self.word, self.bits = np.divmod(np.arange(len(names)), WORD)
        self.bits = self.bits.astype(np.uint64)
        fill = np.array([((self.masks[:, w] >> b) & np.uint64(1)).mean() for w, b in zip(self.word, self.bits, strict=True)])
        self.false = fill**HASHES
        self.usable = self.false <= MOST_FALSE

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UND, 0.0
        g = np.unique(grams(text))  # empty for a text with letters but no n-gram of them (a word in a script of marks only)
        found = np.bitwise_and.reduce(self.masks[slots(g, len(self.masks))], axis=1)
        hits = ((found[:, self.word] >> self.bits) & np.uint64(1)).sum(axis=0)
        members = np.where(self.usable, np.maximum(hits - len(g) * self.false, 0) / np.where(self.usable, 1 - self.false, 1), 0)
        if not members.sum() > 0:
            return self.names[self.default], 0.0
        best = int(members.argmax())
        return self.names[best], float(members[best] / members.sum())


SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row; learnt from the rows not held out."""
    training = docs.where(~fold_1_of_3(doc_id) & F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_t"))
    names, masks, default = build(spark, training)
    return map_batches(docs, text, lambda: Decider(names, masks, default), SCHEMA, keep)
