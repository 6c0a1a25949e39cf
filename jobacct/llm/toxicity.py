"""Operator 3: toxicity by weak supervision.

1. Voters: seed lexicons of insults (nouns, adjectives, vulgar words), a
   pattern of address ("you ... idiot"), shouted insults, and two lexicons
   induced from labelled training rows (words that stand in toxic texts far
   more often than in others, dealt to the two by hash). A voter says 1 or 0.
2. Label model: votes of all training rows are counted by vote pattern (at
   most 3 * 2**VOTERS rows come to the driver, whatever the corpus). A training
   row's own label, where there is one, is one more voter of known accuracy
   (GOLD). Expectation maximisation estimates the class prior, each voter's
   rates on both classes and the correlations: within a class a voter depends on
   at most one other (the tree of the largest conditional mutual information),
   so a voter that repeats another adds no evidence.
3. A logistic classifier over words and their first four to six bytes (word
   families) is trained on the posterior labels of a bounded sample of labelled
   training rows (SAMPLE, those with the least hash of their id, copies once)
   and scores every whole text. Features are counted by Spark; only those with a
   significant difference, and which of them a sample text holds, reach the
   driver, never a text. The learnt prior and voters do not enter the score.

Training rows are those with crc32(doc_id as text) mod 3 other than 1; label
columns, lang, source and doc_id are no inputs of a score. Induction takes the
same sample.

Odd inputs: null and empty texts score as texts without words (the bias).
Without labelled training rows the induced voters abstain, no classifier can be
fitted and every score is the label model's prior. A text with two labels counts
as toxic. Repeated rows score alike; extra columns pass.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.llm.common import byte_words, fold_1_of_3, map_batches, stage

SAMPLE = 6000
GOLD = 0.98  # accuracy of a label as a voter
STEMS = (4, 5, 6)
MIN_DOCS = 4  # toxic texts of the sample that hold a feature, at least
MIN_Z = 8.0  # standard errors by which the rates of a feature must differ
PREDICT = 0.7
INDEPENDENT = 10  # first rounds of the label model, in which voters are independent
MIN_GAIN = 0.002  # log-likelihood a row that a dependence has to gain

# --- fixed values: seed lexicons --------------------------------------------------------
NOUNS = "idiot idiots moron morons loser losers clown clowns scum trash imbecile imbeciles fool fools jerk jerks dumbass jackass scumbag scumbags lowlife degenerate degenerates parasite parasites vermin"
ADJECTIVES = "stupid pathetic worthless disgusting dumb ugly filthy idiotic moronic brainless revolting vile despicable retarded"
VULGAR = "fuck fucking fucked shit shitty bitch bitches bastard bastards asshole assholes cunt whore slut dickhead bullshit crap"

VOTERS = 7


class Voters:
    def __init__(self, induced: tuple[set[bytes], set[bytes]] = (set(), set())):
        self.nouns, self.adjectives, self.vulgar = (frozenset(x.encode().split()) for x in (NOUNS, ADJECTIVES, VULGAR))
        self.induced = induced
        seeds = self.nouns | self.adjectives | self.vulgar
        self.any = b"|".join(sorted(seeds))
        self.address = re.compile(rb"\b(?:you|your|this|these|such) (?:[a-z]+ ){0,2}(?:" + self.any + rb")\b")
        self.shout = re.compile(rb"\b(?:" + self.any.upper() + rb")\b")

    def bits(self, text: str | None) -> int:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        words = byte_words(text)
        s = features(text)
        seeded = [not s.isdisjoint(x) for x in (self.nouns, self.adjectives, self.vulgar)]
        votes = [
            *seeded,
            any(seeded) and bool(self.address.search(b" ".join(words))),
            any(seeded) and bool(self.shout.search(raw)),
            not s.isdisjoint(self.induced[0]),
            not s.isdisjoint(self.induced[1]),
        ]
        return sum(1 << i for i, v in enumerate(votes) if v)


def features(text: str | None) -> set[bytes]:
    """Distinct words of a text, and the beginnings of longer words marked by a star."""
    words = set(byte_words(text))
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STEMS))


def significant(rows: DataFrame) -> list[bytes]:
    """From rows (feats, y boolean): features of MIN_DOCS toxic texts or more whose
    document rates differ by MIN_Z standard errors, the toxic one 20 times the other or more."""
    y = F.col("y").cast("bigint")
    n1, n0 = (int(n or 0) for n in rows.agg(F.sum(y), F.sum(1 - y)).first())
    if not n1 or not n0:
        return []
    counts = rows.select(F.explode("feats").alias("f"), "y").groupBy("f").agg(F.sum(y).alias("a"), F.sum(1 - y).alias("b"))
    p1, p0, p = F.col("a") / n1, F.col("b") / n0, (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    found = counts.where((F.col("a") >= MIN_DOCS) & (p1 > 20 * p0) & (z > MIN_Z)).select("f")
    return sorted(bytes(r.f) for r in found.collect())


def induce(words: list[bytes]) -> tuple[set[bytes], set[bytes]]:
    """Two lexicons of significant features, dealt by hash."""
    return {w for w in words if crc32(w) & 1}, {w for w in words if not crc32(w) & 1}


class LabelModel:
    """Class prior, rates P(vote | class) and a tree of dependences
    P(vote | vote of its parent, class), by EM over counts of (vote bits, label or None)."""

    def __init__(self, counts: dict[tuple[int, int | None], int], rounds: int = 50, voters: int = VOTERS):
        self.prior, self.k = 0.1, voters
        self.rate = np.array([[0.5] * voters, [0.01] * voters])  # toxic, clean
        self.parent: list[int | None] = [None] * voters
        self.given = np.zeros((2, voters, 2))  # class, voter, vote of its parent
        patterns = list(counts)
        v = (np.array([b for b, _ in patterns], int)[:, None] >> np.arange(voters)) & 1
        gold = self._gold([y for _, y in patterns])
        n = np.array([counts[p] for p in patterns], float)
        for step in range(rounds if len(n) else 0):
            q = self._posterior(v, gold)
            weights = (n * q, n * (1 - q))
            for c, w in enumerate(weights):
                self.rate[c] = (w @ v + (0.5 if c == 0 else 0.01)) / (w.sum() + 1.0)
            self.prior = float(np.clip((n * q).sum() / n.sum(), 1e-4, 0.5))
            if step >= INDEPENDENT:
                self._depend(v, weights)

    def _depend(self, v: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> None:
        """Parents by the largest conditional mutual information, and their rates."""
        pairs, gain = [], np.zeros((self.k, self.k))
        for c, w in enumerate(weights):
            r, total = self.rate[c], w.sum() + 1.0
            both = ((v * w[:, None]).T @ v + np.outer(r, r)) / total  # one row's worth of independence
            np.fill_diagonal(both, r)
            both = np.minimum(both, np.minimum.outer(r, r))
            cells = [(both, np.outer(r, r)), (r[:, None] - both, np.outer(r, 1 - r)), (r[None, :] - both, np.outer(1 - r, r)),
                     (1 - r[:, None] - r[None, :] + both, np.outer(1 - r, 1 - r))]
            gain += total * sum(np.maximum(p, 0) * np.log(np.maximum(p, 1e-12) / np.maximum(e, 1e-12)) for p, e in cells)
            pairs.append(both)
        self.parent = [None] * self.k
        inside = [0]
        while len(inside) < self.k:
            _, i, j = max((gain[i, j], i, j) for i in inside for j in range(self.k) if j not in inside)
            self.parent[j] = i if gain[i, j] > MIN_GAIN * sum(w.sum() for w in weights) else None
            inside.append(j)
        for c, both in enumerate(pairs):
            for i, p in enumerate(self.parent):
                if p is not None:
                    r = self.rate[c]
                    self.given[c, i] = (r[i] - both[i, p]) / max(1 - r[p], 1e-9), both[i, p] / max(r[p], 1e-9)

    @staticmethod
    def _gold(labels: list[int | None]) -> np.ndarray:
        """Log-odds of the labels as votes."""
        z = float(np.log(GOLD / (1 - GOLD)))
        return np.array([0.0 if y is None else z if y else -z for y in labels])

    def _posterior(self, v: np.ndarray, gold: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + gold
        for i, p in enumerate(self.parent):
            r = self.rate[:, i, None] if p is None else self.given[:, i][:, v[:, p]]
            r = np.clip(r, 1e-4, 1 - 1e-4)
            z = z + np.where(v[:, i] == 1, np.log(r[0] / r[1]), np.log((1 - r[0]) / (1 - r[1])))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def posterior(self, bits: int, label: int | None = None) -> float:
        v = np.array([[bits >> i & 1 for i in range(self.k)]])
        return float(self._posterior(v, self._gold([label]))[0])


def train(rows: list[tuple[list[int], float]], words: list[bytes], prior: float, steps: int = 1500) -> tuple[dict[bytes, float], float]:
    """Weights of ``words`` and the bias, by gradient descent on soft labels;
    a row has the numbers of its words and its posterior."""
    y = np.array([q for _, q in rows])
    if not words:
        p = float(np.clip(y.mean() if len(y) else prior, 0.001, 0.5))
        return {}, float(np.log(p / (1 - p)))
    at = {w: i for i, w in enumerate(words)}
    pairs = [(r, i) for r, (found, _) in enumerate(rows) for i in found]
    r, c = np.array(pairs, int).reshape(-1, 2).T
    w, bias = np.zeros(len(at)), -2.0
    g2, b2 = np.full(len(at), 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, w[c], len(y)), -40, 40)))
        err = p - y
        gw, gb = np.bincount(c, err[r], len(at)) + 0.005 * w, err.sum()
        g2 += gw * gw
        b2 += gb * gb
        w -= 0.5 * gw / np.sqrt(g2)
        bias -= 0.5 * gb / np.sqrt(b2)
    return {x: float(w[i]) for x, i in at.items()}, float(bias)


SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])
_BITS = T.StructType([T.StructField("bits", T.IntegerType())])
_FEATS = T.StructType([T.StructField("feats", T.ArrayType(T.BinaryType()))])
_SOFT = T.StructType([T.StructField("q", T.DoubleType()), *_FEATS])
_HELD = T.StructType([T.StructField("held", T.ArrayType(T.IntegerType()))])


def sampled(docs: DataFrame, marks: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_t, _y) of the SAMPLE rows of ``marks`` with the least hash, each text once.
    The ids are chosen first and broadcast, so no text is shuffled but theirs."""
    some = F.broadcast(marks.orderBy(F.xxhash64("_l"), "_l").limit(SAMPLE))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(some, F.col("_id") == F.col("_l"))
    return rows.groupBy("_t").agg(F.max("_y").alias("_y"))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the score of every row."""
    marks = labels.where(~fold_1_of_3(doc_id)).select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("_y"))
    marks = marks.where("_y in (0, 1)").groupBy("_l").agg(F.max("_y").alias("_y"))
    sample = stage(spark, sampled(docs, marks, doc_id, text), "toxicity-sample")
    words = map_batches(sample, "_t", lambda: lambda t: (sorted(features(t)),), _FEATS, ["_y"])
    lexicons = induce(significant(words.select("feats", (F.col("_y") == 1).alias("y"))))

    def make():
        voters = Voters(lexicons)
        return lambda t: (voters.bits(t),)

    training = docs.where(~fold_1_of_3(doc_id)).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    votes = map_batches(training, "_t", make, _BITS, ["_id"])  # joined after voting: no text is shuffled
    counts = votes.join(marks, votes["_id"] == marks["_l"], "left").groupBy("bits", "_y").count()
    model = LabelModel({(r[0], r[1]): r[2] for r in counts.collect()})

    def labeller():
        voters = Voters(lexicons)
        return lambda t, y: (model.posterior(voters.bits(t), y), sorted(features(t)))

    soft = stage(spark, map_batches(sample, ["_t", "_y"], labeller, _SOFT, []), "toxicity-posteriors")
    at = {w: i for i, w in enumerate(significant(soft.select("feats", (F.col("q") >= 0.5).alias("y"))))}
    held = map_batches(soft, "feats", lambda: lambda feats: (sorted(at[w] for w in feats if w in at),), _HELD, ["q"])
    rows = sorted((r.held, r.q) for r in held.collect())  # SAMPLE at most; in order, so that the sums do not depend on tasks
    weights, bias = train(rows, list(at), model.prior)

    def scorer():
        def one(t):
            z = bias + sum(weights[w] for w in weights.keys() & features(t))
            return (float(1 / (1 + np.exp(-np.clip(z, -40, 40)))),)

        return one

    return map_batches(docs, text, scorer, SCHEMA, keep)
