"""Operator 7: quality by hierarchical empirical Bayes.

* Document evidence: a logistic classifier on shape measures of the whole text
  (symbols, case, repeats, lines, word lengths), trained on a bounded sample of
  labelled rows (SAMPLE rows with the least hash of their id, copies once; rows with crc32(doc_id
  as text) mod 3 = 1 are held out). It gives p, the chance that a text is good.
* Sites: p is summed per host and per path (one grouped aggregation each, with
  partial sums, so a host with a third of all rows is no hot key). Variances
  within and between groups give the prior strengths k = within / between
  (method of moments); a host's posterior is drawn to the corpus mean by k_host
  rows' worth, a path's to its host's posterior by k_path rows' worth. A sparse
  site thus keeps near its prior.
* Score: logit(p) + logit(path posterior without the row itself) - logit(mean).

Group tables are joined back, broadcast if counts prove them small, else by
shuffled joins (AQE splits a hot host).

Odd inputs: null and empty texts have all measures 0 and are scored so. Null
host or path count as ''. Without labels of both kinds p is 0.5 for every row.
Repeated rows are scored alike, each adding to its site. An empty table gives
no rows. Extra columns are dropped; ``doc_id`` is carried.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.llm.common import fold_1_of_3, map_batches, sample_texts, sized, stage

SAMPLE = 6000
GOOD = 0.5
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@!?]")
MEASURES = 12


def measures(text: str | None) -> list[float]:
    """Shape of a text, each measure within 0 to about 1 (lengths by logarithm)."""
    if not text or not (words := text.encode("utf-8", "surrogatepass").split()):
        return [0.0] * MEASURES
    n, chars = len(words), len(text)
    low = [w.lower() for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(low)
    threes = len(set(zip(low, low[1:], low[2:], strict=False)))
    mean = sum(map(len, words)) / n
    return [
        np.log1p(n) / 12,
        min(mean / 20, 2.0),
        min(abs(mean - 6) / 10, 2.0),
        len(_SYMBOL.findall(text)) / chars,
        sum(map(str.isupper, text)) / chars,
        sum(map(str.isdigit, text)) / chars,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - threes / max(n - 2, 1),
        1 - len(counts) / n,
        max(counts.values()) / n,
        sum(w.isalpha() or bool(w.translate(None, b".,;:!?'\"-()").isalpha()) for w in low) / n,
        float(n < 50),
    ]


def train(rows: list[tuple[str | None, int]], steps: int = 600) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and scales of the measures."""
    y = np.array([r[1] for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(MEASURES + 1), np.zeros(MEASURES), np.ones(MEASURES)
    x = np.array([measures(r[0]) for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, g2 = np.zeros(MEASURES + 1), np.full(MEASURES + 1, 1e-6)
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - y) / len(y) + 1e-4 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    return w, mean, scale


SCHEMA = T.StructType([T.StructField("p", T.DoubleType())])


def evidence(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, keep: list[str]) -> DataFrame:
    """``keep`` and p for every row."""
    marks = labels.where(~fold_1_of_3(doc_id)).select(F.col(doc_id).alias("_l"), F.col(label).cast("int").alias("_y"))
    marks = marks.where("_y in (0, 1)").groupBy("_l").agg(F.max("_y").alias("_y"))
    w, mean, scale = train(sample_texts(docs, marks, doc_id, text, SAMPLE, "_y"))

    def make():
        def one(t):
            z = float((np.array(measures(t)) - mean) / scale @ w[:-1] + w[-1])
            return (float(1 / (1 + np.exp(-np.clip(z, -12, 12)))),)

        return one

    return map_batches(docs, text, make, SCHEMA, keep)


def strength(groups: DataFrame, n: Column, mean: Column, parent: Column, within: float) -> float:
    """Rows' worth of the prior: variance within groups over variance between
    them (method of moments, about the parent's mean)."""
    r = groups.agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (mean - parent) * (mean - parent)).alias("ss"), F.count(F.lit(1)).alias("g")
    ).first()
    if not r["g"] or r["g"] < 2:
        return 1e6
    between = (r["ss"] - (r["g"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(np.clip(within / between, 1.0, 1e6)) if between > 0 else 1e6


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(q / (1 - q))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id",
                  text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, good: one row per row."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text"), blank(host).alias("host"), blank(path).alias("path"))
    rows = stage(spark, evidence(d, labels, doc_id, "_text", label, [doc_id, "host", "path"]), "quality-evidence")
    paths = stage(spark, rows.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "quality-paths")
    hosts = stage(spark, paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "quality-hosts")
    all_ = paths.agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count(F.lit(1))).first()
    n, s, ss, fit, g = (float(x or 0) for x in all_)
    mu = min(max(s / n, 1e-4), 1 - 1e-4) if n else 0.5
    within = max((ss - fit) / max(n - g, 1.0), 1e-6)
    hmean = F.col("hs") / F.col("hn")
    k_host = strength(hosts, F.col("hn"), hmean, F.lit(mu), within)
    sited = paths.join(sized(hosts), "host")
    k_path = strength(sited, F.col("n"), F.col("s") / F.col("n"), hmean, within)
    out = rows.join(sized(paths.select("host", "path", "n", "s")), ["host", "path"]).join(sized(hosts), "host")
    own = F.col("p")  # a row is no evidence about its own site
    host_post = (F.col("hs") - own + k_host * mu) / (F.col("hn") - 1 + k_host)
    path_post = (F.col("s") - own + k_path * host_post) / (F.col("n") - 1 + k_path)
    z = logit(own) + logit(path_post) - logit(F.lit(mu))
    score = 1 / (1 + F.exp(-z))
    return out.select(doc_id, "host", "path", own.alias("evidence"), host_post.alias("host_posterior"), path_post.alias("path_posterior"),
                      score.alias("score"), (score >= GOOD).alias("good"))
