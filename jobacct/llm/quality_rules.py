"""Operator 9 [native]: quality rules with adaptive thresholds.

Fixed rules first (``base_failed``), then five ratios of a text are held
against thresholds that the corpus itself sets, per language and source:

* Each ratio is an integer of thousandths (mean word length: hundredths of a
  character), cut to its ``BITS`` leading binary digits: log-spaced buckets, exact
  below 1024, of a relative error under 1/512 above, without a last one. Counting
  rows per (lang, source, ratio, bucket) is a mergeable quantile sketch of bounded
  size (512 buckets for each doubling); partial counts are merged before the
  shuffle, so a source with a third of all rows is no hot key.
* From the running counts of a sketch come its quartiles; the threshold is
  q3 + max(3 * (q3 - q1), slack), for mean word length also q1 - the same and a
  slack of a quarter of q3 at least (scripts without blanks have "words" of
  thousands of characters).
  Sketches of all sources of a language give the language's threshold; a
  source's own is drawn to it by its row count: (n t + 50 p) / (n + 50).
* Thresholds are joined to the measured rows by (lang, source), broadcast if a
  count proves the table small, else by a shuffled join (AQE splits a hot one).

Only DataFrame functions run. A text is measured once, in its own row, without
a shuffle; measures are written to the checkpoint folder and read for both the
sketch and the verdict.

Odd inputs: a null or blank text has no words, so it fails the base rules.
Null language or source count as ''. Repeated rows and ties are measured and
judged alike. An empty table gives no rows. Extra columns are dropped by
``judge`` and kept by ``filter_documents``. Three-word windows are compared by
their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobacct.llm.common import BLANKS, UPPER, sized, stage

MIN_WORDS = 50
SHRINK_ROWS = 50
IQRS = 3
BITS = 10  # leading binary digits that a bucket keeps of a value
SCALED = "mean_chars"  # the measure without a natural top: its slack is a quarter of q3 at least
#: (measure, slack in its own unit, whether it has a lower threshold too)
RULES = [
    ("symbols_pm", 60, False),
    ("dup_lines_pm", 450, False),
    ("repeats_pm", 400, False),
    ("upper_pm", 250, False),
    ("mean_chars", 250, True),
]
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, *(m for m, _, _ in RULES)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the columns MEASURES, row by row."""
    p = "_llm_"
    t = F.col(p + "t")
    size = lambda c: F.size(c).cast("long")
    without = lambda c, chars: F.translate(c, chars, "")
    keep = [c for c in docs.columns if c not in MEASURES]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(p + "t"))
    d = d.select(
        *keep,
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias(p + "words"),
        F.length(without(t, BLANKS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(without(t, UPPER))).cast("long").alias(p + "upper"),
        F.filter(F.split(t, "\n"), lambda x: F.length(without(x, BLANKS)) > 0).alias(p + "lines"),
    )
    words = F.col(p + "words")
    at = lambda i: F.get(words, i)
    d = d.select(
        *keep, "word_chars", "n_symbols", p + "upper",
        size(words).alias("n_words"),
        size(p + "lines").alias(p + "n_lines"),
        (size(p + "lines") - size(F.array_distinct(p + "lines"))).alias("n_dup_lines"),
        # three-word windows as (hash, place), sorted: equal windows are neighbours
        F.when(
            F.size(words) >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size(words) - 3),
                    lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")),
                )
            ),
        ).alias(p + "wins"),
    )
    wins = F.col(p + "wins")
    same = lambda x, k: F.get(wins, k)["h"].eqNullSafe(x["h"])
    d = d.withColumn(p + "found", F.filter(wins, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))))
    d = d.withColumn(p + "places", F.sort_array(F.transform(p + "found", lambda x: x["i"]))).drop(p + "wins", p + "found")
    places = F.col(p + "places")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(places) - 1),
        F.lit(3),
        lambda n, k: n + F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1)),
    )
    d = d.withColumn("n_repeat_words", F.when(F.size(places) >= 2, covered).otherwise(0).cast("long"))
    ratio = lambda a, b, unit: F.coalesce(F.expr(f"({unit} * {a}) div nullif({b}, 0)"), F.lit(0)).cast("long")
    return d.select(
        *keep, *COUNTS,
        ratio("n_symbols", "word_chars", 1000).alias("symbols_pm"),
        ratio("n_dup_lines", p + "n_lines", 1000).alias("dup_lines_pm"),
        ratio("n_repeat_words", "n_words", 1000).alias("repeats_pm"),
        ratio(p + "upper", "word_chars", 1000).alias("upper_pm"),
        bucket(ratio("word_chars", "n_words", 100)).alias("mean_chars"),
    )


def bucket(v: Column) -> Column:
    """The least value of the bucket of a value from 0 on: its ``BITS`` leading binary digits."""
    off = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, off), off)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, value) -> rows, over the rows that pass the base rules. Sums of sketches are sketches."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("rule"), F.col(m).alias("value")) for m, _, _ in RULES)))
    rows = measured.where(~base_failed()).select("_lang", "_source", pairs.alias("p"))
    return rows.groupBy("_lang", "_source", F.col("p.rule").alias("rule"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _bounds(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, lower and upper threshold per key and rule. A window holds the buckets of one sketch."""
    by = Window.partitionBy(*keys, "rule")
    run = sk.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("all", F.sum("n").over(by))
    q = run.groupBy(*keys, "rule").agg(
        F.max("all").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("value"))).alias("q3"),
    )
    slack = F.create_map(*(F.lit(x) for m, s, _ in RULES for x in (m, s)))[F.col("rule")]
    scaled = F.when(F.col("rule") == SCALED, F.expr("q3 div 4")).otherwise(0)
    reach = F.greatest(IQRS * (F.col("q3") - F.col("q1")), slack, scaled)
    return q.select(*keys, "rule", "rows", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(sk: DataFrame) -> DataFrame:
    """One row per (lang, source) with a map rule -> (low, high)."""
    up = sk.groupBy("_lang", "rule", "value").agg(F.sum("n").alias("n"))
    own = _bounds(sk, ["_lang", "_source"])
    lang = _bounds(up, ["_lang"]).select("_lang", "rule", F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    both = own.join(lang, ["_lang", "rule"])
    drawn = lambda t: F.floor((F.col("rows") * F.col(t) + SHRINK_ROWS * F.col("p_" + t)) / (F.col("rows") + SHRINK_ROWS)).cast("long")
    return both.groupBy("_lang", "_source").agg(
        *(F.max(F.when(F.col("rule") == m, drawn(t))).alias(f"{m}_{t}") for m, _, low in RULES for t in (("low", "high") if low else ("high",)))
    )


def judge_measured(spark: SparkSession, measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` (staged: it is read twice) with base_failed and kept."""
    keyed = measured.withColumns({"_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source).cast("string"), F.lit(""))})
    limits = stage(spark, thresholds(sketch(keyed)), "rules-limits")
    bad = F.lit(False)
    for m, _, low in RULES:
        bad = bad | (F.col(m) > F.col(f"{m}_high"))
        if low:
            bad = bad | (F.col(m) < F.col(f"{m}_low"))
    out = keyed.join(sized(limits), ["_lang", "_source"], "left")
    out = out.withColumn("base_failed", base_failed())
    # a group without thresholds has no row that passes the base rules
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))
    return out.drop("_lang", "_source", *(c for c in limits.columns))


def judge(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept: one row per row of ``docs``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = stage(spark, measure(slim).drop("text"), "rules-measures")
    return judge_measured(spark, measured).select("doc_id", *COUNTS, "base_failed", "kept")


def filter_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Measures
    stand beside the texts in one staged table, so no text is shuffled."""
    held = docs.select(  # own names first: no column of ``docs`` clashes with a measure
        *(F.col(c).alias(f"_doc{i}") for i, c in enumerate(docs.columns)),
        F.col("text").alias("_llm_text"), F.col("lang").alias("_llm_lang"), F.col("source").alias("_llm_source"),
    )
    measured = stage(spark, measure(held, "_llm_text").drop("_llm_text"), "rules-documents")
    kept = judge_measured(spark, measured, "_llm_lang", "_llm_source").where("kept")
    return kept.select(*(F.col(f"_doc{i}").alias(c) for i, c in enumerate(docs.columns)))
