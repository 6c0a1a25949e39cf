"""Operators 3, 4, 7 and 8: held-out accuracy, brute force, parts of the methods."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobacct.llm import language_id as L
from jobacct.llm import licenses as C
from jobacct.llm import quality_bayes as B
from jobacct.llm import toxicity as X
from jobacct.llm.common import table
from jobacct.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------------------
def test_toxic_documents_held_out(spark):
    r = QUERIES["op3_toxicity"](spark, SF)
    assert dict(r.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = r.join(table(spark, SF, "labels"), "doc_id").where("held_out and toxic is not null").collect()
    false = [x for x in rows if x.predicted and not x.toxic]
    found = [x for x in rows if x.predicted and x.toxic]
    assert not false and len(found) >= 0.7 * sum(x.toxic for x in rows)  # few toxic training texts at this size


def pattern_counts(votes) -> dict:
    bits = sum(v.astype(int) << i for i, v in enumerate(votes))
    return {(int(b), None): int(c) for b, c in zip(*np.unique(bits, return_counts=True), strict=True)}


def test_label_model_recovers_rates_and_ignores_repeats():
    rng = np.random.default_rng(4)
    n, prior = 40_000, 0.2
    y = rng.random(n) < prior
    rates = [(0.7, 0.01), (0.5, 0.02), (0.6, 0.05), (0.3, 0.01), (0.3, 0.01), (0.8, 0.1)]
    votes = [rng.random(n) < np.where(y, r[0], r[1]) for r in rates]
    alone = X.LabelModel(pattern_counts(votes), voters=6)
    m = X.LabelModel(pattern_counts([*votes, votes[0].copy()]))  # a voter that repeats another
    for model in (alone, m):
        assert abs(model.prior - prior) < 0.02
        for i, r in enumerate(rates):
            assert abs(model.rate[0][i] - r[0]) < 0.05 and abs(model.rate[1][i] - r[1]) < 0.02
    assert m.parent[6] == 0
    # the repetition moves no posterior
    assert all(abs(m.posterior(b | (b & 1) << 6) - alone.posterior(b)) < 0.001 for b in range(64))
    assert m.posterior(0, 1) > m.posterior(0) > m.posterior(0, 0)


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = X.score_documents(spark, odd, none).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert X.score_documents(spark, empty, none).count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, None), (8, 7), (None, 1)], "doc_id long, toxic int")
    clash = odd.selectExpr("*", "1 as _t", "2 as _y", "3 as q", "4 as feats", "5 as bits")
    rows = X.score_documents(spark, clash, some).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and (r._t, r._y, r.q, r.feats, r.bits) == (1, 2, 3, 4, 5) for r in rows)


# --- licences ---------------------------------------------------------------------------
def brute_base(t: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    at = sorted((i, label) for p, label in C.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def brute_labels(t: str | None, templates: dict, threshold: int) -> set[str]:
    """Every window of every paragraph against every template."""
    paragraphs = re.split(r"\n[^\S\n]*(?=\n)", "\n" + (t or "") + "\n")
    tokens = {name: set(C.byte_words(text)) for name, text in templates.items()}
    out = set()
    for p in paragraphs:
        words = C.byte_words(p)
        for name, want in tokens.items():
            long = len(C.byte_words(templates[name]))
            need = len(want) if len(want) < 9 else threshold * len(want) / 100
            must = {w for other in tokens.values() if len(want & other) >= need for w in want - other}
            for i in range(len(words)):
                have = want.intersection(words[i : i + long + long // 4])
                if len(have) >= need and must <= have:
                    out.add(name)
    return out


def mutated(seed: int) -> str:
    rng = random.Random(seed)
    lines = []
    for _ in range(6):
        w = rng.choice(list(C.TEMPLATES.values())).split()
        w = [x for x in w if rng.random() > rng.choice([0, 0.1, 0.25, 0.5])]
        text = " ".join(w)
        lines.append(text if rng.random() < 0.5 else re.sub(r"((?:\S+ ){5})", "\\1\n", text))
        lines += [""] * rng.randint(0, 1)
    return "\n".join(lines)


def test_licenses_against_brute_force(spark):
    texts = [mutated(i) for i in range(120)] + ["", None, "MIT\nLicense mit license MIT LICENSE", "x cc-by cc by", "apache licenses apache license", "é" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in C.scan_licenses(spark, df).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        want = brute_labels(t, C.TEMPLATES, C.THRESHOLD) | {x for x in r.base_labels.split(",") if x}
        assert set(filter(None, r.labels.split(","))) == want
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0", {"cc-by"}),
        ("Licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc-4.0"}),
        ("Released under the Apache License", {"apache"}),
        ("Released under the MIT License", {"mit", "mit-release"}),
        (C.TEMPLATES["cc-by-4.0"], {"cc-by-4.0"}),
        (C.TEMPLATES["cc-by-sa-4.0"], {"cc-by-sa-4.0", "cc-by-4.0"}),
        ("my rights are all reserved words", set()),
        ("All\nrights\nreserved.", {"all-rights-reserved"}),
        ("All rights\n\nreserved.", set()),
        (C.TEMPLATES["lgpl-notice"], {"lgpl-notice"}),
        (" words between ".join(C.TEMPLATES["bsd-notice"].split()), set()),  # its tokens, far apart
    ],
)
def test_licenses_name_what_is_written(text, want):
    j = C.Joiner(C.TEMPLATES, {})
    found = {x for b in C.blocks(text, j) for x in j.matches(b)} | {x for _, x in C.places(C.byte_words(text))}
    assert found == want


def test_licenses_clashing_names_and_long_text(spark):
    long = "word of the license " * 60_000 + C.TEMPLATES["isc-notice"]
    df = spark.createDataFrame([(1, long, "x", 7), (2, None, "y", None)], "doc_id long, text string, labels string, input0 int")
    r = {x.doc_id: x for x in C.scan_licenses(spark, df).collect()}
    assert r[1].labels == "isc-notice" and r[1].input0 == 7 and r[2].labels == "" and r[2].score == 0


def test_licenses_odd_rows(spark, odd, empty):
    assert C.scan_licenses(spark, odd).count() == 13
    assert C.scan_licenses(spark, empty).count() == 0


# --- quality ----------------------------------------------------------------------------
def test_quality_held_out(spark):
    r = QUERIES["op7_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and quality is not null")
    rows = r.collect()
    assert sum(x.good == bool(x.quality) for x in rows) >= 0.95 * len(rows)


def test_sparse_sites_shrink(spark):
    """A path of one row stays near its host, a host of one row near the corpus; a big bad host does not."""
    good, bad = "many plain words that read well " * 20, "@@ ## || !! " * 40
    rows = [(i, good, f"h{i % 20}", "p", 1) for i in range(600)] + [(600 + i, bad, "spam", "p", 0) for i in range(200)]
    rows += [(900, good, "spam", "new", 1), (901, good, "alone", "new", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int")
    out = {r.doc_id: r for r in B.score_quality(spark, df, df.select("doc_id", "quality"), F.col("host"), F.col("path")).collect()}
    assert out[900].path_posterior < 0.3 < out[901].path_posterior < out[0].path_posterior + 0.01
    assert out[900].score < out[901].score and not out[700].good and out[0].good


def test_quality_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = B.score_quality(spark, odd, none, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 13 and all(abs(r.evidence - 0.5) < 1e-9 and abs(r.score - 0.5) < 1e-6 for r in rows)
    assert B.score_quality(spark, empty, none, F.col("source"), F.col("lang")).count() == 0


# --- language ---------------------------------------------------------------------------
def test_language_held_out(spark):
    r = QUERIES["op8_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = r.where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in rows) >= 0.97 * len(rows) and all(0 <= x.score <= 1 for x in rows)


def test_filters_return_all_languages_of_a_gram(spark):
    rows = [(i, "shared words only en " * 3, "en", "") for i in range(9)] + [(100 + i, "shared words seulement fr " * 3, "fr", "") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, masks, _ = L.build(spark, df.select(F.col("lang").alias("_lang"), F.col("text").alias("_t")))
    both = np.bitwise_and.reduce(masks[L.slots(np.unique(L.grams("shared words")))], axis=1)
    assert names == ["en", "fr"] and (both == 3).all()
    d = L.Decider(names, masks)
    assert d("only en")[0] == "en" and d("seulement")[0] == "fr"
    # the correction takes out what chance alone would hit
    full = L.Decider(["a", "b"], np.where(np.arange(1 << L.SLOT_BITS) % 2 == 0, np.uint64(3), np.uint64(1)))
    assert full.false[0] > 0.9 > full.false[1]


def test_one_language_far_larger_than_the_rest(spark):
    """A language with over a million rare n-grams does not take the predictions of the others."""
    rng = np.random.default_rng(8)
    wide = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 500))) for _ in range(3000)]  # 3 million n-grams
    some = [f"kalu mira tosen {w} belka" for w in ("doru", "fenit", "galo", "hurem")]
    small = [f"the {w} house stands near water" for w in ("old", "red", "big", "low")]
    rows = [("aa", t) for t in wide * 3] + [("aa", t * 40) for t in some * 5000] + [("zz", t) for t in small * 20]
    names, masks, _ = L.build(spark, spark.createDataFrame(rows, "_lang string, _t string").repartition(8))
    d = L.Decider(names, masks)
    assert names == ["aa", "zz"] and (d.false < 0.05).all()
    assert all(d(t)[0] == "zz" and d(t)[1] > 0.8 for t in small) and all(d(t)[0] == "aa" for t in some)


def test_filter_grows_with_the_largest_language(spark):
    rng = np.random.default_rng(9)
    rows = [("aa", "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 500)))) for _ in range(400)] * 3 + [("zz", "old house")] * 9
    names, masks, _ = L.build(spark, spark.createDataFrame(rows, "_lang string, _t string"))
    assert len(masks) >= 3_900_000 and (L.Decider(names, masks).false < 0.05).all()


@pytest.mark.parametrize("t", [None, "", "123 !!", "\n\t"])
def test_undetermined(t):
    assert L.Decider(["en"], np.ones(1 << L.SLOT_BITS, np.uint64))(t) == (L.UND, 0.0)


def test_seventy_languages_of_two_texts(spark):
    """More languages than a mask word has bits, few texts each."""
    rng = random.Random(5)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(70)]
    text = lambda i: " ".join("".join(rng.choices(alphabets[i], k=6)) for _ in range(150))
    rows = [(f"l{i:02d}", text(i)) for i in range(70) for _ in range(2)]
    names, masks, _ = L.build(spark, spark.createDataFrame(rows, "_lang string, _t string"))
    assert len(names) == 70 and masks.shape[1] == 2
    d = L.Decider(names, masks)
    assert all(d(t)[0] == lang for lang, t in rows)
    assert sum(d(text(i))[0] == f"l{i:02d}" for i in range(70)) >= 60  # new texts
    # every n-gram that languages share alike is in the masks of all of them
    common = [(f"l{i:02d}", "zebra") for i in range(70)]
    names, masks, _ = L.build(spark, spark.createDataFrame(common, "_lang string, _t string"))
    found = np.bitwise_and.reduce(masks[L.slots(L.grams("zebra"), len(masks))], axis=1)
    assert (found == np.array([2**64 - 1, 2**6 - 1], np.uint64)).all()


def test_unknown_text_gets_the_language_learnt_most(spark):
    rows = [("aa", "one"), ("bb", "seven lines of longer words"), ("cc", "two")]
    names, masks, default = L.build(spark, spark.createDataFrame(rows, "_lang string, _t string"))
    d = L.Decider(names, masks, default)
    assert d("привет") == ("bb", 0.0) and d("12 !") == (L.UND, 0.0) and d("two")[0] == "cc"
    names, masks, default = L.build(spark, spark.createDataFrame([("aa", ""), ("bb", None)], "_lang string, _t string"))
    assert L.Decider(names, masks, default)("text") == (L.UND, 0.0)


def test_language_odd_rows(spark, odd, empty):
    rows = L.identify(spark, odd).collect()
    assert len(rows) == 13 and all(r.lang_pred == L.UND for r in rows if not r.text or not any(map(str.isalpha, r.text)))
    assert L.identify(spark, empty).count() == 0
