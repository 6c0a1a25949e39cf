"""Operator 12: the rank index against all boundaries, outputs against a plain version, exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobacct.llm import fill_in_middle as M

from tests.llm.conftest import odd_rows

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text: str) -> tuple:
    """The rule, token by token."""
    tokens = TOKEN.findall(text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(pre), len(mid), out


def texts() -> list[str]:
    rng = random.Random(5)
    odd = ["", "a", "ab", " ", "a b", "日本語 é😀z", "\n\n", "x" * 200_000, " " * 70_000, "<P>", "a<S>b", "<", "<S", "S>", "<P", "\x00a"]
    odd += [t or "" for _, t, *_ in odd_rows()]
    odd.append("".join(rng.choice(["a" * rng.choice([1, 2, 3000]), " ", "<", "é"]) for _ in range(90_000)))  # steps of very different length
    odd += ["".join(rng.choice("abZ <>SPM\né日😀1") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    odd += ["a" * (M.BLOCK + d) + "b c" for d in (-2, -1, 0, 1)] + [" " * (M.BLOCK - 1) + "xy z"]  # at the border of two blocks
    return odd


@pytest.mark.parametrize("error", [0, 1, 7, M.ERROR])
def test_index_places_every_boundary(error):
    for t in texts() if error == M.ERROR else texts()[:40]:
        ends = [0]
        for w in TOKEN.findall(t):
            ends.append(ends[-1] + len(w))
        index = M.RankIndex.fit(t, error)
        assert index.n == len(ends) - 1
        assert np.abs(index.residual.astype(int)).max() <= error
        ranks = range(len(ends)) if len(ends) < 3000 else random.Random(1).sample(range(len(ends)), 500) + [0, len(ends) - 1]
        assert [index.place(k) for k in ranks] == [ends[k] for k in ranks]


def test_segments_learn_lines():
    """Evenly spaced boundaries take one line a block, prose far fewer lines than tokens."""
    even = M.RankIndex.fit("abcd " * 10_000)
    assert len(even.first) == 2 and not even.residual[1:].astype(bool).all()
    words = "the of house and a internationally in".split()
    rng = random.Random(2)
    prose = M.RankIndex.fit(" ".join(rng.choice(words) for _ in range(9_000)))
    assert prose.n / len(prose.first) > 100


def test_outputs_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id a b"), (3, None), (4, "x y"), (4, "x y"), (-7, "neg a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("e").alias("n_chars"))
    got = M.fill_in_middle(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(d), *map(str, plain(d, t or "")), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.n_chars == "e" for r in got)


def test_odd_rows_clashing_names_and_empty(spark, odd, empty):
    assert M.fill_in_middle(empty).count() == 0
    out = M.fill_in_middle(odd.withColumn("form", F.lit("x")).withColumn("_llm_draw", F.lit(1)).withColumn("output", F.lit("y")))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_llm_draw", "n", "form", "prefix_chars", "middle_chars", "output", "segments"]
    got = sorted((str(r.doc_id), r.output) for r in out.collect())
    assert got == sorted((str(r[0]), plain(r[0], r[1] or "")[4]) for r in odd_rows())


def test_rates_are_parameters():
    assert M.transform("a b c", 5, plain_from=0)[1] == "plain"
    assert M.transform("a b c", 5, plain_from=100, spm_below=100)[1] == "spm"
    assert M.transform("a b c", 5, plain_from=100, spm_below=0)[1] == "psm"
