"""Operator 13 against the tiktoken library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from jobacct.llm import byte_bpe as B
from jobacct.llm.queries import BYTE_BPE_RANKS, op13_byte_bpe

from tests.llm.conftest import odd_rows

tiktoken = pytest.importorskip("tiktoken")


def load(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return B.read_ranks(f.read())


def pair(ranks: dict[bytes, int]):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return B.Coder(B.serialise(ranks), sorted(ranks.values()), public_tokenizers.PATTERN), lib


@pytest.fixture(scope="module")
def ranks():
    return load(BYTE_BPE_RANKS)


@pytest.fixture(scope="module")
def both(ranks):
    return pair(ranks)


def texts(seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    odd = ["", " ", "  a   b ", "'s it's I'LL 'll", "a\nb\t c\r\n\r\n x", "▁a▁ b", "日本語 xyz　z", "ﬁ\x00\x1c\x85 y", "é́ 😀👩‍👩‍👧 ½ ²³", "<|endoftext|> <unk>", "x" * 3000, "ab" * 900 + " " * 300, "  　 \xa0"]
    letters = "abcdefghijklmnopqrstuvwxyz ETAé ßñ日本語가나\n\t.,'s123  -_#😀́"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(1500)]


@pytest.mark.parametrize("name", [BYTE_BPE_RANKS, "byte_bpe_50k.tiktoken"])
def test_same_ids_as_the_library(name):
    coder, lib = pair(load(name))
    for t in texts():
        ids = coder.encode(t)
        assert ids == lib.encode_ordinary(t), t
        assert coder.decode(ids) == lib.decode_bytes(ids) == t.encode()


def test_every_code_point(both):
    coder, lib = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):
        t = "".join(f"a{chr(c)}{chr(c)} {chr(c)}1" for c in points[at : at + 997])
        assert coder.encode(t) == lib.encode_ordinary(t)


def test_every_token_decodes(both, ranks):
    coder, lib = both
    assert all(coder.decode([i]) == t == lib.decode_single_token_bytes(i) for t, i in ranks.items())


def test_ranks_with_gaps_and_tokens_no_merge_reaches():
    """Ids are the ranks, whatever their numbers; a pre-token that is a token needs no merges."""
    ranks = {bytes([b]): 10 + 2 * b for b in range(256)} | {b"ab": 600, b"bc": 601, b"cd": 602, b"abcde": 700, b" x": 800}
    coder, lib = pair(ranks)
    for t in ("abc", "abcd", "abcde", "abcdeabcde", " x xx", "ababcd bcdbcd", "é"):
        assert coder.encode(t) == lib.encode_ordinary(t), t


def test_cache_generations(both, monkeypatch):
    coder, lib = both
    monkeypatch.setattr(B, "CACHE", 7)
    for t in texts(3)[:300]:
        assert coder.encode(t) == lib.encode_ordinary(t)
    assert len(coder.known) <= 7 + 200


def test_missing_byte_is_refused():
    with pytest.raises(ValueError, match="lack the bytes"):
        B.serialise({b"a": 0})


def test_table(spark, ranks, both, odd, empty, sf_small):
    out = B.encode_decode(odd.withColumn("ids", F.lit(1)).withColumn("_llm", F.lit(2)), ranks, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_llm", "ids", "n_tokens", "decoded"]
    lib = both[1]
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r.ids == lib.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.text or "").encode()
    assert B.encode_decode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_query(spark, both, sf_small):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, sf_small).collect():
        ids = both[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
