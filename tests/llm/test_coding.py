"""Operators 5 and 10: token paths against the public library and the merge procedure; WARC records."""

from __future__ import annotations

import base64
import hashlib
import random
from pathlib import Path

import pytest

from jobacct.llm import sentencepiece_fst as P
from jobacct.llm import warc as W
from jobacct.llm.queries import SENTENCEPIECE_MODEL

ODD = ["", " ", "   a  b ", "Hello  world", "a\nb\t c", "日本語 xyz　z", "ﬁ x\x00y", "a▁b ▁", "é́́ 😀 <s> <0x41> </s>", "\n\n\n", "x" * 3000, "ab" * 500 + " " * 40]


@pytest.fixture(scope="module")
def fst():
    return P.Transducer(Path(SENTENCEPIECE_MODEL).read_bytes())


@pytest.fixture(scope="module")
def library():
    spm = pytest.importorskip("sentencepiece")
    return spm.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)


def test_same_ids_as_the_library(fst, library):
    rng = random.Random(7)
    letters = "abcdefghij éüß日\n\t.,|#0123 ▁"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for t in texts:
        ids = fst.encode(t)
        assert ids == library.encode(t), t
        assert fst.decode(ids) == library.decode(ids) == t.replace(P.SPACE, " "), t


def test_same_ids_on_a_table(spark, fst, library, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = P.encode_decode(docs, P.read_model(spark, SENTENCEPIECE_MODEL), keep=["text"]).collect()
    assert [r.ids for r in rows] == library.encode([r.text for r in rows])
    assert all(r.decoded == r.text for r in rows)


def test_path_is_the_merge_result(fst):
    for w in ("thanedble", "international", "xyzzy", "aaaaaaaaaaaa", "ing"):
        assert [fst.pieces[i] for i in fst.path(P.SPACE + w)] == fst.merged(P.SPACE + w)


def test_tropical_path_of_additive_costs(fst):
    """With costs that add up, the path is the cheapest of all segmentations."""
    costs = dict(fst.cost)
    try:
        rng = random.Random(3)
        fst.cost = {i: rng.random() * len(p) for i, p in fst.pieces.items()}

        def cheapest(s: str) -> float:
            best = [0.0] + [1e18] * len(s)
            for j in range(1, len(s) + 1):
                for i in range(j):
                    k = fst.ids.get(s[i:j])
                    c = fst.cost[k] if k is not None else fst.unk if j == i + 1 and s[i] not in fst.ids else None
                    if c is not None:
                        best[j] = min(best[j], best[i] + c)
            return best[-1]

        for w in ("the", "station", "abcdé日z"):
            got = sum(fst.cost[p] if p >= 0 else fst.unk for _, p in fst.unigram_path(w))
            assert abs(got - cheapest(w)) < 1e-9
    finally:
        fst.cost = costs


# --- models made from the given one, and small ones of each kind --------------------------
def variant(change) -> bytes:
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(Path(SENTENCEPIECE_MODEL).read_bytes())
    change(m, pb)
    return m.SerializeToString()


def add(m, pb, piece: str, score: float, kind: int):
    """The piece, new or in place of the one of that spelling."""
    old = [p for p in m.pieces if p.piece == piece]
    p = old[0] if old else m.pieces.add(piece=piece)
    p.score, p.type = score, kind


def users(m, pb):
    for x in ("<sep>", "<sep>x", "日本", "#01"):
        add(m, pb, x, 0.0, pb.ModelProto.SentencePiece.USER_DEFINED)


def mapped(m, pb):
    import sentencepiece as spm

    own = pb.ModelProto()
    own.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    m.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap


def squeezed(m, pb):
    m.normalizer_spec.remove_extra_whitespaces = True


def no_dummy(m, pb):
    m.normalizer_spec.add_dummy_prefix = False


def no_bytes(m, pb):
    """Byte pieces become ordinary ones that no text holds: unknown characters leave as <unk>."""
    m.trainer_spec.byte_fallback = False
    for p in m.pieces:
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            p.type = pb.ModelProto.SentencePiece.UNUSED


def inner_spaces(m, pb):
    for k, x in enumerate(("▁of▁the", "▁of▁", "▁in▁the", "e▁", "e▁a")):
        add(m, pb, x, -40000.0 - k, pb.ModelProto.SentencePiece.NORMAL)


def unigram(m, pb):
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    rng = random.Random(9)
    for p in m.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -5.0 - 6 * rng.random() - len(p.piece) ** 0.5


@pytest.mark.parametrize(
    "changes",
    [(users,), (mapped,), (squeezed,), (mapped, squeezed), (no_dummy,), (no_bytes,), (inner_spaces,), (mapped, squeezed, users), (unigram,), (unigram, mapped, squeezed)],
    ids=lambda c: "+".join(f.__name__ for f in c),
)
def test_other_models_as_the_library(changes):
    spm = pytest.importorskip("sentencepiece")
    model = variant(lambda m, pb: [f(m, pb) for f in changes])
    lib, fst = spm.SentencePieceProcessor(model_proto=model), P.Transducer(model)
    rng = random.Random(17)
    letters = "abcdeofthn  éüßﬁ½ｱＡ日本x\n\t.,<sep>#01́e"
    texts = [t for t in ODD if "▁" not in t] + ["hello<sep>world <sep>x", "of the in the e a", "  lead and   trail  ", "<sep>", "日本", " <sep> "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert fst.encode(t) == lib.encode(t), (t, [lib.id_to_piece(i) for i in fst.encode(t)], lib.encode(t, out_type=str))


def test_parts_are_cut_where_no_piece_goes_on(fst, library):
    assert "e#" not in fst.inside or "ea" in fst.inside
    for t in ("thebes#é日the", "x" * 500, "éeéeé", "the###the"):
        assert fst.span(P.SPACE + t) == fst.path(P.SPACE + t) == library.encode(t)


def test_worker_keeps_one_machine():
    model = Path(SENTENCEPIECE_MODEL).read_bytes()
    assert P.compiled(model) is P.compiled(bytes(bytearray(model)))


def test_round_trip_is_compared_in_the_task(spark, odd):
    rows = P.encode_decode(odd, P.read_model(spark, SENTENCEPIECE_MODEL), keep=["doc_id"], checked=True).collect()
    assert all(r.round_trip for r in rows) and len(rows) == odd.count()


def test_odd_rows(spark, odd, empty):
    model = P.read_model(spark, SENTENCEPIECE_MODEL)
    out = P.encode_decode(odd, model)
    assert out.columns == [*odd.columns, "ids", "n_ids", "decoded"]
    for r in out.collect():
        assert (r.ids is None) == (r.text is None) and r.decoded == (r.text or "") and r.n_ids == len(r.ids or [])
    assert P.encode_decode(empty, model).count() == 0


# --- WARC -----------------------------------------------------------------------------
PAGE = '<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- x --><p>One <b>two</b><br>three</p><a href="/z">four</a></body></html>'


def test_plain_text():
    assert W.plain_text(PAGE) == "A & B\nOne two\nthree\nfour"
    for junk in ("<" * 50_000, "<!--", "<script>", "a < b > c", ""):
        W.plain_text(junk)
    assert W.plain_text("a < b > c") == "a < b > c"


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def test_records_link_and_write(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", PAGE, 5), (2, None, "été\r\n\r\n<p>x", 5), (3, "http://a/\ny", None, 5), (None, None, None, None)], "page_id long, url string, html string, header int")
    recs = W.derivatives(pages)
    rows = recs.collect()
    assert len(rows) == 8
    for conv, meta in zip(rows[::2], rows[1::2], strict=True):
        src = next(p for p in pages.collect() if p.page_id == conv.page_id)
        response = W.response(src.url, src.html)
        assert conv.record_type == "conversion" and meta.record_type == "metadata"
        assert conv.refers_to == meta.refers_to == response["record_id"]
        assert f"WARC-Refers-To: {response['record_id']}" in conv.header and f"WARC-Concurrent-To: {conv.record_id}" in meta.header
        assert conv.block == W.plain_text(src.html or "") and conv.block_digest == W.digest(conv.block.encode())
        assert conv.source_payload_digest == W.digest((src.html or "").encode()) in meta.block
        assert "source-header: Content-Type: text/html; charset=utf-8" in meta.block
    assert len({r.record_id for r in rows}) == 8 - 2 * 0
    W.write_warc(recs, str(tmp_path / "w"))
    found = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in parse(f.read_bytes())]
    assert sorted(f["WARC-Record-ID"] for f, _ in found) == sorted(r.record_id for r in rows)
    assert all(W.digest(b) == f["WARC-Block-Digest"] for f, b in found)
    assert W.derivatives(pages.limit(0)).count() == 0


def test_given_responses_come_through_unchanged(spark):
    """Ids, dates, heads and digests of a crawl; expected values are written out, not taken from the module."""
    head = "HTTP/1.1 404 Not Found\r\nX-Odd:  two  blanks\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n"
    rows = [
        (1, "http://a/", "<p>caf\u00e9</p>", "<urn:uuid:11111111-2222-3333-4444-555555555555>", "2023-05-06T07:08:09Z", head, "sha1:PAYLOADOFTHECRAWL", "sha1:BLOCKOFTHECRAWL", "x"),
        (2, "http://b/", "<p>x", None, None, None, None, None, None),
        (3, "http://c/", "<p>y\r\n\r\nz", None, "2024-01-01T00:00:00Z", "no status line\nServer: s", None, None, None),
        (4, "http://d/", "w", None, None, "", None, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string, at string, head string, pd string, bd string, block string")
    given = W.Given(record_id="id", date="at", http_head="head", payload_digest="pd", block_digest="bd")
    out = {(r.page_id, r.record_type): r for r in W.derivatives(pages, given=given).collect()}
    assert len(out) == 8
    conv, meta = out[1, "conversion"], out[1, "metadata"]
    for r in (conv, meta):
        assert r.refers_to == rows[0][3] and r.warc_date == rows[0][4] and r.source_payload_digest == rows[0][6]
        assert r.source_headers == head.rstrip("\r\n")
        assert f"WARC-Refers-To: {rows[0][3]}\r\n" in r.header and "WARC-Refers-To-Date: 2023-05-06T07:08:09Z\r\n" in r.header
    assert "WARC-Source-Payload-Digest: sha1:PAYLOADOFTHECRAWL\r\n" in conv.header and conv.block == "caf\u00e9"
    fields = meta.block.split("\r\n")
    assert [f for f in fields if f.startswith("source-")] == [
        f"source-record-id: {rows[0][3]}", "source-block-digest: sha1:BLOCKOFTHECRAWL", "source-payload-digest: sha1:PAYLOADOFTHECRAWL",
        "source-status: HTTP/1.1 404 Not Found", "source-header: X-Odd:  two  blanks", "source-header: Set-Cookie: a=1", "source-header: Set-Cookie: b=2",
        "source-text-digest: sha1:" + base64.b32encode(hashlib.sha1("<p>caf\u00e9</p>".encode()).digest()).decode(),
    ]
    assert out[2, "metadata"].warc_date == "1970-01-01T00:00:00Z" and "source-status: HTTP/1.1 200 OK\r\n" in out[2, "metadata"].block
    assert "source-text-digest" not in out[2, "metadata"].block
    third = out[3, "metadata"].block
    assert "source-status: \r\nsource-header: no status line\r\nsource-header: Server: s\r\n" in third and out[3, "conversion"].block == "y\nz"
    assert out[4, "metadata"].source_headers == "" and "source-header" not in out[4, "metadata"].block
    assert len({r.record_id for r in out.values()}) == 8


def test_very_long_page(spark):
    page = "<p>" + "word " * 2_000_000 + "</p>"
    r = W.derivatives(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).where("record_type = 'conversion'").first()
    assert len(r.block) == len("word " * 2_000_000) - 1
