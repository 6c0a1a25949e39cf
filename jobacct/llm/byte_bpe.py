"""Operator 13: byte-level BPE encoding and decoding through a SentencePiece model.

``serialise`` writes a SentencePiece BPE model straight from a rank file: each
token's bytes become the characters U+0100 + byte, its score is minus its rank,
nothing is normalised (no dummy prefix, no escaped or removed spaces). The model's
merge rule, best-scored neighbouring pair first and leftmost among equals, is
then the rule of the ranks. Texts are split by the pre-token pattern; a pre-token that is
a token as a whole is that token, every other one goes through the model. Piece 0
is the unknown piece (never met: all 256 bytes have pieces), so a token's place
among the ids in rank order is its piece less one.

Decoding maps each piece's characters back to bytes and joins them.

The model is made once on the driver (its size is the vocabulary's, whatever the
corpus) and loaded once a Python worker, where pre-tokens already encoded are
remembered in two generations of ``CACHE`` entries; long ones are not remembered.
The new pre-tokens of some texts go to the model in one call. One row per row, no shuffle.

Odd inputs: a null text is empty and has no ids; decoded bytes are then empty.
Control characters, U+2581 and any other code points are bytes like the rest.
Lone surrogates cannot be in a Spark string. Repeated rows and extra columns
pass through; an empty table gives no rows. A rank file that lacks a byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobacct.llm.common import map_batches

FIRST = 0x100  # byte b is the character chr(FIRST + b)
CACHE = 300_000  # pre-tokens in each of two generations
GROUP = 1 << 20  # code points of the texts whose new pre-tokens are learnt together
LONG = 48  # code points of a pre-token that is not remembered


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def chars_of(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def bytes_of(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A SentencePiece BPE model with a piece for every token, in rank order after the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the ranks lack the bytes {missing}")
    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        m.pieces.add(piece=chars_of(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.byte_fallback = False
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return m.SerializeToString()


class Coder:
    """A loaded model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes, ids: list[int], pattern: str):
        """``ids``: the rank of every piece but the first, in the model's order."""
        import sentencepiece as spm

        self.model = spm.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        pieces = [bytes_of(self.model.id_to_piece(i)) for i in range(1, self.model.get_piece_size())]
        self.ranks = [-1, *ids]
        self.whole = {p.decode(): r for p, r in zip(pieces, ids, strict=True) if _is_text(p)}
        self.bytes = dict(zip(ids, pieces, strict=True))
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.chars = [chr(FIRST + b) for b in range(256)]

    def learn(self, pretokens: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens, those not known through one call of the model."""
        out: dict[str, list[int]] = {}
        new = []
        for p in pretokens:
            if (ids := self.older.get(p)) is not None:
                out[p] = ids
            elif (rank := self.whole.get(p)) is not None:
                out[p] = [rank]
            else:
                new.append(p)
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars) for p in new]
        ranks = self.ranks
        for p, pieces in zip(new, self.model.encode(mapped, out_type=int, num_threads=1) if new else (), strict=True):
            out[p] = [ranks[i] for i in pieces]
        for p, ids in out.items():
            if len(p) <= LONG:
                if len(self.known) >= CACHE:
                    self.older, self.known = self.known, {}
                self.known[p] = ids
        return out

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; about ``GROUP`` code points are held as pre-tokens at a time."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= GROUP:
                size, end = size + len(texts[end]), end + 1
            yield from self._group(texts[at:end])
            at = end

    def _group(self, texts: list[str]) -> Iterator[list[int]]:
        """What none of the texts knows goes to the model in one call."""
        split = list(map(self.split, texts))
        known = self.known
        new = {p for pretokens in split for p in pretokens if p not in known}
        learnt = self.learn(list(new)) if new else {}
        for pretokens in split:
            found = list(map(self.known.get, pretokens))
            if None in found:  # long, or pushed into the older generation meanwhile
                found = [self._of(p, learnt) if ids is None else ids for p, ids in zip(pretokens, found, strict=True)]
            yield list(chain.from_iterable(found))

    def _of(self, p: str, learnt: dict[str, list[int]]) -> list[int]:
        ids = learnt.get(p) or self.older.get(p)
        return ids if ids is not None else self.learn([p])[p]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_LOADED: dict[bytes, Coder] = {}  # coders of this Python worker by model and pattern


def coder(model: bytes, ids: list[int], pattern: str) -> Coder:
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Coder(model, ids, pattern)
    return _LOADED[key]


SCHEMA = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs``, then ids, their number and the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast((serialise(ranks), sorted(ranks.values())))  # a few MB, the vocabulary's size

    def make():
        c = coder(*shared.value, pattern)

        def rows(texts):
            return [(ids, len(ids), c.decode(ids)) for ids in c.encode_many([t or "" for t in texts])]

        return rows

    return map_batches(docs, text, make, SCHEMA, keep, many=True)
