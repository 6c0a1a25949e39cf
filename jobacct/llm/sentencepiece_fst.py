"""Operator 5: SentencePiece encoding and decoding as a weighted transducer.

Machines are compiled from a model file and composed with each text:

* **Normaliser** N: the model's character map as a longest-match transducer over
  UTF-8 bytes, then its space rules (runs to one, ends off, dummy prefix, a space
  to U+2581), as far as the model has them.
* **User pieces** U: user-defined pieces leave as they stand, longest first; they
  are neither normalised nor joined to a neighbour.
* **Pieces** P: a trie of the normal pieces, one arc per character, leaving
  with the piece id. A piece costs minus its score in a unigram model.
* **Byte fallback** B: a character no piece starts on its own leaves with its
  UTF-8 bytes' pieces; without byte pieces, a run of such characters leaves as the
  unknown piece.

For a unigram model the encoding is the tropical shortest path of
``text . N . (U | P | B)*``. A BPE model has no additive score: there the lattice is
composed with one more acceptor C over neighbouring pieces, of weight 0 where
the merges of ``left + right`` end in exactly (left, right) and infinity
otherwise. The one path of finite weight is the BPE encoding (the tests hold it
against the merge procedure and the public library on whole tables).

The lattice falls apart between two neighbouring characters that stand side by
side in no piece (an arc over both would be one): paths are found between such
places and kept in bounded caches of the Python worker, as are those of whole words
where no piece holds U+2581 after another character. Work per text is linear in
its length times the longest piece; nothing is cut.

Results for odd inputs: null text gives null ids, an empty text gives no ids;
both decode to ''. U+2581 in a text decodes to a space, as in the public library.
Repeated rows, null ids of rows and extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobacct.llm.common import map_batches

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHE = 200_000  # chunks in each of two generations that a worker remembers unless told otherwise; of parts half, of windows a quarter, of pairs twice as many
WINDOW = 5  # characters whose arcs are remembered together


class CharMap:
    """The model's character map: a double-array trie over bytes whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.first = frozenset(b for b in range(256) if self._step(self._on(0, self.units[0]), b) is not None) if self.units else frozenset()

    @staticmethod
    def _on(at: int, unit: int) -> int:
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _step(self, at: int, byte: int) -> tuple[int, int] | None:
        """(place below, its unit) of the child by ``byte``."""
        k = at ^ byte
        if k >= len(self.units) or self.units[k] & 0x800000FF != byte:
            return None
        return self._on(k, self.units[k]), self.units[k]

    def apply(self, text: str) -> str:
        data, out, i = text.encode("utf-8", "surrogatepass"), [], 0
        if not self.first or self.first.isdisjoint(data):
            return text
        while i < len(data):
            at, end, found = self._on(0, self.units[0]), i, None
            for j in range(i, len(data)):
                if (step := self._step(at, data[j])) is None:
                    break
                at, unit = step
                if unit >> 8 & 1:  # a rule ends here
                    end, found = j + 1, self.units[at] & 0x7FFFFFFF
            if found is None:
                end = i + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                out.append(data[i:end])
            else:
                out.append(self.texts[found : self.texts.index(0, found)])
            i = end
        return b"".join(out).decode("utf-8", "surrogatepass")


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes, cache: int = CACHE):
        """``cache`` bounds what is remembered; results do not depend on it."""
        import sentencepiece as spm

        m, self.cache = _read_model(spm, model), cache
        self.pieces, self.cost, self.byte_id, self.user, self.bpe, self.unk, self.unk_id = m.pieces, m.cost, m.byte_id, m.user, m.bpe, m.unk, m.unk_id
        self.dummy, self.squeeze, self.escape, self.map = m.dummy, m.squeeze, m.escape, CharMap(m.charsmap) if m.charsmap else None
        self.ids = {p: i for i, p in self.pieces.items()}
        self.trie: dict[str, list] = {}  # character -> [arcs on, piece that ends here or -1]
        for p, i in self.ids.items():
            on = self.trie
            for ch in p[:-1]:
                on = on.setdefault(ch, [{}, -1])[0]
            on.setdefault(p[-1], [{}, -1])[1] = i
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}  # neighbours within some piece
        # single spaces separate words if no piece goes on after one, and the text's spaces are kept as they are
        self.by_words = self.dummy and self.escape and not self.squeeze and not self.map and not self.user and bool(self.byte_id) and not any(x[1] == SPACE != x[0] for x in self.inside)
        self.users = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        self.paths: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, list[int]] = {}
        self.windows: dict[str, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.spelling = {i: p.replace(SPACE, " ").encode() for i, p in [*self.pieces.items(), *((i, p) for p, i in self.user.items())]}
        self.spelling |= {i: bytes([b]) for b, i in self.byte_id.items()} | {self.unk_id: m.unk_surface.encode()}

    # -- acceptor C -------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """The model's merges on a short string: always the best-scored
        neighbouring pair whose union is a piece, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            cost, at = min(
                ((self.cost[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None),
                default=(math.inf, -1),
            )
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def meets(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` on a BPE path; a byte-coded
        character (id below 0) never merges with a neighbour."""
        if left < 0 or right < 0:
            return True
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.pairs) >= 2 * self.cache:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(a + b) == [a, b]
        return ok

    # -- composition and shortest path ------------------------------------------
    def arcs(self, chunk: str, i: int) -> tuple[tuple[int, int], ...]:
        """Arcs of the lattice from position i: (characters, piece), the longest
        first; -1 is the bytes of one character."""
        window = chunk[i : i + WINDOW]
        known = self.windows.get(window)
        if known is None:
            out, on, more = [], self.trie, None
            for j, ch in enumerate(window, 1):
                if (arc := on.get(ch)) is None:
                    on = None
                    break
                on, piece = arc
                if piece >= 0:
                    out.append((j, piece))
            if not out or out[0][0] != 1:
                out.insert(0, (1, -1))
            if on and len(window) == WINDOW:
                more = on
            if len(self.windows) >= self.cache // 4:
                self.windows.clear()
            known = self.windows[window] = (tuple(out[::-1]), more)
        arcs, on = known
        if on is None:
            return arcs
        out = []  # pieces that go on beyond the window
        for j in range(i + WINDOW, len(chunk)):
            if (arc := on.get(chunk[j])) is None:
                break
            on, piece = arc
            if piece >= 0:
                out.append((j + 1 - i, piece))
        return (*out[::-1], *arcs) if out else arcs

    def bpe_path(self, chunk: str) -> list[tuple[int, int]]:
        """The path of finite weight. All paths of finite weight into a
        position are one and the same, so a position with no way on is dead
        for good: depth first, longest arc first, each position once."""
        n, dead, taken, pairs = len(chunk), set(), [], self.pairs
        at, left = 0, -1
        todo = [iter(self.arcs(chunk, 0))]
        while True:
            for length, piece in todo[-1]:
                j = at + length
                if j in dead:
                    continue
                ok = pairs.get(left << 20 | piece) if left >= 0 <= piece else True
                if ok or ok is None and self.meets(left, piece):
                    taken.append((j, piece))
                    if j == n:
                        return taken
                    at, left = j, piece
                    todo.append(iter(self.arcs(chunk, j)))
                    break
            else:
                dead.add(taken.pop()[0])
                todo.pop()
                at, left = taken[-1] if taken else (0, -1)

    def unigram_path(self, chunk: str) -> list[tuple[int, int]]:
        """Tropical shortest path; ties go to the arc found first."""
        n = len(chunk)
        best: list[float] = [0.0] + [math.inf] * n
        into: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            for length, piece in reversed(self.arcs(chunk, i)):
                d = best[i] + (self.cost[piece] if piece >= 0 else self.unk)
                if d < best[i + length]:
                    best[i + length], into[i + length] = d, (i, piece)
        taken, j = [], n
        while j:
            taken.append((j, into[j][1]))
            j = into[j][0]
        return taken[::-1]

    def path(self, part: str) -> list[int]:
        """Ids of the shortest path of one part, byte fallback spelt out."""
        out: list[int] = []
        for j, piece in self.bpe_path(part) if self.bpe else self.unigram_path(part):
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out += [self.byte_id[b] for b in part[j - 1].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk_id)
        return out

    def span(self, text: str) -> list[int]:
        """Ids of a normalised text, or of a part of one that ends where no piece goes on."""
        out, inside, start = [], self.inside, 0
        for i in range(1, len(text) + 1):
            if i < len(text) and text[i - 1 : i + 1] in inside:
                continue
            part = text[start:i]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.path(part)
                if i - start <= 32:
                    if len(self.parts) >= self.cache // 2:
                        self.parts.clear()
                    self.parts[part] = ids
            out += ids
            start = i
        return out

    def known(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk through the cache: two generations, the older one
        dropped when the younger is full. A chunk without U+2581 stands
        between single spaces and stands for U+2581 + chunk."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = tuple(self.span(chunk if chunk[:1] == SPACE else SPACE + chunk))
        if len(chunk) <= 64:
            if len(self.paths) >= self.cache:
                self.older, self.paths = self.paths, {}
            self.paths[chunk] = ids
        return ids

    def normalised(self, text: str) -> list[tuple[str, bool]]:
        """N: pieces of the normalised text, and whether each is a user piece."""
        cut = self.users.split(text) if self.users else [text]
        out = [(x if k % 2 or not self.map else self.map.apply(x), bool(k % 2)) for k, x in enumerate(cut) if x]
        if self.squeeze:
            kept: list[tuple[str, bool]] = []
            for x, user in out:
                if not user:
                    x = re.sub(" +", " ", x)
                    if not kept or (kept[-1][0][-1] == " "):
                        x = x.lstrip(" ")
                if x:
                    kept.append((x, user))
            while kept and not kept[-1][1] and kept[-1][0][-1] == " ":
                x = kept.pop()[0].rstrip(" ")
                if x:
                    kept.append((x, False))
            out = kept
        if self.dummy and out:
            out = [(" " + out[0][0], False), *out[1:]] if not out[0][1] else [(" ", False), *out]
        return [(x if user or not self.escape else x.replace(" ", SPACE), user) for x, user in out]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_words:
            return self.encode_spans(text)
        chunks = text.split(" ")
        if "" in chunks or SPACE in text:  # runs of spaces belong to one chunk
            chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.paths.get, chunks))
        if None in found:
            found = [self.paths.get(c) or self.known(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return list(chain.from_iterable(found))

    def encode_spans(self, text: str) -> list[int]:
        """Any model: whole normalised spans between user pieces."""
        out: list[int] = []
        for x, user in self.normalised(text):
            if user:
                out.append(self.user[x])
            else:
                ids = self.span(x)
                if not self.byte_id:  # neighbouring unknown characters are one piece
                    ids = [i for k, i in enumerate(ids) if i != self.unk_id or k == 0 or ids[k - 1] != i]
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: pieces to UTF-8, byte pieces to bytes, the dummy prefix off."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


class _Model:
    """What is compiled of a model file."""


def _read_model(spm, model: bytes) -> _Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, out = pb.ModelProto(), _Model()
    m.ParseFromString(model)
    n, t = m.normalizer_spec, m.trainer_spec
    if t.model_type not in (1, 2) or t.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with spaces before words are compiled")
    sp = spm.SentencePieceProcessor(model_proto=model)
    out.pieces, out.cost, out.byte_id, out.user = {}, {}, {}, {}
    for i, p in enumerate(m.pieces):
        if sp.is_byte(i):
            out.byte_id[int(p.piece[3:5], 16)] = i
        elif p.type == pb.ModelProto.SentencePiece.USER_DEFINED:
            out.user[p.piece] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            out.pieces[i], out.cost[i] = p.piece, -p.score
    out.bpe, out.unk, out.unk_id, out.unk_surface = t.model_type == 2, max(out.cost.values(), default=0.0) + 10.0, sp.unk_id(), t.unk_surface
    out.charsmap, out.dummy, out.squeeze, out.escape = n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
    return out


_COMPILED: dict[bytes, Transducer] = {}  # of this Python worker, by the digest of model and cache size


def compiled(model: bytes, cache: int = CACHE) -> Transducer:
    """The machine of a model, compiled once a worker; its caches outlive tasks."""
    key = hashlib.sha256(b"%d:" % cache + model).digest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model, cache)
    return _COMPILED[key]


SCHEMA = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)
CHECKED = T.StructType([*SCHEMA.fields[:2], T.StructField("round_trip", T.BooleanType())])


def read_model(spark, path: str) -> bytes:
    """The model file (about 0.5 MB, the same for any corpus) through Spark's reader."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, checked: bool = False, cache: int = CACHE) -> DataFrame:
    """``keep`` columns of ``docs``, then ids, n_ids and the text decoded from
    them, or (``checked``) whether that is the text, compared in the task. A
    Python worker keeps about 1 kB for each of ``cache`` entries, also after the
    job: choose it by the executors' memory."""

    def run() -> Iterator:
        fst = compiled(model, cache)

        def one(t):
            if t is None:
                return None, 0, True if checked else ""
            ids = fst.encode(t)
            back = fst.decode(ids)
            return ids, len(ids), back == t if checked else back

        return one

    return map_batches(docs, text, run, CHECKED if checked else SCHEMA, keep)
