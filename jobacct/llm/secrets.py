"""Operator 1: secret scans with a recursive decoding worklist.

The text itself is scanned first (base spans). Then a worklist of layers is
run to its fixpoint: each layer is unwrapped by every decoder that applies -
URL escapes, Unicode escapes (``\\uXXXX``, ``\\xXX``, ``&#N;``), base64, and
compressed bytes (gzip, zlib, bz2, xz) in base64, URL or ``\\x`` escapes, or
compressed again - and each layer found is scanned and unwrapped again. A layer
whose text and place were seen before is not run again, nor is a stream that is
the same as one above it, which ends cycles (compressed data can unpack to itself).

Every layer maps its characters to places of the root text: an escape to its
own characters, a base64 byte to the characters that carry it, unpacked data to
its whole token. A finding in a layer is reported at those root places.
Unpacked data is read in pieces of PIECE bytes, each scanned like a layer; a
token still open at the end of a piece is carried whole to the next one, so
memory is bounded by the longest token, and nothing is left out.

Kinds, fixed patterns: assign (a name, = or :, and a value of 6 or more
characters), access (AKIA... of 20 or more), hex (24 or more of 0-9a-f). Spans
cover the whole match, in code points, end exclusive.

Odd inputs: null and empty texts have no spans. Overlapping kinds are all
reported. Repeated rows get the same result each; extra columns pass through.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobacct.llm.common import map_batches

# --- fixed values: the patterns of the contract ---------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS = 6, 20

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
#: Valid UTF-8 without control characters, as long as the shortest secret or more.
PLAIN_RUN = re.compile(rb"(?:[\t-\r\x1b\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: Bytes of a token with escapes: % escapes beside what URLs leave, backslash escapes beside printable ASCII.
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!'()*+,./0-9:;=@A-Z\[\]_a-z~$-])+")
HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\U000000[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[\x20-\x5b\x5d-\x7e])+")
URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|[^%]")
HEX_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\U000000[0-9A-Fa-f]{2}|\\.|[^\\]")
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_ESC = r"(?:%|\\x|\\u00|\\U000000)"
#: Magic numbers, escaped as far as they need it.
ESCAPED_MAGIC = re.compile(rf"{_ESC}1f{_ESC}8b|(?:x|{_ESC}78)(?:{_ESC}(?:01|5e|9c|da)|\^)|(?:B|{_ESC}42)(?:Z|{_ESC}5a)(?:h|{_ESC}68)(?:[1-9]|{_ESC}3[1-9])(?:1|{_ESC}31)(?:A|{_ESC}41)|{_ESC}fd(?:7|{_ESC}37)", re.I)
#: The last eight words of a text that is read backwards, of characters that escapes, names and values have.
NEAR = re.compile(r"""(?:[A-Za-z0-9+/_.=%\\&#;:{}"'-]*\x20*){8}""")
#: What may stand between a base64 token and the end of a text in which it goes on.
GOES_ON = re.compile(r"[ \t]*\r?(?:\n[ \t]*[A-Za-z0-9+/_-]*={0,2})?")
PIECE = 4 << 20
_PLAIN = re.compile(r"[^\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]*")

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Spans of one layer, by start, then kind; leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; ``first[i]`` and ``last[i]`` bound the root characters that carry character i."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None, path: str = ""):
        self.text, self.path = text, path
        self.first = np.arange(len(text)) if first is None else first
        self.last = self.first + 1 if last is None else last

    def root(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def replaced(self, edits: list[tuple[int, int, str, list[int]]], path: str) -> Layer:
        """Each edit (start, end, new text, width of what carries each new character) done."""
        texts, firsts, lasts, at = [], [], [], 0
        for start, end, new, widths in edits:
            texts += [self.text[at:start], new]
            firsts.append(self.first[at:start])
            lasts.append(self.last[at:start])
            cuts = np.concatenate([[start], start + np.cumsum(widths)]).astype(int)
            firsts.append(self.first[cuts[:-1]])
            lasts.append(self.last[cuts[1:] - 1])
            at = end
        texts.append(self.text[at:])
        return Layer("".join(texts), np.concatenate([*firsts, self.first[at:]]), np.concatenate([*lasts, self.last[at:]]), self.path + path)


def _whole(text: str, start: int, end: int, path: str) -> Layer:
    """A layer of which every character is carried by the same root characters."""
    return Layer(text, np.broadcast_to(start, len(text)), np.broadcast_to(end, len(text)), path)


def _url(layer: Layer) -> Iterator[Layer]:
    edits = []
    for m in URL.finditer(layer.text):
        new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
        # a character of n bytes took 3 n characters; what is not UTF-8 is counted evenly
        widths = [3 * len(c.encode()) for c in new]
        if sum(widths) != len(m[0]):
            new = bytes.fromhex(m[0].replace("%", "")).decode("latin-1")
            widths = [3] * len(new)
        edits.append((m.start(), m.end(), new, widths))
    if edits:
        yield layer.replaced(edits, "url>")


def _unicode(layer: Layer) -> Iterator[Layer]:
    edits = []
    for m in UNICODE.finditer(layer.text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        new = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        edits.append((m.start(), m.end(), new, [len(m[0])]))
    if edits:
        yield layer.replaced(edits, "unicode>")


def _opened(data: bytes):
    """A decompressor for data that begins like this, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class _Unpack:
    """One compressed stream of one or more members, fed in pieces; ``taken``
    bytes of it were unpacked. ``rest`` tells that some of the bytes fed last
    are not part of the stream."""

    def __init__(self, unpack):
        self.unpack, self.taken, self.rest, self.head = unpack, 0, False, b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        """What ``data`` unpacks to, as far as it does, in pieces of PIECE bytes at most."""
        self.rest = not self.unpack
        while self.unpack:
            if self.unpack.eof:  # another member, after the zeros that may fill a block
                size = len(self.head + data)
                data = (self.head + data).lstrip(b"\0")
                again = _opened(data)
                self.taken += size - len(data) if again else 0
                self.head = data if again is None and _begins(data) else b""
                self.rest = again is None and bool(data) and not self.head
                if again is None:
                    self.unpack = None if self.rest else self.unpack
                    return
                self.unpack = again
            packer = not hasattr(self.unpack, "needs_input")  # zlib
            try:
                piece = self.unpack.decompress(data, PIECE)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                self.unpack, self.rest = None, True
                return
            left = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail if packer else b""
            self.taken += len(data) - len(left)
            data = left
            if piece:
                yield piece
            elif not left and not self.unpack.eof and (packer or self.unpack.needs_input):
                return


def _begins(data: bytes) -> bool:
    """Whether ``data``, too short for a magic, may be the start of one."""
    return any(m.startswith(data) for m in (b"\x1f\x8b", b"x\x01\0", b"x\x5e\0", b"x\x9c\0", b"x\xda\0", b"BZh", b"\xfd7zXZ\x00"))


def _levels(data: bytes, most: float = float("inf")) -> Iterator[tuple[int, bytes]]:
    """(level, piece) of the streams in ``data``: level 1 is what it unpacks to,
    level 2 what that unpacks to, and so on to ``most``. Bytes that unpack are
    not given themselves below ``most``; a stream that is the same as one above
    it is not unpacked again."""
    stages: list[_Unpack | None] = []
    heads: list[bytes] = []  # first bytes of each level
    todo = [iter((data,))]
    fed: list[bytes] = []  # what each level was fed last
    while todo:
        piece, at = next(todo[-1], None), len(todo) - 1
        if piece is None:
            todo.pop()
            if at:
                rest = fed.pop()
                if at > 1 and stages[at - 1].rest:
                    yield at - 1, rest
            continue
        if at == len(stages):
            if at == len(heads):
                heads.append(b"")
            new, heads[at] = piece, heads[at] + piece
            piece = heads[at]
            if len(piece) < 6:  # too short to tell
                if at:
                    yield at, new
                continue
            unpack = _opened(piece) if at < most else None
            if unpack and any((heads[i].startswith(piece) or piece.startswith(heads[i])) and _digest(data, i) == _digest(data, at) for i in range(at)):
                unpack = None
            stages.append(_Unpack(unpack) if unpack else None)
            if not unpack and at:
                yield at, new
        elif not stages[at] and at:
            yield at, piece
        if stages[at]:
            todo.append(stages[at].feed(piece))
            fed.append(piece)


def _digest(data: bytes, level: int) -> bytes:
    h = hashlib.blake2b(b"" if level else data)
    for at, piece in _levels(data, level) if level else ():
        if at == level:
            h.update(piece)
    return h.digest()


def _taken(data: bytes) -> int:
    """Length of the compressed stream at the start of ``data``; 0 if it does not unpack."""
    stage = _Unpack(_opened(data))
    some = False
    for _ in stage.feed(data):
        some = True
    return stage.taken if some else 0


class _Pieces:
    """Text of a stream in pieces of PIECE characters or more; each ends where
    nothing that a decoder or a pattern takes as one is open."""

    def __init__(self):
        self.decode, self.parts, self.size, self.due = codecs.getincrementaldecoder("utf-8")("replace").decode, [], 0, PIECE

    def add(self, data: bytes, final: bool = False) -> str:
        self.parts.append(self.decode(data, final))
        self.size += len(self.parts[-1])
        if not final and self.size < self.due:
            return ""
        text = "".join(self.parts)
        cut = len(text) if final else _closed(text)
        self.parts, self.size = [text[cut:]], len(text) - cut
        self.due = max(PIECE, 2 * self.size)  # an open token is looked at again when it has doubled
        return text[:cut]


def _closed(text: str) -> int:
    """Where the tail of ``text`` that may go on begins: eight words, and the tokens that reach it or the end."""
    cut = len(text) - NEAR.match(text[::-1]).end()
    for m in BASE64.finditer(text):
        if m.end() > cut > m.start() or (m.start() < cut and GOES_ON.fullmatch(text, m.end())):
            cut = m.start()
    for token in (URL_BYTES, HEX_BYTES):
        cut = min([cut, *(m.start() for m in _escaped(text, token) if m.end() >= cut)])
    return cut


def _texts(data: bytes) -> Iterator[tuple[int, str]]:
    """(level, text) of the streams in ``data``, in pieces."""
    levels: dict[int, _Pieces] = {}
    for at, piece in _levels(data):
        text = levels.setdefault(at, _Pieces()).add(piece)
        if text:
            yield at, text
    for at, pieces in levels.items():
        yield at, pieces.add(b"", True)


def _escaped(text: str, token: re.Pattern) -> Iterator[re.Match]:
    """Tokens of bytes with escapes, each from its first magic number on."""
    past = 0
    for m in ESCAPED_MAGIC.finditer(text) if ("%" if token is URL_BYTES else "\\") in text else ():
        if m.start() >= past and (run := token.match(text, m.start())):
            past = run.end()
            yield run


def _packed(layer: Layer) -> Iterator[Layer]:
    """Compressed bytes written as URL or ``\\x`` escapes; what needs no escape may stand as it is."""
    for name, token, byte in (("url>", URL_BYTES, URL_BYTE), ("unicode>", HEX_BYTES, HEX_BYTE)):
        for m in _escaped(layer.text, token):
            at = [(m.start() + x.start(), m.start() + x.end()) for x in byte.finditer(m[0])]
            written = [layer.text[a:b] for a, b in at]
            data = bytes(map(_byte, written))
            # in forms a plus sign that is not escaped is a blank
            forms = {data, bytes(32 if w == "+" else c for w, c in zip(written, data, strict=True))} if name == "url>" else {data}
            for data in sorted(forms):
                for x in MAGIC.finditer(data):
                    size = _taken(data[x.start() :])
                    if size:
                        start, end = layer.root(at[x.start()][0], at[x.start() + size - 1][1])
                        for level, text in _texts(data[x.start() : x.start() + size]):
                            yield _whole(text, start, end, layer.path + name + "unpack>" * level)


def _byte(x: str) -> int:
    if len(x) == 1:
        return ord(x)
    if x[0] == "%" or x[1] in "xuU":
        return int(x[-2:], 16)
    return "abtnvfr".find(x[1]) + 7 if x[1] in "abtnvfr" else 0 if x[1] == "0" else ord(x[1])


def _decoded(token: str) -> bytes:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        lines = [(m.start() + x.start(), x[0]) for x in re.finditer(r"[^ \t\r\n]+", m[0])]
        # the last line, of any length, may be a word after the token
        for run in [lines, lines[:-1]] if len(lines) > 1 else [lines]:
            found = list(_of_token(layer, run))
            yield from found
            if found:
                break
        else:
            whole = len(lines) > 1
            for line in lines if whole else ():
                found = list(_of_token(layer, [line]))
                yield from found
                whole = whole and bool(found)
            if not whole:
                yield from _glued(layer, lines)


def _places(run: list[tuple[int, str]]) -> np.ndarray:
    return np.concatenate([np.arange(s, s + len(t)) for s, t in run])  # characters of the token in the layer


def _plain(layer: Layer, text: str, at: np.ndarray, skipped: int = 0) -> Layer:
    """``text``, decoded from the characters ``at`` of the layer after ``skipped`` other bytes."""
    ends = skipped + np.cumsum([len(c.encode()) for c in text])
    begins = np.concatenate([[skipped], ends[:-1]])
    first, last = at[begins * 8 // 6], at[(ends * 8 + 5) // 6 - 1]
    return Layer(text, layer.first[first], layer.last[last], layer.path + "base64>")


def _of_token(layer: Layer, run: list[tuple[int, str]]) -> Iterator[Layer]:
    data = _decoded("".join(t for _, t in run))
    start, end = layer.root(run[0][0], run[-1][0] + len(run[-1][1]))
    for at, text in _texts(data):
        yield _whole(text, start, end, layer.path + "base64>" + "unpack>" * at)
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return
    if not text or not _PLAIN.fullmatch(text):
        return
    yield _plain(layer, text, _places(run))


def _glued(layer: Layer, run: list[tuple[int, str]]) -> Iterator[Layer]:
    """Base64 that begins or ends somewhere in a run of its alphabet: plain text
    and compressed streams at any byte of its four phases."""
    token, at = "".join(t for _, t in run), None
    for phase in range(4):
        data = _decoded(token[phase:])
        for m in PLAIN_RUN.finditer(data):
            at = _places(run) if at is None else at
            try:
                text = m[0].decode("utf-8")
            except UnicodeDecodeError:  # what the pattern takes for UTF-8 beyond Unicode, or surrogates
                continue
            yield _plain(layer, text, at[phase:], m.start())
        for m in MAGIC.finditer(data):
            size = _taken(data[m.start() :])
            if size:
                at = _places(run) if at is None else at
                first = at[phase + m.start() * 8 // 6]
                last = at[phase + ((m.start() + size) * 8 + 5) // 6 - 1]
                start, end = layer.root(int(first), int(last) + 1)
                for level, text in _texts(data[m.start() : m.start() + size]):
                    yield _whole(text, start, end, layer.path + "base64>" + "unpack>" * level)


def unwrapped(text: str) -> Iterator[Layer]:
    """All layers under ``text``: the worklist, run to its fixpoint."""
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return
    work, seen = [_decodings(Layer(text))], set()
    while work:
        some, size = [], 0
        for new in work[-1]:
            name = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(new.first[0]) if len(new.first) else 0)
            if name not in seen and new.text:
                seen.add(name)
                yield new
                some.append(_decodings(new))
                size += len(new.text)
                if size > PIECE:  # large layers are unwrapped before the next ones are made, so few are held
                    break
        else:
            work.pop()
        work += some


def _decodings(layer: Layer) -> Iterator[Layer]:
    for decode in (_url, _unicode, _packed, _base64):
        yield from decode(layer)


def find(text: str | None) -> tuple[list[Span], list[Span], list[str]]:
    """Base spans; all spans; the layers that gave the added ones."""
    if not text:
        return [], [], []
    base = scan(text)
    found, via = set(base), []
    for layer in unwrapped(text):
        for start, kind, end in scan(layer.text):
            a, b = layer.root(start, end)
            if (a, kind, b) not in found:
                found.add((a, kind, b))
                via.append(f"{layer.path}{KINDS[kind]}:{a}:{b}")
    return base, sorted(found), sorted(via)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each run of overlapping spans replaced by [kind]."""
    runs: list[list[int]] = []
    for a, k, b in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([a, k, b])
    cuts = [0, *(x for a, _, b in runs for x in (a, b)), len(text)]
    keep = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return "".join(t + (f"[{KINDS[runs[i][1]]}]" if i < len(runs) else "") for i, t in enumerate(keep))


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "layers", "redacted")]
)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, base counts and digest, all spans, the layers of the
    added ones, the redacted text (null for null): one row per row."""

    def run():
        def one(t):
            base, every, via = find(t)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), ",".join(via), t if not every else redacted(t, every))

        return one

    return map_batches(docs, text, run, SCHEMA, keep)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in the text replaced (n_chars follows where the text changed)."""
    from pyspark.sql import functions as F

    held = docs.select(*(F.col(c).alias(f"_doc{i}") for i, c in enumerate(docs.columns)), F.col("text").alias("_llm_in"))
    found = find_secrets(held, "_llm_in", held.columns[:-1])
    out = []
    for i, c in enumerate(docs.columns):
        own = F.col(f"_doc{i}")
        if c == "text":
            own = F.col("redacted")
        elif c == "n_chars":
            own = F.when(F.col("spans") == "", own).otherwise(F.length("redacted")).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return found.select(*out)
