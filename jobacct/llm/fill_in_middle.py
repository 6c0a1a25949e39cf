"""Operator 12: fill-in-the-middle by a piecewise-linear learned rank index.

A text is n tokens (a run of ASCII letters, or any other single code point) and so
has n + 1 boundaries. The index learns where the k-th one lies: greedy segments,
each the longest whose points all lie within ``ERROR`` of one line (the cone of
slopes that still meet every point narrows until it is empty; the scan is
vectorised over doubling windows). Each boundary's distance from its line is kept
as one signed byte. ``RankIndex.place(k)`` predicts by the line of k's segment and
adds that residual, so it is exact. The index of a text takes a byte a token and
three numbers a segment; boundaries are fitted in blocks of ``BLOCK`` code points,
so what is held beside the text does not grow faster than that.

Cuts are drawn from SHA-256 of ``salt`` and the decimal id: two boundaries, the
form (plain, or prefix-suffix-middle, or suffix-prefix-middle) by the rates given.
``restored`` gives the text back from output and form with SQL functions alone.

Odd inputs: a null text is empty; an empty text and one that holds a marker stay
plain. A null id draws like an empty one. Repeated rows give repeated results.
Extra columns pass when named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # draws out of 100
SALT = "1:"
ERROR = 127  # most that a boundary may lie off its line: a signed byte
BLOCK = 1 << 16  # code points whose boundaries are fitted at a time
WINDOW = 256  # boundaries that a segment is tried over first


def boundaries(text: str) -> Iterator[np.ndarray]:
    """Ends of the tokens in code points, block by block."""
    for at in range(0, len(text), BLOCK):
        x = np.frombuffer(text[at : at + BLOCK + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (x | 32) - np.uint32(97) < 26
        inside = letter[:-1] & letter[1:]
        if at + BLOCK >= len(text):  # the last code point ends a token
            inside = np.append(inside, False)
        yield np.flatnonzero(~inside) + at + 1


def segments(y: np.ndarray, error: int = ERROR) -> Iterator[tuple[int, float, int]]:
    """(first point, slope, points) of greedy segments over the ascending ``y``,
    all points of a segment within ``error`` of the line from its first point."""
    i = 0
    while i < len(y):
        window = WINDOW
        while True:
            dy = y[i + 1 : i + window] - y[i]
            k = np.arange(1, len(dy) + 1)
            low = np.maximum.accumulate((dy - error) / k)
            high = np.minimum.accumulate((dy + error) / k)
            bad = low > high
            n = int(bad.argmax()) if bad.any() else len(dy)
            if n < len(dy) or i + window >= len(y):
                break
            window *= 4
        yield i, (low[n - 1] + high[n - 1]) / 2 if n else 0.0, n + 1
        i += n + 1


@dataclass
class RankIndex:
    """Places of the boundaries 0..n of a text by rank."""

    first: np.ndarray  # rank of each segment's first boundary
    base: np.ndarray  # its place
    slope: np.ndarray
    residual: np.ndarray  # int8 for each boundary

    @classmethod
    def fit(cls, text: str, error: int = ERROR) -> RankIndex:
        first, base, slope, residual, done = [0], [0], [0.0], [np.zeros(1, np.int8)], 1
        for y in boundaries(text):
            for at, s, n in segments(y, error):
                first.append(done + at)
                base.append(int(y[at]))
                slope.append(s)
                residual.append((y[at : at + n] - y[at] - _line(s, np.arange(n))).astype(np.int8))
            done += len(y)
        return cls(np.array(first), np.array(base), np.array(slope), np.concatenate(residual))

    @property
    def n(self) -> int:
        """Tokens of the text."""
        return len(self.residual) - 1

    def place(self, rank: int) -> int:
        """Code points before boundary ``rank``: predicted, then corrected."""
        s = int(self.first.searchsorted(rank, "right")) - 1
        return int(self.base[s] + _line(self.slope[s], rank - self.first[s]) + self.residual[rank])


def _line(slope, steps):
    return np.floor(slope * steps + 0.5).astype(np.int64)


def draws(doc_id: object, salt: str = SALT) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of SHA-256 of the salt and the id."""
    h = hashlib.sha256((salt + ("" if doc_id is None else str(doc_id))).encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str | None, doc_id: object, salt: str = SALT, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple:
    """n, form, code points of prefix and middle (null if plain), output, segments of the index."""
    text = text or ""
    index = RankIndex.fit(text)
    h1, h2, h3, h4 = draws(doc_id, salt)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_from:
        return index.n, "plain", None, None, text, len(index.first)
    a, b = sorted((index.place(h1 % (index.n + 1)), index.place(h2 % (index.n + 1))))
    if h4 % 100 < spm_below:
        form, output = "spm", "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    else:
        form, output = "psm", "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return index.n, form, a, b - a, output, len(index.first)


SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
        T.StructField("segments", T.LongType()),
    ]
)


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, salt: str = SALT, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW
) -> DataFrame:
    """``keep`` columns of ``docs`` (all but the text and those of SCHEMA if not
    named), then those of SCHEMA: one row per row, no shuffle."""
    new = {f.name for f in SCHEMA}
    keep = [c for c in docs.columns if c.lower() not in new and c != text] if keep is None else keep
    inputs = [F.col(text), F.col(doc_id).cast("string")]
    return map_batches(docs, inputs, lambda: lambda t, i: transform(t, i, salt, plain_from, spm_below), SCHEMA, keep)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form."""

    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return rest if right is None else F.substring_index(rest, right, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
