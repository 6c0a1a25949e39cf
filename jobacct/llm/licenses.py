"""Operator 4: licence scans by an exact set-containment join.

Templates (short licence notices, below) are joined to paragraphs (runs of
non-blank lines, so hard-wrapped notices are one block). A paragraph matches a
template if some window of its words, a quarter longer than the template at
most, holds

* THRESHOLD per cent of the template's distinct tokens, all of them if it has
  fewer than SHORT, and
* every telling token: one that the template has, and another template that
  covers it to the threshold has not (ShareAlike, Lesser).

The join is exact and runs on filters, as for set-similarity joins:

* Tokens are ordered by their frequency over all documents, rarest first
  (one grouped count over the corpus, of template tokens only).
* Prefix: of a template with n tokens that must share c, a match holds one of
  its first n - c + 1 tokens; only those are indexed.
* Length: a block needs c distinct template tokens at least.
* Position: with the template's first i tokens looked up, a block stays only
  while matches so far plus tokens left can reach c.
* Windows are counted for what the filters leave, over places of the template's
  own tokens.

Templates are part of the program, so what a task holds does not grow with the
corpus; of a text it holds the places of template tokens in one paragraph.

Odd inputs: null and word-free texts have no words, no labels, score 0. Ties
need no order (all matches are reported). Repeated rows get the same result
each; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict, deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobacct.llm.common import SLICE, byte_words, map_batches

THRESHOLD = 80  # per cent of a template's distinct tokens
SHORT = 9  # a template of fewer distinct tokens must be there in whole

# --- fixed values: base phrases and their labels ----------------------------------------
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# --- fixed values: licence notices ------------------------------------------------------
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit-release": "Released under the MIT License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
}


def template_tokens(templates: dict[str, str]) -> dict[str, set[bytes]]:
    return {name: set(byte_words(t)) for name, t in templates.items()}


def token_counts(docs: DataFrame, tokens: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each template token stands in the corpus: partial counts per
    task, summed by token; as many rows come back as templates have tokens."""

    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for t in batch.slice(at, SLICE).column(0).to_pylist():
                    n.update(w for w in byte_words(t) if w in tokens)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    parts = docs.select(text).mapInArrow(run, "token binary, n bigint")
    return {bytes(r[0]): r[1] for r in parts.groupBy("token").agg(F.sum("n")).collect()}


def needed(n: int, threshold: int = THRESHOLD) -> int:
    """How many of n distinct tokens a match holds."""
    return n if n < SHORT else -(-threshold * n // 100)


def telling(templates: dict[str, set[bytes]], threshold: int = THRESHOLD) -> dict[str, set[bytes]]:
    """Tokens of each template that it must have to be told from others that cover it to the threshold."""
    out: dict[str, set[bytes]] = {}
    for name, t in templates.items():
        near = (u for u in templates.values() if len(t & u) >= needed(len(t), threshold))
        out[name] = set().union(*(t - u for u in near))
    return out


def window(template: str) -> int:
    """Words of a paragraph among which a match lies."""
    n = len(byte_words(template))
    return n + n // 4


class Joiner:
    """The index over template prefixes; ``matches`` joins one block."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: int = THRESHOLD):
        sets = {name: t for name, t in template_tokens(templates).items() if t}
        self.need = {name: needed(len(t), threshold) for name, t in sets.items()}
        self.telling = telling(sets, threshold)
        self.window = {name: window(templates[name]) for name in sets}
        self.order = {name: sorted(t, key=lambda w: (counts.get(w, 0), w)) for name, t in sets.items()}
        self.index: dict[bytes, list[str]] = defaultdict(list)
        for name, t in self.order.items():
            for w in t[: len(t) - self.need[name] + 1]:
                self.index[w].append(name)
        self.tokens = set().union(*sets.values())

    def matches(self, block: list[tuple[int, bytes]]) -> dict[str, float]:
        """Template -> containment in the best window, for every template that
        matches a block of (word number, template token)."""
        out = {}
        have = {w for _, w in block}
        for name in {n for w in have & self.index.keys() for n in self.index[w]}:
            t, need, got = self.order[name], self.need[name], 0
            if len(have) < need or not have.issuperset(self.telling[name]):
                continue
            for i, w in enumerate(t):
                got += w in have
                if got + len(t) - i - 1 < need:
                    break
            else:
                best = self.best_window(name, block)
                if best >= need:
                    out[name] = best / len(t)
        return out

    def best_window(self, name: str, block: list[tuple[int, bytes]]) -> int:
        """Most distinct tokens of a template in a window that holds its telling ones (0: none does)."""
        own, must, width = set(self.order[name]), self.telling[name], self.window[name]
        seen: Counter = Counter()
        inside: deque[tuple[int, bytes]] = deque()
        best = telling_in = 0
        for at, w in block:
            if w not in own:
                continue
            while inside and inside[0][0] <= at - width:
                old = inside.popleft()[1]
                seen[old] -= 1
                if not seen[old]:
                    del seen[old]
                    telling_in -= old in must
            if w not in seen:
                telling_in += w in must
            seen[w] += 1
            inside.append((at, w))
            if len(seen) > best and telling_in == len(must):
                best = len(seen)
        return best


def blocks(text: str, joiner: Joiner):
    """(word number, token) of the template tokens of each paragraph that holds a prefix token."""
    paragraph: list[tuple[int, bytes]] = []
    n = 0
    for line in [*text.split("\n"), ""]:
        words = byte_words(line)
        paragraph += [(n + i, w) for i, w in enumerate(words) if w in joiner.tokens]
        n += len(words)
        if not line.strip():
            if any(w in joiner.index for _, w in paragraph):
                yield paragraph
            paragraph, n = [], 0


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    joined = b" " + b" ".join(words) + b" "
    out, starts = [], None
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        at = joined.find(p)
        while at >= 0:
            if starts is None:
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            out.append((bisect_right(starts, at) - 1, label))
            at = joined.find(p, at + 1)
    return sorted(out)


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def scan_licenses(spark: SparkSession, docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                  templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """``keep`` columns, words, base places and labels, all labels, score (1
    with a base label, else the largest containment that met the threshold)."""
    sets = template_tokens(templates)
    counts = token_counts(docs, set().union(*sets.values()) if sets else set(), text)

    def run():
        joiner = Joiner(templates, counts, threshold)

        def one(t):
            words = byte_words(t)
            base = places(words)
            found: dict[str, float] = {}
            for block in blocks(t or "", joiner):
                for name, share in joiner.matches(block).items():
                    found[name] = max(share, found.get(name, 0.0))
            labels = sorted({x for _, x in base})
            score = 1.0 if base else max(found.values(), default=0.0)
            return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(labels), ",".join(sorted({*labels, *found})), score)

        return one

    return map_batches(docs, text, run, SCHEMA, keep)
