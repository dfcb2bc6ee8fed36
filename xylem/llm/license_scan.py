"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, text_of

#: Phrases whose places are counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that a block is compared with.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LINES = bytes(10 if b == 10 else _TABLE[b] for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The text's words: runs of ASCII digits and letters and of signs beyond ASCII, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[bytes, ...]  # distinct, rarest in the corpus first
    need: int
    span: int = 0  # words of the longest run that may cross lines

    @property
    def prefix(self) -> tuple[bytes, ...]:
        """Of its rarest tokens so many that a block holding none of them can't hold ``need``."""
        return self.tokens[: len(self.tokens) - self.need + 1]


def order_templates(templates, counts: dict[bytes, int], threshold: float = CONTAINMENT) -> list[Template]:
    """Templates with their tokens in the global order: by number of documents that hold them, ascending, then by token."""
    out = []
    for label, text in templates:
        tokens = sorted(set(words_of(text)), key=lambda w: (counts.get(w, 0), w))
        if tokens:
            out.append(Template(label, tuple(tokens), max(1, ceil(threshold * len(tokens) - 1e-9)), ceil(len(words_of(text)) / threshold - 1e-9)))
    return out


class Matcher:
    """Finds templates that a set of words contains to the threshold, with prefix, length and positional filters."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.by_token: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(t.prefix):
                self.by_token.setdefault(w, []).append((k, i))
        self.rare = frozenset(self.by_token)

    def match(self, block: frozenset[bytes] | set[bytes]) -> list[tuple[int, int]]:
        """(template, number of its tokens in the block) of all that reach what they need."""
        first: dict[int, int] = {}
        for w in self.rare & block:
            for k, i in self.by_token[w]:
                first[k] = min(i, first.get(k, i))
        out = []
        for k, i in first.items():
            t = self.templates[k]
            if len(block) < t.need or len(t.tokens) - i < t.need:  # length; tokens from the first shared one on
                continue
            if (n := sum(w in block for w in t.tokens[i:])) >= t.need:
                out.append((k, n))
        return out


def wrapped(lines: list[list[bytes]], template: Template, alone: dict[int, int]) -> list[tuple[int, int]]:
    """(line, number of the template's tokens) of the runs of words over several lines that reach what the template needs.

    A run has at most ``span`` words: the template's length divided by the threshold. Of runs that overlap the fullest counts,
    unless a line it touches holds as many by itself (``alone``).
    """
    tokens, at, hits = frozenset(template.tokens), 0, []
    for i, line in enumerate(lines):
        hits += [(at + p, i, w) for p, w in enumerate(line) if w in tokens]
        at += len(line)
    held: Counter[bytes] = Counter()
    found: list[tuple[int, int, int, int]] = []  # first and last place, line, number
    z = 0
    for h, (place, line, word) in enumerate(hits):
        while z < len(hits) and hits[z][0] < place + template.span:
            held[hits[z][2]] += 1
            z += 1
        if (n := len(held)) >= template.need:
            seen: set[bytes] = set()
            end, last, _ = next(x for x in hits[h:z] if seen.add(x[2]) or len(seen) == n)  # where the last of them stands first
            if last > line and n > max(alone.get(i, 0) for i in range(line, last + 1)):
                if not found or found[-1][1] < place:
                    found.append((place, end, line, n))
                elif n > found[-1][3]:
                    found[-1] = (place, end, line, n)
        held[word] -= 1
        if not held[word]:
            del held[word]
    return [(line, n) for _, _, line, n in found]


def document_counts(df: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Of each word of the vocabulary the number of df's documents that hold it. What comes to the driver is as large as the vocabulary."""
    arrow_rows(df.sparkSession)
    words = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(words.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": list(n), "n": list(n.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    found = df.select(text_of(df, text_col)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


def phrase_places(words: list[bytes], phrases) -> list[list[int]]:
    """Of each phrase the places where its words stand consecutively, counted in words; places may overlap."""
    out: list[list[int]] = []
    text, at = None, None
    held = set(words)
    for p in phrases:
        if not held.issuperset(p):
            out.append([])
            continue
        if text is None:
            text = b" " + b" ".join(words) + b" "
            at = np.cumsum([0] + [len(w) + 1 for w in words[:-1]]).tolist()
        needle, found, i = b" " + b" ".join(p) + b" ", [], -1
        while (i := text.find(needle, i + 1)) >= 0:
            found.append(bisect_left(at, i))
        out.append(found)
    return out


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Scans every whole text for license phrases, and joins its blocks with the license templates.

    Blocks are the lines, and runs of words over several lines (a wrapped notice) of at most the template's number of words
    divided by the threshold. The join is exact: every block that holds at least ``threshold`` of a template's distinct words counts. Tokens are
    ordered by the number of documents in df that hold them, so prefixes consist of the rarest. Templates are a list in the
    code, so they travel with the tasks; a first pass counts their words alone.

    Returns id_col, n_words, n_base (places of all phrases), first_word and last_word (smallest and largest start of a
    place, in words; else null), base_labels, labels (with the templates'; both distinct, sorted, comma-joined, else
    empty), score (1 with a phrase; else the largest share of a template in a block that reaches the threshold; else 0),
    blocks (array of line, its first, label, score). Null texts count as empty, with 0 words; ids may repeat or be null.
    """
    arrow_rows(df.sparkSession)
    vocabulary = {w for _, t in templates for w in words_of(t)}
    matcher = Matcher(order_templates(templates, document_counts(df, vocabulary, text_col), threshold))
    phrase_words, phrase_labels = [tuple(words_of(p)) for p, _ in phrases], [x for _, x in phrases]
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:long,label:string,score:double>>"
    block_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block_type]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                held = set(words)
                found = phrase_places(words, phrase_words)
                places = [p for f in found for p in f]
                base = {x for x, f in zip(phrase_labels, found, strict=True) if f}
                blocks = []
                if whole := matcher.match(held):  # a block can't hold more of a template than the whole text does
                    lines = [line.split() for line in t.encode("utf-8", "surrogatepass").translate(_LINES).split(b"\n")]
                    alone: dict[int, dict[int, int]] = {k: {} for k, _ in whole}
                    for i, line in enumerate(lines):
                        for k, n in matcher.match(set(line)):
                            alone[k][i] = n
                    met = [(i, k, n) for k, own in alone.items() for i, n in (*own.items(), *wrapped(lines, matcher.templates[k], own))]
                    for i, k, n in sorted(met):
                        x = matcher.templates[k]
                        blocks.append({"line": i, "label": x.label, "score": n / len(x.tokens)})
                labels = base | {x["label"] for x in blocks}
                score = 1.0 if base else max([x["score"] for x in blocks], default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return df.select(df[id_col], text_of(df, text_col)).mapInArrow(scan, schema)
