"""License scans by an exact set-similarity join, in DataFrame operations only.

A template is the set of its words. A text block is a run of words of a text, twice as long as a stride that
the template sets, at every multiple of that stride. A block meets a template if it holds a share of its
words. Words are ordered by the number of documents that hold them, the rarest first, over all documents;
the joins' filters follow from that order:

- prefix: a block that holds ``need`` of the words of a template has one of its first size - need + 1, so only
  these are looked up in texts, and only blocks around them are looked at;
- length: a block of fewer than ``need`` words meets nothing;
- positional: from the first common word on, what is left of either side has to reach ``need``.

Blocks that pass are verified on the whole sets; a phrase is a template all of whose words are needed, and is
verified in its order as well. The templates are literals of the plan, so the join is a lookup within the
row: no row is moved, whatever license many documents share, and a long text is work in proportion to its
words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a notice's words that a block has to hold.
SHARE = 0.8
#: The stride of a notice's blocks as a multiple of its words: so much longer may a copy be.
SLACK = 1.25


@dataclass(frozen=True)
class Template:
    """A phrase (all words, in order) or the notice of a license (a share of its words, in any order)."""

    label: str
    text: str
    phrase: bool = False


#: The phrases that always count.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

#: Further names of licenses, and the notices that go with them.
MORE = (
    Template("agpl", "gnu affero general public license", True),
    Template("bsd", "bsd license", True),
    Template("bsl", "boost software license", True),
    Template("cc-by", "creative commons attribution", True),
    Template("cc0", "cc0", True),
    Template("epl", "eclipse public license", True),
    Template("isc", "isc license", True),
    Template("lgpl", "gnu lesser general public license", True),
    Template("mpl", "mozilla public license", True),
    Template("apache", "you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def template_words(text: str) -> list[str]:
    """The same of a template."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass
class Side:
    """A template as a side of the join: its distinct words in the global order, and what its filters ask."""

    number: int
    template: Template
    ordered: list[str]

    @property
    def sequence(self) -> list[str]:
        return template_words(self.template.text)

    @property
    def need(self) -> int:
        """Distinct words that a block has to hold."""
        return len(self.ordered) if self.template.phrase else math.ceil(SHARE * len(self.ordered) - 1e-9)

    @property
    def prefix(self) -> list[str]:
        return self.ordered[: len(self.ordered) - self.need + 1]

    @property
    def stride(self) -> int:
        return len(self.sequence) if self.template.phrase else math.ceil(SLACK * len(self.sequence))


def frequencies(texts: DataFrame, vocabulary: Sequence[str], words_column: str) -> dict[str, int]:
    """Documents that hold each word of the templates: one row for each such word comes back."""
    own = texts.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col(f"`{words_column}`"))).alias("word"))
    return {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def sides(templates: Sequence[Template], frequency: Mapping[str, int]) -> tuple[list[str], list[Side]]:
    """All words of the templates in the global order, the rarest first, and the templates in it."""
    order = sorted({w for t in templates for w in template_words(t.text)}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    return order, [Side(k, t, sorted(set(template_words(t.text)), key=rank.__getitem__)) for k, t in enumerate(templates)]


def scan(docs: DataFrame, text: str = "text", templates: Sequence[Template] = BASE + MORE, n_words: str = "n_words", matches: str = "matches") -> DataFrame:
    """The rows of docs with n_words (long) and matches, an array of (label, template, start, end, containment).

    ``template`` is the number of the template. A phrase has a match for each of its places; a notice has one
    for each block that holds SHARE of its words, from the first to after the last of these in the block, in
    words from 0. Blocks of a notice overlap, so that one copy may be told by two blocks.

    A null text is an empty one: no words and no matches. Rows that are equal have equal results, whatever
    their number; all columns are kept, but for those with the names of n_words and matches, which are
    replaced. An empty table gives none. Texts are searched whole, of any length.
    """
    templates = [t for t in templates if template_words(t.text)]
    tokens, found = (free_name([*docs.columns, n_words, matches], c) for c in ("tokens", "found"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (n_words.lower(), matches.lower())]
    body = docs.select(*kept, words(F.col(f"`{text}`")).alias(tokens))
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    shape = "array<struct<label:string,template:int,start:int,end:int,containment:double>>"
    if not templates:
        return body.select(*kept, F.size(tokens).cast("long").alias(n_words), F.array().cast(shape).alias(matches))
    order, own = sides(templates, frequencies(docs.select(words(F.col(f"`{text}`")).alias(tokens)), vocabulary, tokens))
    body = body.withColumn(found, _candidates(F.col(tokens), own)).withColumn(found, _verified(F.col(tokens), F.col(found), order, own))
    return body.select(*kept, F.size(tokens).cast("long").alias(n_words), F.col(found).cast(shape).alias(matches))


#: A candidate is one number: that of the template times PAIR, plus that of the block.
PAIR = 1 << 40


def _of(values: Sequence, number: Column) -> Column:
    """The template's entry of a literal array."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.get(F.array(*map(lit, values)), number.cast("int"))


def _candidates(tokens: Column, own: Sequence[Side]) -> Column:
    """The blocks around words of a template's prefix, each once for each template."""
    by_word: dict[str, list[int]] = {}
    for s in own:
        for w in s.prefix:
            by_word.setdefault(w, []).append(s.number)
    lookup = F.create_map(*[x for w, ns in by_word.items() for x in (F.lit(w), F.array(*map(F.lit, ns)))])
    hits = F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(list(by_word)))

    def blocks(t: Column, at: Column) -> Column:
        k = F.floor(at / _of([s.stride for s in own], t)).cast("long")
        code = t.cast("long") * PAIR + k
        return F.when(k > 0, F.array(code - 1, code)).otherwise(F.array(code))

    each = F.transform(hits, lambda h: F.flatten(F.transform(F.element_at(lookup, h["w"]), lambda t: blocks(t, h["i"]))))
    return F.array_distinct(F.flatten(each))


def _verified(tokens: Column, candidates: Column, order: Sequence[str], own: Sequence[Side]) -> Column:
    """The matches of candidates that pass the length and positional filters and hold what they have to."""
    everything = F.array(*map(F.lit, order))
    stride, need = (lambda t: _of([s.stride for s in own], t)), (lambda t: _of([s.need for s in own], t))
    ordered, prefix = (lambda t: _of([s.ordered for s in own], t)), (lambda t: _of([s.prefix for s in own], t))

    def opened(c: Column) -> Column:
        t = F.floor(c / PAIR).cast("int")
        at = ((c % PAIR) * stride(t)).cast("int")
        block = F.slice(tokens, at + 1, 2 * stride(t))
        # the block's words that occur in templates, in the global order; all others, which no template has, come before
        return F.struct(t.alias("t"), at.alias("at"), block.alias("block"), F.array_intersect(everything, block).alias("own"))

    def reaches(b: Column) -> Column:
        first = F.get(F.array_intersect(prefix(b["t"]), b["own"]), 0)
        left = F.least(F.size(ordered(b["t"])) - F.array_position(ordered(b["t"]), first), F.size(b["own"]) - F.array_position(b["own"], first)) + 1
        return (left >= need(b["t"])) & (F.size(F.array_intersect(ordered(b["t"]), b["own"])) >= need(b["t"]))

    def told(b: Column) -> Column:
        label = _of([s.template.label for s in own], b["t"])
        match = lambda start, end, share: F.struct(label.alias("label"), b["t"].alias("template"), start.cast("int").alias("start"), end.cast("int").alias("end"), share.alias("containment"))
        phrase = _of([s.sequence for s in own], b["t"])
        last = F.least(F.size(b["block"]) - F.size(phrase), stride(b["t"]) - 1)
        starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda p: F.slice(b["block"], p + 1, F.size(phrase)) == phrase)).otherwise(F.array().cast("array<int>"))
        phrases = F.transform(starts, lambda p: match(b["at"] + p, b["at"] + p + F.size(phrase), F.lit(1.0)))
        ins = F.transform(b["block"], lambda w: F.array_contains(ordered(b["t"]), w))
        share = F.size(F.array_intersect(ordered(b["t"]), b["own"])) / F.size(ordered(b["t"]))
        notice = F.array(match(b["at"] + F.array_position(ins, True) - 1, b["at"] + F.size(ins) - F.array_position(F.reverse(ins), True) + 1, share))
        return F.when(_of([s.template.phrase for s in own], b["t"]), phrases).otherwise(notice)

    long = lambda c: F.size(tokens) - (c % PAIR) * stride(F.floor(c / PAIR)) >= need(F.floor(c / PAIR))
    passing = F.filter(F.transform(F.filter(candidates, long), opened), reaches)
    return F.flatten(F.transform(passing, told))
