"""License scans by an exact set-similarity join between text blocks and license templates.

A block of a template with n distinct tokens is a stretch of at most ``ceil(SPAN * n)`` words, or ``ceil(SPAN * words)`` if
the template's own words are more than ``SPAN * n``; it matches if it holds at least ``THRESHOLD`` of the tokens.  As a
notice of a few words differs from other licenses' in one, a template of fewer than ``SHORT_TOKENS`` must be there with
all of them and no word more: its blocks have as many words as itself.
Template tokens are ordered by how many documents of the whole corpus hold them, rarest first, and an inverted index
leads from each of the first n - need + 1 of a template (prefix filter) to it.  Every word of a document is looked up in
that index; around each place that it meets only blocks that hold the place are left.  What these cover must have
``need`` words (length filter), and going through the order no more than n - need tokens may be missing from it before it
is given up (positional filter).  What is left is searched exactly: each stretch that meets the threshold is found
with two pointers over the places of the template's tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm._words import bounded_batches, text_slices

# The phrases that the base scan looks for, and what it calls them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences, notices, bodies and disclaimers of public licenses, by the method's own labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-body": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mit-body": "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-notice": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit-license": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-license": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
SHORT_TOKENS = 15
SPAN = 1.5
#: A-Z to a-z; other ASCII than letters and digits to blanks; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def least_tokens(n: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's n distinct tokens a block must hold."""
    return n if n < SHORT_TOKENS else max(1, math.ceil(threshold * n - 1e-9))


class Matcher:
    """Finds phrases and template blocks in documents."""

    def __init__(self, order: dict[bytes, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, span: float = SPAN):
        self.templates: list[tuple[str, list[bytes], int, int]] = []
        #: From each prefix token to the templates that have it in their prefix.
        self.index: dict[bytes, list[int]] = {}
        for label, text in sorted(templates.items()):
            words = words_of(text)
            tokens = sorted(set(words), key=lambda t: (order.get(t, 0), t))
            if not tokens:
                continue
            need = least_tokens(len(tokens), threshold)
            for t in tokens[: len(tokens) - need + 1]:
                self.index.setdefault(t, []).append(len(self.templates))
            wide = math.ceil(span * (len(words) if len(words) > span * len(tokens) else len(tokens)))
            self.templates.append((label, tokens, need, len(words) if len(tokens) < SHORT_TOKENS else wide))
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in sorted(PHRASES.items())]

    def places(self, words: list[bytes]) -> list[tuple[str, int]]:
        """``(label, first word)`` of every place of every phrase."""
        line = b" " + b" ".join(words) + b" "
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            before = seen = 0
            while at >= 0:
                before += line.count(b" ", seen, at)  # blanks are counted once, from place to place
                found.append((label, before))
                seen = at
                at = line.find(phrase, at + 1)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``(label, first word, words, containment)`` of every block; those of a template that overlap are one."""
        met: dict[int, list[list[int]]] = {}  # of each template the stretches that its blocks with a prefix token cover
        if not self.index.keys().isdisjoint(words):
            for i, w in enumerate(words):
                for k in self.index.get(w, ()):
                    width = self.templates[k][3]
                    lo, hi = max(0, i - width + 1), min(len(words), i + width)
                    covered = met.setdefault(k, [])
                    if covered and lo <= covered[-1][1]:
                        covered[-1][1] = hi
                    else:
                        covered.append([lo, hi])
        found = []
        for k, covered in met.items():
            label, tokens, need, width = self.templates[k]
            for lo, hi in covered:
                if hi - lo >= need and self._may_hold(tokens, need, there := set(words[lo:hi])):
                    of = there.intersection(tokens)
                    found += self._stretches(label, [(i, words[i]) for i in range(lo, hi) if words[i] in of], len(tokens), need, width)
        return sorted(found, key=lambda x: (x[1], x[0]))

    @staticmethod
    def _may_hold(tokens: list[bytes], need: int, there: set[bytes]) -> bool:
        """False as soon as more tokens are missing, rarest first, than a match may miss."""
        missing = 0
        for t in tokens:
            missing += t not in there
            if missing > len(tokens) - need:
                return False
        return True

    @staticmethod
    def _stretches(label: str, hits: list[tuple[int, bytes]], n: int, need: int, width: int) -> list[tuple[str, int, int, float]]:
        out: list[list] = []
        held: Counter = Counter()
        left = 0
        for i, w in hits:
            held[w] += 1
            while hits[left][0] <= i - width:
                held[hits[left][1]] -= 1
                if not held[hits[left][1]]:
                    del held[hits[left][1]]
                left += 1
            if len(held) >= need:
                a = hits[left][0]
                if out and a <= out[-1][1]:
                    out[-1][1], out[-1][2] = i, max(out[-1][2], len(held))
                else:
                    out.append([a, i, len(held)])
        return [(label, a, b - a + 1, k / n) for a, b, k in out]


def token_documents(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """In how many rows of ``docs`` each template token stands; the result is as large as the templates."""
    vocabulary = frozenset(t for text in templates.values() for t in words_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, texts in text_slices(batch, 0):
                for text in texts:
                    seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, places, blocks)`` of every row: where phrases stand and which blocks match which of ``templates``.

    Null texts count as empty; texts of any length are scanned whole, a few at a time.  Labels that start in one word come
    in order of their names.  Repeated rows and null ids give rows of their own, other columns are not read; an empty
    table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    order = token_documents(docs, text_col, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(order, templates)
        place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
        block = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            for a, b, texts in text_slices(batch, 1):
                counts, places, blocks = [], [], []
                for text in texts:
                    words = words_of(text)
                    counts.append(len(words))
                    places.append([dict(zip(("label", "first_word"), x, strict=True)) for x in matcher.places(words)])
                    blocks.append([dict(zip(("label", "first_word", "words", "containment"), x, strict=True)) for x in matcher.blocks(words)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(blocks, block)], ["doc_id", "n_words", "places", "blocks"])

    schema = "doc_id long, n_words long, places array<struct<label string, first_word long>>, blocks array<struct<label string, first_word long, words long, containment double>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def license_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs(doc_id, text)``.

    Score is the best containment of a matching block, 0 where none matches.  Odd rows are as in ``scan_licenses``.
    """
    own = F.array_distinct(F.col("places.label"))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("blocks.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )

