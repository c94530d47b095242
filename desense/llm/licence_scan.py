"""License scans: phrases at their places, and templates by a positional rare-token index.

Base labels come from fixed phrases whose words stand consecutively. Further labels
come from licence templates; the words of all are the licence words, and each has its
postings: in which template and where it stands. In each neighbourhood of ``WINDOW``
words of a file its licence words are looked up, by falling IDF, as long as one of their
templates has had fewer than ``RAREST`` words there, so that none crowds out another. What
is looked up votes for where its template would begin; two words must agree, give or take
``SLACK``, or as many as the template has. At such a beginning the mandatory key phrases are
verified where the template has them, and the label counts if of the weight (IDF) of all
the template's words at least ``SHARE`` stands in the template's order in the stretch that
follows, up to twice the template long. So a score says how much of the template a file
has: words may be missing or come between, and what else a file holds does not change it.

Words are found by vectorised steps over the bytes of many texts; only words that are
licence words by their first eight bytes and length become Python objects.

Document frequencies cover all documents; they are one row for each licence word, so
they are collected. Defined cases: null and empty texts have no words, no labels and
score 0; a repeated row counts in frequencies as often as it stands there; equal IDFs go
by word; a very long text is scanned whole, as one slice; an empty table gives an empty
result; extra columns, whatever their names, are ignored; null ids keep their rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from desense.llm.common import text_bytes, text_slices, word_spans

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_DISCLAIMER = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"""
#: Label, a licence's text or its notice, and mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. """ + _DISCLAIMER, ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", """licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license""", ["apache license version 2", "in compliance with the license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain""", ["free and unencumbered software"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", """this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.""", ["under the terms of the gnu general public license", "either version 3 of the license"]),
    ("gpl-3", """this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details""", ["under the terms of the gnu general public license", "either version 3 of the license"]),
    ("gpl-2", """this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version.""", ["under the terms of the gnu general public license", "either version 2 of the license"]),
    ("gpl-2", """this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details""", ["under the terms of the gnu general public license", "either version 2 of the license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/""", ["mozilla public license v 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed""", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("isc", """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""", ["permission to use copy modify"]),
    ("zlib", """this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software""", ["alter it and redistribute it freely"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
RAREST, WINDOW = 4, 16
SHARE = 0.6
SLACK = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def plain_words(text: str) -> list[str]:
    """Words of a template, as they are found in texts."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


@dataclass(frozen=True)
class LicenceIndex:
    """Templates as words, and the places of their key phrases."""

    phrases: dict[str, str]
    templates: list[tuple[str, str, list[str]]]

    def vocabulary(self) -> list[str]:
        texts = [*self.phrases, *(t for _, t, _ in self.templates), *(p for _, _, ps in self.templates for p in ps)]
        return sorted({w for t in texts for w in plain_words(t)})

    def keys(self) -> list[list[tuple[int, list[str]]]]:
        """For each template its key phrases with where they stand in it."""
        out = []
        for _, text, phrases in self.templates:
            ws, own = plain_words(text), []
            for p in phrases:
                ps = p.split()
                at = next(i for i in range(len(ws)) if ws[i : i + len(ps)] == ps)
                own.append((at, ps))
            out.append(own)
        return out


class _Finder:
    """Occurrences of the vocabulary's words in the texts of a batch.

    A word's key is its first eight bytes, with the length where it is shorter: short
    words are known by their key alone, longer ones are compared in full.
    """

    def __init__(self, vocabulary: list[str]):
        coded = [w.encode() for w in vocabulary]
        keys = [int.from_bytes(c[:8], "little") ^ (len(c) << 56 if len(c) < 8 else 0) for c in coded]
        self.keys = np.array(sorted(set(keys)), dtype=np.uint64)
        self.with_key: list[dict[bytes, int]] = [{} for _ in self.keys]
        for i, (c, k) in enumerate(zip(coded, keys, strict=True)):
            self.with_key[int(np.searchsorted(self.keys, np.uint64(k)))][c] = i
        self.short = np.array([len(min(d, key=len)) < 8 for d in self.with_key])

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """First word number of each text, and for each occurrence of a key its text, its
        place, its key number and, where the key doesn't tell, the word."""
        raw, offsets = text_bytes(column)
        starts, stops, first = word_spans(_IS_WORD[raw], offsets)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return first, none, none, none, []
        low = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
        lengths = np.minimum(stops - starts, 8)
        eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=low, strides=(1,))[starts] & _KEEP[lengths]
        eight ^= np.where(lengths < 8, lengths << 56, 0).astype(np.uint64)
        key = np.minimum(np.searchsorted(self.keys, eight), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[key] == eight)
        text = np.searchsorted(first, at, side="right") - 1
        words = [b"" if s else low[i:j].tobytes() for s, i, j in zip(self.short[key[at]].tolist(), starts[at].tolist(), stops[at].tolist(), strict=True)]
        return first, text, at - first[text], key[at], words

    def word(self, key: int, word: bytes) -> int | None:
        """Number in the vocabulary."""
        return next(iter(self.with_key[key].values())) if self.short[key] else self.with_key[key].get(word)

    def presence(self, column: pa.Array) -> Counter:
        """In how many texts each word stands."""
        _, text, _, key, words = self.hits(column)
        short = self.short[key]
        once = np.unique(text[short] * len(self.keys) + key[short]) % len(self.keys)
        counts = Counter({self.word(k, b""): int(n) for k, n in enumerate(np.bincount(once)) if n})
        long = np.flatnonzero(~short)
        counts.update(w for _, w in {(t, self.word(k, words[i])) for i, t, k in zip(long.tolist(), text[long].tolist(), key[long].tolist(), strict=True)} if w is not None)
        return counts

    def find(self, column: pa.Array, needles: set[int]) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
        """Number of words of each text; and for each text with a key of a word of
        ``needles`` all occurrences, place to word."""
        first, text, place, key, words = self.hits(column)
        wanted = np.array([any(i in needles for i in d.values()) for d in self.with_key])
        chosen = np.zeros(len(column), bool)
        chosen[text[wanted[key]]] = True
        found: dict[int, dict[int, int]] = defaultdict(dict)
        own = np.flatnonzero(chosen[text])
        for i, t, p, k in zip(own.tolist(), text[own].tolist(), place[own].tolist(), key[own].tolist(), strict=True):
            if (w := self.word(k, words[i])) is not None:
                found[t][p] = w
        return np.diff(first), found


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and how many hold each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = _Finder(vocabulary), Counter()
        for batch in text_slices(batches):
            counts[-1] += batch.num_rows
            counts.update(finder.presence(batch.column("text")))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    sums = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in sums}
    return found.pop(-1, 0), {vocabulary[w]: n for w, n in found.items()}


def scan_licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list = TEMPLATES, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the greatest share of a template's weight that agrees,
    1 with a base label)."""
    index = LicenceIndex(dict(phrases), list(templates))
    vocabulary = index.vocabulary()
    total, frequency = document_frequencies(docs, vocabulary)
    # a word without documents is the rarest
    idf = {w: math.log((10 + total) / (1 + frequency.get(w, 0))) for w in vocabulary}
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, number = _Finder(vocabulary), {w: i for i, w in enumerate(vocabulary)}
        rank = {w: (-idf[w], w) for w in vocabulary}
        falling = {number[w]: i for i, w in enumerate(sorted(vocabulary, key=rank.__getitem__))}
        template_words = [[number[w] for w in plain_words(text)] for _, text, _ in index.templates]
        weights = [idf[w] for w in vocabulary]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(template_words):
            for at, w in enumerate(ws):
                postings[w].append((t, at))
        # each phrase under its rarest word: where that stands in it, its words, and its
        # label or its template, which of its key phrases it is and where it stands there
        anchored: dict[int, list[tuple]] = defaultdict(list)
        keys = index.keys()
        key_phrases = [(ws, None, (t, k), at) for t, own in enumerate(keys) for k, (at, ws) in enumerate(own)]
        for ws, label, key, at in [*((p.split(), label, None, 0) for p, label in index.phrases.items()), *key_phrases]:
            rarest_word = min(ws, key=rank.__getitem__)
            anchored[number[rarest_word]].append((ws.index(rarest_word), [number[w] for w in ws], label, key, at))

        def beginnings(word_at: dict[int, int], asked: set[int]) -> dict[int, dict[int, set[int]]]:
            """Where the rarest words of each neighbourhood tell that a template of ``asked``
            begins: template, place, and the words that say so."""
            near: dict[int, list[int]] = defaultdict(list)
            for place in word_at:
                near[place // WINDOW].append(place)
            votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
            for places in near.values():
                used: Counter[int] = Counter()
                for w in sorted({word_at[p] for p in places}, key=falling.__getitem__):
                    own = {t for t, _ in postings[w] if t in asked and used[t] < rarest}
                    used.update(own)
                    for t, at in postings[w] if own else ():
                        if t in own:
                            for p in places:
                                if word_at[p] == w:
                                    votes[t][p - at].add(w)
            return votes

        def share_of(places_of: dict[int, list[int]], t: int, begin: int) -> float:
            """Share of the template's weight that stands in its order in the stretch from
            ``begin``: the heaviest chain of places that rise with the template's."""
            ws = template_words[t]
            best = [0.0] * (len(ws) + 1)  # a tree of maxima over the template's places
            low, high = begin - SLACK, begin + 2 * len(ws) + SLACK
            met = [(p, -at, w) for at, w in enumerate(ws) for p in places_of.get(w, [])[bisect_left(places_of.get(w, []), low) : bisect_right(places_of.get(w, []), high)]]
            for _, at, w in sorted(met):
                i, top = -at, 0.0
                while i:
                    top, i = max(top, best[i]), i & (i - 1)
                top, i = top + weights[w], 1 - at
                while i <= len(ws):
                    best[i], i = max(best[i], top), i + (i & -i)
            i, top = len(ws), 0.0
            while i:
                top, i = max(top, best[i]), i & (i - 1)
            return top / sum(weights[w] for w in ws)

        def judge(word_at: dict[int, int]) -> tuple:
            places, labels, own, told = [], set(), set(), defaultdict(set)
            for anchor, w in word_at.items():
                for shift, ws, label, key, at in anchored.get(w, ()):
                    start = anchor - shift
                    if all(word_at.get(start + i) == w for i, w in enumerate(ws)):
                        if key is None:
                            places.append(start)
                            labels.add(label)
                        else:
                            told[key].add(start - at)
            best = 0.0
            # a template without all its key phrases can't be verified anywhere
            asked = {t for t, k in told if not k and all((t, i) in told for i in range(len(keys[t])))}
            places_of: dict[int, list[int]] = defaultdict(list)
            for p in sorted(word_at) if asked else ():
                places_of[word_at[p]].append(p)
            for t, votes in beginnings(word_at, asked).items() if asked else ():
                needed, size = min(2, len(set(template_words[t]))), len(template_words[t])
                first = sorted(told[t, 0])
                for begin in votes:
                    # the first key phrase stands where the template has it, the others after it, up to twice as far
                    if not any(abs(b - begin) <= SLACK for b in first[bisect_left(first, begin - SLACK) : bisect_right(first, begin + SLACK)]):
                        continue
                    if not all(any(begin - SLACK <= b <= begin + size for b in told[t, k]) for k in range(1, len(keys[t]))):
                        continue
                    agreeing = set().union(*(votes[b] for b in range(begin - SLACK, begin + SLACK + 1) if b in votes))
                    if len(agreeing) >= needed and (agrees := share_of(places_of, t, begin)) >= share:
                        own.add(index.templates[t][0])
                        best = max(best, agrees)
            score = 1.0 if labels else min(1.0, best)
            return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), score

        for batch in text_slices(batches):
            n_words, found = finder.find(batch.column("text"), set(anchored))
            judged = [judge(found[i]) if i in found else (0, None, None, "", "", 0.0) for i in range(batch.num_rows)]
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            rest = [pa.array(c, t) for c, t in zip(zip(*judged, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words.astype(np.int64)), *rest], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
