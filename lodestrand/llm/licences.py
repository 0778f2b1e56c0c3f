"""License scans: matching statistics of a generalised suffix automaton over licence words.

The automaton holds every run of words of every template. Streaming a text through it gives, at each word, the length
of the longest run that ends there and stands in some template (the matching statistics), and where it stands. Long
matches of one template, in the template's order and not far apart, are chained; the chain's share of the template
is its score. Short phrases are templates too: a phrase stands in the text where its state, or one whose suffix it
is, is reached with at least its length.

Only stretches in which each pair of neighbours is a pair of some template are streamed: elsewhere no match is longer
than one word. Those stretches are found with numpy, so the automaton's steps are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import ALNUM, U64, Texts, slices, text_hash

#: Phrases that count by themselves, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of licence notices, of openings of licence texts, and of whole short ones.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
)

#: Words in a match that counts for chains, share of a template that gives its label, words of a gap inside a chain.
LONG, SHARE, GAP = 4, 0.8, 8


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers, built online template by template."""

    def __init__(self, texts: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of each state: template -> the places where its runs end (words before them, inclusive).
        self.ends: list[dict[int, list[int]]] = [{}]
        finals = []
        for t, words in enumerate(texts):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                finals.append((last, t, k + 1))
        for state, t, k in finals:
            while state > 0:
                self.ends[state].setdefault(t, []).append(k)
                state = self.link[state]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def find(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.step[state][w]
        return state


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [p.split() for p, _ in phrases] + [t.split() for _, t in templates]
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: k for k, w in enumerate(vocabulary)}
        coded = [[number[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in coded]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.phrases = len(phrases)
        self.automaton = SuffixAutomaton(coded)
        hashes = np.array([text_hash(w) for w in vocabulary], dtype=U64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(hashes >> U64(48)).astype(np.int64)] = True
        self.pairs = np.zeros((len(vocabulary), len(vocabulary)), dtype=bool)
        for t in coded:
            self.pairs[t[:-1], t[1:]] = True
        #: Of each state: (phrase, its length) for phrases that end wherever it is reached with that length.
        a = self.automaton
        own: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(coded[: self.phrases]):
            own.setdefault(a.find(t), []).append((k, self.sizes[k]))
        self.here: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.here[state] = [*self.here[a.link[state]], *own.get(state, [])]
        #: Words in a match that counts for chains, by template.
        self.least = [min(LONG, n) for n in self.sizes]
        #: Of each state: (template, longest run, its places) for templates with a long run that ends wherever it is reached.
        self.long: list[list[tuple[int, int, list[int]]]] = [[] for _ in a.link]
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            mine = [(t, a.length[state], x) for t, x in a.ends[state].items() if t >= self.phrases and a.length[state] >= self.least[t]]
            self.long[state] = mine + [x for x in self.long[a.link[state]] if x[0] not in a.ends[state]]

    def words(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary number (or -1) and the text of each word."""
        low = texts.lowered()
        starts, ends, owner = low.runs(ALNUM)
        hashes = low.hashes(low.prefix_hash(), starts, ends)
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        right = self.hashes[at] == hashes[some]
        out[some[right]] = self.numbers[at[right]]
        return out, owner

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[int]]]]:
        """Of one stretch: (phrase, start) of all phrases, and (template, start, length, places of its end) of its long matches.

        Each template has matching statistics of its own, so one that lies within a longer match of another is not hidden.
        A match is given where it can't go on.
        """
        a, state, length = self.automaton, 0, 0
        phrases, matches = [], []
        now: dict[int, tuple[int, list[int]]] = {}
        for k, w in enumerate([*words, -1]):
            while state and w not in a.step[state]:
                state = a.link[state]
                length = a.length[state]
            if w in a.step[state]:
                state, length = a.step[state][w], length + 1
            then = {t: (min(length, most), places) for t, most, places in self.long[state] if min(length, most) >= self.least[t]}
            for t, (n, places) in now.items():
                if t not in then or then[t][0] != n + 1:
                    matches.append((t, k - n, n, places))
            now = then
            phrases += [(p, k - n + 1) for p, n in self.here[state] if length >= n] if w >= 0 else []
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share) of the best chain of each template, from matches in text order.

        A chain's matches follow each other in the text, with at most GAP words between, and in the template. It covers
        the words of its first match and, of each further one, those that are new in the text and in the template.
        """
        of: dict[int, list[tuple[int, int, int]]] = {}  # template: start, end, place in the template
        for t, start, length, places in matches:
            of.setdefault(t, []).extend((start, start + length, k) for k in places)
        return [(t, *self._best_chain(found, self.sizes[t])) for t, found in of.items()]

    @staticmethod
    def _best_chain(found: list[tuple[int, int, int]], size: int) -> tuple[int, int, float]:
        covers: list[tuple[int, int]] = []  # of the best chain that ends with each match: words covered, minus its first word
        for k, (start, end, place) in enumerate(found):
            best = end - start, -start
            for j in range(k - 1, -1, -1):
                _, before, at = found[j]
                if before < start - GAP:  # ends ascend
                    break
                if before < end and at < place:
                    best = max(best, (covers[j][0] + min(end - start, place - at, end - before), covers[j][1]))
            covers.append(best)
        covered, first, end = max((c, f, -found[k][1]) for k, (c, f) in enumerate(covers))
        return -first, -end, covered / size

    def scan(self, texts: Texts) -> list[dict]:
        """Of each text: n_words, phrase places, and template spans."""
        words, owner = self.words(texts)
        counts = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(counts) - counts
        out = [{"n_words": int(c), "places": [], "matches": []} for c in counts]
        paired = (words[:-1] >= 0) & (words[1:] >= 0) & (owner[:-1] == owner[1:])
        at = np.flatnonzero(paired)
        at = at[self.pairs[words[at], words[at + 1]]]
        if len(at):
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            for group in np.split(at, breaks):
                a, b = int(group[0]), int(group[-1]) + 2
                text = int(owner[a])
                phrases, matches = self.stream(words[a:b].tolist())
                base = a - int(first[text])
                out[text]["places"] += [(p, base + s) for p, s in phrases]
                out[text]["matches"] += [(t, base + k, n, places) for t, k, n, places in matches]
        for row in out:
            row["spans"] = self.chains(row.pop("matches"))
        return out


@lru_cache(maxsize=2)
def scanner(phrases=PHRASES, templates=TEMPLATES) -> Scanner:
    return Scanner(phrases, templates)


SPANS = "array<struct<label: string, first_word: bigint, last_word: bigint, share: double>>"


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. Places of phrases
    count wherever they stand, even when they overlap; first_word and last_word are the smallest and largest start, null
    without any. `labels` adds those of templates of which a chain covers SHARE; score is the largest share of any
    template, or 1 where a phrase stands. A null text is an empty one. Repeated rows and null ids each give a row; other columns
    are ignored; an empty table gives no rows. Texts of any length are read whole, in slices of whole texts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(phrases, templates)
        for batch in batches:
            for part in slices(batch.column(1)):
                rows = []
                for got in own.scan(part):
                    starts = [s for _, s in got["places"]]
                    base = {own.labels[p] for p, _ in got["places"]}
                    full = [x for x in got["spans"] if x[3] >= SHARE]
                    rows.append({
                        "n_words": got["n_words"], "n_base": len(starts), "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {own.labels[x[0]] for x in full})),
                        "score": 1.0 if base else max((min(1.0, x[3]) for x in got["spans"]), default=0.0),
                        "spans": [{"label": own.labels[t], "first_word": a, "last_word": b - 1, "share": min(1.0, s)} for t, a, b, s in full],
                    })
                body = pa.RecordBatch.from_pylist(rows, schema=_BODY)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, len(part)), *body.columns], ["doc_id", *_BODY.names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"
    )


_BODY = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))),
])
