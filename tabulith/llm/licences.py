"""Licence scans with a generalised suffix automaton over the words of licence templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.kernels import PLAIN_WORDS, doc_chunks, hash_text, utf8, word_hashes, words

#: Phrases that are counted wherever their words stand in a row, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words of well-known licence notices and texts.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    (
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http
        www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    ),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-3-clause",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source
        code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names
        of its contributors may be used to endorse or promote products derived from this software without specific prior written permission""",
    ),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies""",
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions""",
    ),
    ("boost-1", "distributed under the boost software license version 1 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (
        "gpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source
        code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    ),
]
#: A match shorter than this many words is no evidence.
LEAST = 3
#: Share of a template's words that its chain must cover for its label; a template shorter than SHORT must be covered whole.
COVERED, SHORT = 0.8, 14


class SuffixAutomaton:
    """All substrings of several word sequences; ``ends`` has for each state where its strings end in which sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(dict(following))
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of ``state``'s longest string and ``word``, made apart from longer ones if need be."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], self.next[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest suffix that occurs in a sequence."""
        state = length = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


def chain(matches: list[tuple[int, int, int]], size: int) -> tuple[int, list[tuple[int, int]]]:
    """Most of a template's words that matches (doc end, template end, length) cover, in order in the text and in the template, and their spans in the text.

    For each template end the best chain so far is kept, so the work is the number of matches times the template's size; where words repeat much
    in a template, a chain that ends earlier in the text could rarely have led to more words.
    """
    best: dict[int, tuple[int, int, tuple | None]] = {0: (0, -1, None)}  # template end: (words, -doc end, (span, the chain before))
    for doc, end, length in sorted(set(matches)):
        for e, (got, d, before) in list(best.items()):
            if e < end and (e == 0 or -d < doc):
                own = min(length, end - e, doc + d) if e else length
                if (got + own, -doc) > best.get(end, (0, 0, None))[:2]:
                    best[end] = (got + own, -doc, ((doc - own, doc), before))
    words, _, link = max(best.values(), key=lambda x: x[:2])
    spans: list[tuple[int, int]] = []
    while link:
        spans.append(link[0])
        link = link[1]
    return min(size, words), spans[::-1]


class Scanner:
    """The automaton of the base phrases and of (label, words) templates."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        texts = [*BASE, *(t for _, t in templates)]
        self.labels = [*BASE.values(), *(label for label, _ in templates)]
        vocabulary = sorted({w for t in texts for w in t.split()})
        hashes = np.array([hash_text(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [[number[w] for w in t.split()] for t in texts]
        self.automaton = SuffixAutomaton(self.templates)
        # for each state: where in which template its suffixes end, with the length of the longest such suffix
        auto = self.automaton
        self.suffixes: list[list[tuple[int, int, int]]] = [[] for _ in auto.next]
        for state in sorted(range(1, len(auto.next)), key=auto.length.__getitem__):
            if auto.length[state] < LEAST:
                continue
            longer = [(n, end, auto.length[state]) for n, end in auto.ends[state] - {x[:2] for x in self.suffixes[auto.link[state]]}]
            own = {x[:2] for x in longer}
            # a suffix that ends at the same place of the same template counts with the longest state that has it
            kept = [(n, end, max(cap, auto.length[state]) if (n, end) in auto.ends[state] else cap) for n, end, cap in self.suffixes[auto.link[state]] if (n, end) not in own]
            self.suffixes[state] = longer + kept

    def members(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def scan(self, ids: np.ndarray, offset: np.ndarray) -> dict:
        """Base places (phrase, first word), coverage of each template and its spans, from runs (ids, position of the first word)."""
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for run, start in zip(ids, offset, strict=True):
            on: dict[tuple[int, int], tuple[int, int]] = {}  # (template, diagonal): end in the text, length
            for i, (state, length) in enumerate(self.automaton.statistics(run), start + 1):
                if length < LEAST:
                    continue
                for n, end, cap in self.suffixes[state]:
                    size = min(length, cap)
                    if size >= LEAST:
                        key = (n, i - end)
                        if key in on and on[key][0] < i - 1:
                            matches.setdefault(n, []).append((on[key][0], on[key][0] - key[1], on[key][1]))
                        on[key] = (i, size)
                        if n < len(BASE) and end == size == len(self.templates[n]):
                            places.append((n, i - size))
            for (n, diagonal), (i, size) in on.items():
                matches.setdefault(n, []).append((i, i - diagonal, size))
        chains = {n: chain(m, len(self.templates[n])) for n, m in matches.items()}
        covered = {n: words / len(self.templates[n]) for n, (words, _) in chains.items()}
        return {"places": places, "covered": covered, "spans": {n: spans for n, (_, spans) in chains.items()}}

    def enough(self, n: int, share: float) -> bool:
        return share >= (COVERED if len(self.templates[n]) >= SHORT else 1.0)

    def covered(self, got: dict) -> list[int]:
        """The templates covered far enough, without those whose spans lie inside the spans of a better covered template of another label."""
        more = [n for n, share in got["covered"].items() if self.enough(n, share)]

        def beaten(n: int) -> bool:
            own = got["spans"][n]
            for m in more:
                if self.labels[m] != self.labels[n] and got["covered"][m] > got["covered"][n] and all(any(a <= c and d <= b for a, b in got["spans"][m]) for c, d in own):
                    return True
            return False

        return [n for n in more if not beaten(n)]


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def _scan(templates: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            yield _scan_batch(scanner, batch)

    return run


def _scan_batch(scanner: Scanner, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = utf8(batch[1])
    out: list[tuple] = []
    for a, b in doc_chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at, PLAIN_WORDS)
        ids = scanner.members(word_hashes(part, starts, ends))
        known = ids >= 0
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        begin = np.flatnonzero(known & ~(np.concatenate([[False], known[:-1]]) & ~edge[:-1])) if len(ids) else np.zeros(0, np.int64)
        end = np.flatnonzero(known & ~(np.concatenate([known[1:], [False]]) & ~edge[1:])) + 1 if len(ids) else np.zeros(0, np.int64)
        long = end - begin >= LEAST
        begin, end = begin[long], end[long]
        which = np.searchsorted(begin, first)
        for i in range(b - a):
            lo, hi = which[i], which[i + 1]
            n = int(first[i + 1] - first[i])
            if lo == hi:
                out.append((n, 0, None, None, "", "", 0.0, []))
                continue
            got = scanner.scan([ids[s:e].tolist() for s, e in zip(begin[lo:hi], end[lo:hi], strict=True)], (begin[lo:hi] - first[i]).tolist())
            at_ = [p for _, p in got["places"]]
            base = {scanner.labels[x] for x, _ in got["places"]}
            more = scanner.covered(got)
            spans = sorted({(s, e - s, scanner.labels[x]) for x in more for s, e in got["spans"][x]})
            score = max([0.0, *got["covered"].values()])
            labels = ",".join(sorted(base | {scanner.labels[x] for x in more}))
            out.append((n, len(at_), min(at_, default=None), max(at_, default=None), ",".join(sorted(base)), labels, score, [{"label": label, "first_word": s, "n_words": k} for s, k, label in spans]))
    columns = list(zip(*out, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([batch[0].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _OUT.types[1:], strict=True))], schema=_OUT)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each document: word count, base places and labels, labels of covered templates, best coverage as score, covered spans.

    Words are lowered runs of letters, digits and non-ASCII characters.  Words outside the templates end every match, so only runs of at
    least LEAST template words are streamed through the automaton.  ``spans`` has label, first word and number of words of each stretch of the
    text that the chain of a covered template takes; of templates that differ in a word or two, such as those of the GPL and the LGPL, the better covered one counts.
    ``templates`` are rows (label, lowered words between blanks); they travel with the code, so they
    are to be licence texts, not a corpus.  A null or empty text has no words and no labels;
    null ids and repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(templates), kinds)


def op6_licences(docs: DataFrame) -> DataFrame:
    return scan_licences(docs).withColumn("spans", F.to_json("spans"))
