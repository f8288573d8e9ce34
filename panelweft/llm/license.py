"""License scan: exact phrases and a fuzzy search for short notices.

Exact phrases are found as consecutive words. The fuzzy search splits every notice into AGREE seeds more than its edits (pigeonhole:
so many of them stand unedited), finds the seeds of all notices with one automaton, and looks where AGREE different ones agree on the
notice's start, as far as its edits can shift them. There the least number of edits of any match is counted by one column of bits a
character; if the notice may have so many, the regex library's bounded-error matching, with that number as its bound, verifies the edits
and reports the span. A notice may have one edit in TOLERANCE characters. A window of the same characters is verified once, so text that
repeats itself costs no more than its different windows.

Defined cases: null or empty text has no words, no labels and score 0; overlapping places of phrases count each; of overlapping
matches of one notice the one of fewest edits stays, then the leftmost, then the shortest; the score is 1 with an exact phrase, else
1 - edits / notice length of the best verified notice, else 0; a fuzzy label ends in `~`; rows of equal or null doc_id are searched
each; an empty table has no rows; other columns play no part; texts may be of any length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ALNUM, LOWER, only, steps, word_hashes, word_spans

#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices of the fuzzy search and their labels.
NOTICES = {
    "gnu general public license": "gpl~",
    "you can redistribute it and/or modify it under the terms of the gnu general public license": "gpl~",
    "gnu lesser general public license": "lgpl~",
    "gnu affero general public license": "agpl~",
    "licensed under the apache license": "apache~",
    "you may not use this file except in compliance with the license": "apache~",
    "released under the mit license": "mit~",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit~",
    "mozilla public license": "mpl~",
    "subject to the terms of the mozilla public license": "mpl~",
    "creative commons attribution": "cc-by~",
    "this work is licensed under a creative commons": "cc~",
    "redistribution and use in source and binary forms": "bsd~",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc~",
    "eclipse public license": "epl~",
    "this is free and unencumbered software released into the public domain": "unlicense~",
    "boost software license": "boost~",
    "all rights reserved": "copyright~",
}
#: Characters of a notice for each edit that it may have, and different seeds that have to agree on where it starts.
TOLERANCE, AGREE = 9, 2
#: Verified windows that a task remembers at a time.
REMEMBERED = 20_000
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(_SPAN))]
)
_SQL = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,end:bigint,edits:int>>"


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """edits + AGREE pieces of the notice and where each starts."""
    n = edits + AGREE
    cuts = [round(i * len(notice) / n) for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def edits_of(notice: str) -> int:
    return len(notice) // TOLERANCE


def agreed(hits: list[tuple[int, int]], edits: int) -> list[int]:
    """Of (start that a seed implies, seed) in order: the starts with AGREE different seeds between them and 2 * edits later."""
    out, counts, distinct, end = [], {}, 0, 0
    for start, seed in hits:
        while end < len(hits) and hits[end][0] <= start + 2 * edits:
            counts[hits[end][1]] = counts.get(hits[end][1], 0) + 1
            distinct += counts[hits[end][1]] == 1
            end += 1
        if distinct >= AGREE and (not out or out[-1] != start):
            out.append(start)
        counts[seed] -= 1
        distinct -= counts[seed] == 0
    return out


def least_edits(notice: str, window: str) -> int:
    """The edit distance of the notice to the substring of the window that is nearest to it."""
    m = len(notice)
    every, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(notice):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best = every, 0, m, m
    for c in window:
        same = masks.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        rises, falls = down | (every & ~(level | up)), up & level
        score += bool(rises & top) - bool(falls & top)
        best = min(best, score)
        rises, falls = rises << 1, falls << 1
        up, down = (falls | ~(same | down | rises)) & every, rises & (same | down) & every
    return best


class Searcher:
    """All verified notices of a lower-cased text: (notice, start, end, edits), spans in code points, end exclusive."""

    def __init__(self, notices: list[str]):
        self.notices = [(n, edits_of(n)) for n in notices]
        self.patterns: dict[tuple[int, int], regex.Pattern] = {}
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        places: dict[str, list] = {}
        for k, (notice, edits) in enumerate(self.notices):
            for j, (seed, at) in enumerate(seeds(notice, edits)):
                places.setdefault(seed, []).append((k, j, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best match of notice k in a window."""
        key = k, window
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            notice, edits = self.notices[k]
            self.known[key] = None
            if (n := least_edits(notice, window)) <= edits:
                if (k, n) not in self.patterns:
                    self.patterns[k, n] = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={n}}}")
                if m := self.patterns[k, n].search(window):
                    self.known[key] = (sum(m.fuzzy_counts), m.start(), m.end())
        return self.known[key]

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, j, at in where:
                # Where the notice starts, if nothing before the seed is edited.
                hits.setdefault(k, []).append((end + 1 - size - at, j))
        found = []
        for k, starts in hits.items():
            notice, edits = self.notices[k]
            matches = set()
            for at in agreed(sorted(starts), edits):
                low = max(0, at - edits)
                if m := self.best(k, text[low : max(0, at + len(notice) + 2 * edits)]):
                    matches.add((m[0], low + m[1], low + m[2]))
            taken: list[tuple[int, int]] = []
            for n, a, b in sorted(matches):
                i = bisect.bisect(taken, (a, b))
                if (not i or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.append((notice, a, b, n))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (the fuzzy spans)."""

    def hashes(text: str) -> tuple[np.ndarray, list[bytes]]:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
        return word_hashes(data, starts, ends), [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(list(notices))
        exact = [(*hashes(p), label) for p, label in phrases.items()]
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                low = LOWER[data]
                starts, ends, firsts = word_spans(low, offsets, ALNUM)
                words = word_hashes(low, starts, ends)
                places: list[list[tuple[int, str]]] = [[] for _ in range(b - a)]
                for own, text, label in exact:
                    n = len(words) - len(own) + 1
                    hit = np.ones(max(n, 0), bool)
                    for k in range(len(own)):
                        hit &= words[k : k + len(hit)] == own[k]
                    for at in np.flatnonzero(hit).tolist():
                        doc = int(np.searchsorted(firsts, at, "right")) - 1
                        if at + len(own) <= firsts[doc + 1] and all(low[starts[at + k] : ends[at + k]].tobytes() == w for k, w in enumerate(text)):
                            places[doc].append((at - int(firsts[doc]), label))
                raw = low.tobytes()
                out: dict[str, list] = {f.name: [] for f in _OUT}
                for i in range(b - a):
                    fuzzy = search(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
                    own = places[i]
                    base = {x for _, x in own}
                    out["n_words"].append(int(firsts[i + 1] - firsts[i]))
                    out["n_base"].append(len(own))
                    out["first_word"].append(min((p for p, _ in own), default=None))
                    out["last_word"].append(max((p for p, _ in own), default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | {notices[x[0]] for x in fuzzy})))
                    out["score"].append(1.0 if own else max((1 - x[3] / len(x[0]) for x in fuzzy), default=0.0))
                    out["matches"].append([{"label": notices[x[0]], "start": x[1], "end": x[2], "edits": x[3]} for x in fuzzy])
                out["doc_id"] = batch.column(0)[a:b].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _OUT], schema=_OUT)

    return only(docs, "doc_id", "text").mapInArrow(run, _SQL)
