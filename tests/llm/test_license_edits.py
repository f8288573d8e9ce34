"""The fuzzy license search against a table of the edit distances of all substrings."""

import time

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import license  # noqa: E402

NOTICES = ["all rights reserved", "gnu general public license", "this work is licensed under a creative commons", "mozilla public license", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "you can redistribute it and/or modify it under the terms of the gnu general public license"]


def table(text, notice):
    """distance[a, b] of the notice to text[a:b], for a <= b."""
    n, m = len(text), len(notice)
    out = np.full((n + 1, n + 1), m + n, int)
    own = np.array([ord(c) for c in notice])
    column = np.tile(np.arange(m + 1), (n + 1, 1))  # a row per start
    out[np.arange(n + 1), np.arange(n + 1)] = m
    for length in range(1, n + 1):
        starts = np.arange(n + 1 - length)
        old = column[: len(starts)]
        letters = np.array([ord(text[a + length - 1]) for a in starts])
        new = np.empty_like(old)
        new[:, 0] = length
        near = np.minimum(old[:, :-1] + (letters[:, None] != own[None, :]), old[:, 1:] + 1)
        for i in range(m):
            new[:, i + 1] = np.minimum(near[:, i], new[:, i] + 1)
        column = new
        out[starts, starts + length] = new[:, m]
    return out


def edited(draw, notice, n):
    out = list(notice)
    for _ in range(n):
        i, what = int(draw.integers(len(out))), draw.integers(3)
        if what == 0:
            out[i] = chr(int(draw.integers(97, 123)))
        elif what == 1:
            out.insert(i, chr(int(draw.integers(97, 123))))
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def texts():
    draw = np.random.default_rng(12)
    filler = lambda k: "".join(chr(int(c)) for c in draw.choice([32, 97, 99, 101, 105, 108, 110, 115], k))
    out = ["", "license license license license", "public license public license general public", "gnu gnu general public general public license license", "a" * 40]
    for notice in NOTICES:
        e = license.edits_of(notice)
        for n in (0, 1, e, e + 1, e + 3):
            out.append(filler(7) + edited(draw, notice, n) + filler(9))
        out.append(edited(draw, notice, 1) + edited(draw, notice, e)[: len(notice)])
    return out


def test_matches_are_those_of_the_distance_table():
    search = license.Searcher(NOTICES)
    found = 0
    for text in texts():
        got = search(text)
        for notice in NOTICES:
            distance, e = table(text, notice), license.edits_of(notice)
            mine = [(a, b, n) for x, a, b, n in got if x == notice]
            for a, b, n in mine:  # edits and spans are right: no false match
                assert distance[a, b] == n <= e
            assert all(p[1] <= q[0] for p, q in zip(mine, mine[1:], strict=False))
            places = np.argwhere(distance <= e)
            assert bool(len(places)) == bool(mine), (text, notice)
            if mine:
                assert min(n for *_, n in mine) == distance.min()
                found += 1
            for a, b in places.tolist():  # nothing within the bound is far from a match that is reported
                assert any(p < b + len(notice) and a - len(notice) < q for p, q, _ in mine)
            assert license.least_edits(notice, text) == distance.min()
    assert found > 30


def test_text_that_repeats_itself_is_cheap():
    search = license.Searcher(list(license.NOTICES))
    start = time.process_time()
    assert search("license " * 20_000) == [] and search("public license " * 20_000) == []
    assert time.process_time() - start < 10
    assert len(search("gnu general public license " * 2000)) == 2000


def test_starts_that_seeds_agree_on():
    assert license.agreed([], 2) == []
    assert license.agreed([(5, 0), (5, 0), (6, 0)], 2) == []
    assert license.agreed([(1, 0), (5, 1), (9, 0), (14, 1)], 2) == [1, 5]
    assert license.agreed([(5, 0), (5, 1), (5, 1)], 0) == [5]
