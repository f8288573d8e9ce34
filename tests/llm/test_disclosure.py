"""Terms that reveal personal data, over all documents, against a plain version."""

import hashlib
import math
import re

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import pii  # noqa: E402
from panelweft.llm.queries import QUERIES  # noqa: E402

MAIL = re.compile(r"[a-z]+@[a-z]+\.[a-z]+")


def plain(rows, wide=3):
    """doc_id -> (start, kind, end) of the terms, by whole documents: of documents with an address from one meeting on, of others from `wide` on."""
    word = lambda t: re.findall("[a-z0-9]+", t)
    held = {i: set(word(t)) for i, t in rows}
    own, beside = {}, {}
    for i, t in rows:
        for m in MAIL.finditer(t):
            own.setdefault(m[0], set()).add(i)
            for w in word(t[: m.start()])[-5:] + word(t[m.end() :])[:5]:
                beside.setdefault((m[0], w), set()).add(i)
    strength, everywhere = {}, {}
    for (e, w), docs in beside.items():
        if re.search("[a-z]", w):
            both, n = sum(w in held[i] for i in own[e]), sum(w in h for h in held.values())
            s = math.log(both * len(rows) / (n * len(own[e]))) / -math.log(both / len(rows))
            strength[w] = max(s, strength.get(w, -9))
            if len(docs) >= wide:
                everywhere[w] = max(s, everywhere.get(w, -9))
    out = {}
    for i, t in rows:
        table = strength if MAIL.search(t) else everywhere
        kind = {w: 5 if s >= pii.REMOVE else 4 for w, s in table.items() if s >= pii.GENERALISE}
        out[i] = sorted((m.start(), kind[m[0]], m.end()) for m in re.finditer("[a-z0-9]+", t) if m[0] in kind)
    return out


def test_one_person_in_one_document(spark):
    """A telling word beside a value that stands once goes there and where other people are named; a document without personal data keeps it."""
    draw = np.random.default_rng(7)
    filler = lambda n: " ".join(f"w{k}" for k in draw.integers(0, 30, n))
    rows = [(1, f"{filler(8)} zorblax of ada@mill.org {filler(8)}"), (2, f"{filler(9)} zorblax {filler(9)} bob@hill.net {filler(6)}"), (3, f"{filler(9)} zorblax {filler(9)}")]
    rows += [(100 + i, filler(20)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["_spans"] if s["kind"] > 3] for r in pii.spans(docs).collect()}
    assert got == plain(rows)
    word = lambda i: any(dict(rows)[i][a:b] == "zorblax" for a, _, b in got[i])
    assert word(1) and word(2) and not got[3] and not got[100]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[1] + clean[2] and clean[3] == rows[2][1]


def test_strong_terms_are_hidden_in_every_document(spark):
    draw = np.random.default_rng(6)
    filler = lambda n: " ".join(f"w{k}" for k in draw.integers(0, 30, n))
    rows = [(i, f"{filler(8)} zorblax of ada@mill.org {filler(8)}") for i in range(8)]
    rows += [(10, f"zorblax {filler(12)} ada@mill.org {filler(6)}"), (11, f"the zorblax {filler(9)}"), (12, filler(3) + " zorblaxes stay")]
    rows += [(20 + i, f"{filler(7)} quuxil {'x' * 450 + str(i)} bob@hill.net {'y' * 450 + str(i)} vornak {filler(9)}") for i in range(6)]
    rows += [(30, f"{filler(5)} quuxil {filler(5)} vornak"), (31, f"{filler(6)} bob@hill.net {filler(6)} quuxil vornak")]
    rows += [(100 + i, filler(20)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["_spans"] if s["kind"] > 3] for r in pii.spans(docs).collect()}
    assert got == plain(rows)
    assert got[11] and got[10] and len(got[30]) == 2 and len(got[31]) == 2 and not got[12] and not got[100]


def test_counts_of_the_query(spark):
    """Each kind's count is that of its spans, whatever the order that they stand in."""
    data = "/root/testdata/sf0.01"
    some = 0
    for r in QUERIES["op4_pii"](spark, data).collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        base = [s for s in r["spans"].split(",") if s and s.split(":")[0] in pii.PATTERNS]
        assert tuple(kinds.count(k) for k in pii.PATTERNS) == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert base or not kinds  # no document without personal data loses a word on this table
        some += bool(base)
    assert some > 30
