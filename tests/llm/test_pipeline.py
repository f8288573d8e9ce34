"""Stages of the corpus pipeline against plain versions."""

import re

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

import corpus_pipeline  # noqa: E402
from panelweft.llm import bpe, decontamination  # noqa: E402


def smallest_of_near_copies(rows, like=80, size=5):
    """doc_ids that are the smallest of their component, from all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text.translate({i: i + 32 for i in range(65, 91)}))
        sets[doc_id] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}
    least = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a, x in sets.items():
            for b, y in sets.items():
                if least[b] < least[a] and 100 * len(x & y) >= like * len(x | y):
                    least[a], moved = least[b], True
    return {i for i in sets if least[i] == i}


def test_near_copies_at_five_words_and_four_fifths(spark, sf):
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 6))
    rows = []
    for k in range(12):
        base = [word() for _ in range(100)]
        longer = base + [word() for _ in range(4 + 2 * k)]  # likeness 0.96 down to 0.79
        edited = list(base)
        for at in draw.choice(100, 1 + k % 4, replace=False):
            edited[at] = word()
        rows += [(10 * k + i, " ".join(w)) for i, w in enumerate((base, longer, edited))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    want = smallest_of_near_copies(rows)
    assert kept == want
    # Rows that only the limits of the thin query would keep.
    assert smallest_of_near_copies(rows, 90, 3) - want


def test_rows_are_decontaminated_by_their_own_text(spark):
    item = "which of the seven bright rivers runs north past the old mill"
    rows = [(None, f"so {item} then", 1), (None, "a clean row", 2), (None, None, 3), (5, f"{item}", 4), (5, "another clean row", 5), (5, "another clean row", 6), (0, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
    benchmark = spark.createDataFrame([("q", item)], "item_id string, text string")
    assert sorted(r["n"] for r in decontamination.clean(docs, benchmark).collect()) == [2, 3, 5, 6, 7]


AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, _text string, _maybe int, `a.b` string"


def awkward(spark):
    draw = np.random.default_rng(12)
    word = lambda: "".join(draw.choice(list("aeioubcdfgklmnprst"), int(draw.integers(2, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = prose(9000)
    texts = [None, "", "   ", "a", prose(80), long, "x" * 5000, "mail ann@mill.org or +1 (555) 222-3334, " + prose(60), "don't \u00e9\u4f60\u597d \U0001f642 " + prose(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, t) for t in texts] + [(4, texts[4]), (4, texts[4]), (4, prose(50)), (30, texts[4]), (31, long + " more")]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "k", 1, "t", 2, f"r{n}") for n, (i, t) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, AWKWARD).repartition(3)


def test_every_stage_on_awkward_rows_and_on_none(spark, sf):
    import public_tokenizers as P
    import tiktoken

    rows, docs = awkward(spark)
    at = lambda df: sorted(r["a.b"] for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns == none.columns
    text = {r[-1]: r[1] for r in rows}

    near = set(at(corpus_pipeline.drop_near_copies(spark, docs, sf)))
    gone = {r for r in text if r not in near}
    # Copies of a smaller doc_id go, each by its own text; rows without a doc_id stay.
    assert gone == {f"r{n}" for n, r in enumerate(rows) if r[0] in (30, 31)}

    clean = {r["a.b"]: r for r in corpus_pipeline.hide_personal_data(spark, docs, sf).collect()}
    assert clean.keys() == text.keys()
    for k, r in clean.items():
        assert (r["_text"], r["_maybe"], r["key"], r["row"]) == ("t", 2, "k", 1)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert "ann@mill.org" not in (r["text"] or "") and "555" not in (r["text"] or "")
        if "ann@" not in (text[k] or ""):
            assert r["text"] == text[k]

    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(ranks, P.PATTERN).ranks, special_tokens={})
    want = sorted((r[0] is None, r[0] or 0, plain.encode_ordinary(r[1] or "")) for r in rows)
    got = corpus_pipeline.encode(spark, docs, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in got) == want
    assert all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_the_whole_pipeline_is_its_stages_in_turn(spark, sf):
    """run() over the smallest tables against plain versions of what each stage decides."""
    from panelweft.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    kept = smallest_of_near_copies([(i, t) for i, t in text.items() if i in good and t.split()]) | {i for i in good if not text[i].split()}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(min(10, len(w)), set()).add(tuple(w[k : k + 10]))
    dirty = lambda w: any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1))
    want = {i for i in kept if not dirty(words(text[i]))}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == want and 0 < len(want) < len(text)
    assert all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in got.values())
