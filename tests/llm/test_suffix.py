"""Repeated byte strings against looking at every string."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import suffix  # noqa: E402


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, at int").repartition(3)
    got = {r["doc_id"]: r for r in suffix.removed(df, **options).collect()}
    assert len(got) == len(texts)
    want = suffix.brute([(t or "").encode() for t in texts], options.get("length", suffix.LENGTH))
    for i, (n, gone, spans, sha) in enumerate(want):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == (n, gone, spans, sha), i
    return want


def test_planted_passages(spark):
    draw = np.random.default_rng(11)
    word = lambda: "".join(draw.choice(list("abcdeéß"), draw.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(120)
    exact = passage.encode()[:200].decode("utf-8", "ignore")
    texts = [None, "", "ab", passage, prose(30) + passage + prose(30), passage[:-1] + "Q", other, prose(5) + other[40:], other[:300] + prose(9) + other[200:]]
    texts += [exact, exact + "z", "y" + exact[:-1], "a" * 199, "a" * 200, "a" * 700, "ab" * 400, "ab" * 99, prose(500), prose(500)]
    texts += [texts[-1], texts[-1][:900] + "#" + texts[-1][901:], prose(20) + "\n" + passage + "\n" + prose(20)]
    want = check(spark, texts)
    assert sum(w[1] for w in want) > 3000


def test_short_strings_of_small_alphabets(spark):
    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("ab"), draw.integers(0, 90))) for _ in range(60)]
    check(spark, texts, length=12, q=4, ranges=(9, 3, 1))
    check(spark, texts, length=9, q=8, ranges=(2, 1))
    check(spark, texts, length=16, q=5, ranges=(12, 6, 3, 1))


@pytest.mark.parametrize("ranges", [(161, 32, 8, 1), (9, 4, 1), (9, 3)])
def test_widths_have_to_divide(ranges):
    with pytest.raises(ValueError):
        suffix.widths(ranges[0] + 11, 12, ranges)
    assert suffix.widths() == (160, 32, 8, 1)


def test_one_text_does_not_repeat_itself(spark):
    draw = np.random.default_rng(7)
    letters = lambda n: "".join(draw.choice(list("abcdefghijklmnop"), n))
    long = letters(3000)
    texts = [long, letters(180) + long[700:740] + letters(180), letters(180) + long[900:940] + letters(180)]
    texts += [letters(100) + "#" + long[k : k + 199] + "#" + letters(100) for k in range(0, 2700, 190)]
    want = check(spark, texts)
    assert sum(w[1] for w in want) == 0


def hashed(texts, length=suffix.LENGTH):
    """(bytes, removed, runs, hash of the rest) of each text, from a hash of every string of all texts."""
    from panelweft.llm.common import prefix_sums, range_hashes

    own = []
    for t in texts:
        n = len(t) - length + 1
        own.append(range_hashes(prefix_sums(np.frombuffer(t, np.uint8)), np.arange(n), np.arange(n) + length) if n > 0 else np.zeros(0, np.uint64))
    every, times = np.unique(np.concatenate(own), return_counts=True)
    every = every[times > 1]
    out = []
    for t, h in zip(texts, own, strict=True):
        at = np.searchsorted(every, h)
        at[at == len(every)] = 0
        edges = np.zeros(len(t) + 1, np.int64)
        hit = np.flatnonzero(every[at] == h) if len(every) else at[:0]
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out.append((len(t), int(gone.sum()), len(runs) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_whole_tables(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/../{size}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.removed(docs).collect()}
    rows = docs.collect()
    want = hashed([(r["text"] or "").encode() for r in rows])
    assert len(got) == len(rows)
    assert [r["doc_id"] for r, w in zip(rows, want, strict=True) if got[r["doc_id"]] != w] == []


def test_real_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect()
    check(spark, [r[0] for r in rows])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix.removed(df).count() == 0


def test_texts_of_megabytes(spark):
    draw = np.random.default_rng(23)
    long = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), 3_000_000))
    texts = [long[:2_500_000] + long[1000:1500], "short " + long[2_400_000:2_400_450] + " end", "ab" * 1_200_000, long[2_600_000:2_600_199]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.removed(df).collect()}
    want = hashed([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert [w[1] for w in want] == [1450, 450, 2_400_000, 0]
