"""Jaccard components against all pairs."""

import re
import uuid

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import common, jaccard  # noqa: E402


def brute(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append((doc_id, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 90 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return sorted((a is None, a or 0, len(x), least.get(root(i)) or 0) for i, (a, x) in enumerate(sets))


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id bigint, text string, n int, cls int").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.components(df, **options).collect())
    assert got == brute(rows)
    return got


def made(draw, near=60):
    word = lambda: "".join(draw.choice(list("abcdefgh"), draw.integers(2, 7)))
    base = [word() for _ in range(150)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Just TWO"), (5, "just two"), (6, "just"), (None, "just two"), (None, None), (7, "a a a a a a"), (8, "a a a"), (8, "b b b b")]
    for k in range(near):
        own = list(base)
        for _ in range(int(draw.integers(0, 4))):
            own[int(draw.integers(0, len(own)))] = word()
        rows.append((100 + k, " ".join(own[int(draw.integers(0, 4)) :])))
    passage = " ".join(word() for _ in range(60))
    rows += [(500 + k, " ".join(word() for _ in range(80)) + " " + passage) for k in range(30)]
    rows += [(700 + k, " ".join(base)) for k in range(40)]
    return rows


def test_copies_and_edges(spark):
    check(spark, made(np.random.default_rng(2)))


def test_hot_shingles_in_small_tries(spark):
    got = check(spark, made(np.random.default_rng(3), 90), block=700, few=1)
    assert len({r[3] for r in got if 100 <= r[1] < 200}) > 1


def test_real_rows(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty_and_kept(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.components(df).count() == 0
    df = spark.createDataFrame([(3, "a b c d"), (1, "A b c d"), (2, "q r s t"), (None, "a b c d")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(df).collect()) == [0, 1, 2]


def test_a_passage_that_thousands_share_ties_nothing(spark, tmp_path, monkeypatch):
    """2,000 different texts around one passage, and 300 near copies of one text: no work that grows with their square."""
    draw = np.random.default_rng(6)
    word = lambda: "".join(draw.choice(list("abcdefghijkl"), 6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(160)]
    rows = [(k, " ".join([word() for _ in range(70)] + passage)) for k in range(2000)]
    for k in range(300):
        own = list(base)
        for _ in range(int(draw.integers(0, 3))):
            own[int(draw.integers(0, len(own)))] = word()
        rows.append((5000 + k, " ".join(own)))
    monkeypatch.setattr(common, "folder", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(df).collect()}
    assert all(got[k] == k for k in range(2000))
    assert len({got[5000 + k] for k in range(300)}) < 20
    sizes = {}
    for f in tmp_path.rglob("*.parquet"):
        name = f.parent.name.rsplit("-", 1)[0]
        sizes[name] = sizes.get(name, 0) + f.stat().st_size
    text = sum(len(t) for _, t in rows)
    # The sets of candidates travel once or twice; the passage makes no pairs.
    assert sizes["jaccard-sets"] < 0.5 * text and sizes["jaccard-pairs"] < 100_000
    assert sum(sizes.values()) < 4 * text


def test_repeated_ids_are_judged_by_their_own_text(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (7, b, "z"), (None, a, "n"), (None, None, "m"), (9, None, "o")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string").withColumn("key", df_lit()).withColumn("_maybe", df_lit())
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["a.b"] for r in kept.collect()) == ["m", "n", "o", "x", "z", "z"]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("k")
