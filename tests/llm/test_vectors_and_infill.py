"""Hard negatives, nearest neighbours and fill-in-the-middle against plain versions, on real rows and on awkward ones."""

import hashlib
import math
import re

import numpy as np
import pytest

pl = pytest.importorskip("panelweft.llm")

from panelweft.llm import infill, nearest, negatives  # noqa: E402
from panelweft.llm.queries import QUERIES  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<double>, label int, salt string, rank int, score double, query string, width int, `list` int"


def frame(spark, rows):
    """Rows with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(*r, "x", 1, 2.0, "q", 3, 4) for r in rows], SCHEMA).repartition(5)


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, every, k=5):
    rows = [(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows if i is not None and c is not None and ok(v)]
    out = set()
    for a, v, c in {r for r in rows if r[0] % every == 0}:
        pairs = sorted({(-sum(x * y for x, y in zip(v, w, strict=True)), i, d == c) for i, w, d in rows if i != a and len(w) == len(v)})
        positives = [p for p in pairs if p[2]][:k]
        for ps, p, _ in positives:
            window = [(n, -ns) for ns, n, same in pairs if not same and 80 * -ps <= 100 * -ns <= 100 * -ps][:k]
            out |= {(a, p, r + 1, n, -ps, ns) for r, (n, ns) in enumerate(window)}
    return sorted(out)


def awkward(seed, n, width, levels):
    """Many ties, repeated rows, one hot vector, and every kind of row that takes no part."""
    draw = np.random.default_rng(seed)
    rows = [(i, (draw.integers(-levels, levels + 1, width) / levels).tolist(), int(draw.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(n // 2)] + rows[:7] * 3
    rows += [(2000, None, 1), (2010, [0.1] * width, None), (None, [0.2] * width, 1), (2020, [float("nan")] * width, 1), (2030, [float("inf")] + [0.0] * (width - 1), 1)]
    rows += [(2040, [None] + [0.0] * (width - 1), 1), (2050, [], 1), (2051, [], 1), (2052, [], 2), (2060, [0.3] * (width + 1), 1), (2061, [0.3] * (width + 1), 1), (2062, [0.3] * (width + 1), 0)]
    return rows + [(2070, [0.0] * width, 2), (10, [0.25] * width, 2), (-20, [0.5] * width, 0)]


@pytest.mark.parametrize(("seed", "width", "levels"), [(1, 4, 2), (2, 3, 64), (3, 1, 1)])
def test_negatives_equal_a_plain_version(spark, seed, width, levels):
    rows = awkward(seed, 120, width, levels)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(set(map(tuple, got.collect()))) == plain_negatives(rows, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_large_components_are_exact(spark):
    draw = np.random.default_rng(5)
    for size in (1e4, 3e6):  # in double precision, and beyond it
        rows = [(i, (draw.random(3) * size).tolist(), i % 2) for i in range(40)]
        got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)
    rows = [(i, [1e300 * (1 + i % 3), 1e300], i % 2) for i in range(12)]
    assert {r["positive_score"] for r in negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()} == {(1 << 63) - 1}


def test_negatives_of_nothing(spark):
    rows = awkward(4, 20, 2, 3)
    assert negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(frame(spark, rows), F.col("vec_id") == 77777).collect() == []
    with pytest.raises(ValueError, match="window"):
        negatives.mine(frame(spark, rows), F.col("vec_id") == 0, low=80, high=120)


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    rows = awkward(6, 90, 4, 2)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(set(map(tuple, got.collect()))) == plain_negatives(rows, 10)


def test_anchors_do_not_pass_through_the_driver(spark):
    """A copy of the blocks for each part of the rows is many times what Spark takes their size for: it may not be broadcast."""
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(0, 0.2, 64).tolist(), i % 3) for i in range(200)]
    limits = {"spark.sql.maxBroadcastTableSize": "65536", "spark.sql.shuffle.partitions": "24"}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        got = negatives.mine(frame(spark, rows), F.col("vec_id") % 4 == 0)
        assert sorted(set(map(tuple, got.collect()))) == plain_negatives(rows, 4)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("held", [1, 4, 1000])
def test_groups_of_blocks_do_not_matter(spark, monkeypatch, held):
    rows = awkward(7, 90, 4, 2)
    for name, value in (("CHUNK", 7), ("BLOCK", 3), ("HELD", held)):
        monkeypatch.setattr(negatives, name, value)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(set(map(tuple, got.collect()))) == plain_negatives(rows, 10)


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (2, 50), (3, 5e4), (4, 5e8)])
def test_running_windows_equal_sorted_ones(seed, size):
    """Many runs of rows, ties, repeated ids; in single and double precision, and beyond it."""
    draw, k = np.random.default_rng(seed), 3
    whole = lambda n: np.floor(draw.random((n, 2)) * size)
    own, a, least = np.arange(6), whole(6), np.array([[0, 1], [0, 9], [5, 0], [0, 0], [0, 0], [0, 0]]) * int(size) * int(size) // 9
    most = least + int(size * size) // 2
    most[3, 1] = -1  # no window
    tile = negatives._Tile(own, own % 2, own + 100, a, negatives._lengths(a), least, most, k)
    want = {n: set() for n in range(6)}
    seen = []
    for _ in range(4):
        n = 700 if size < 1e6 else 60
        ids, labels, x = draw.integers(0, n, n), draw.integers(0, 2, n), whole(n)
        seen += list(zip(ids.tolist(), labels.tolist(), x.tolist(), strict=True))
        tile.meet(ids, labels, x, negatives._lengths(x), True)
    for n in range(6):
        pairs = sorted({(-sum(int(p) * int(q) for p, q in zip(a[n], x, strict=True)), i) for i, c, x in seen if i != n and c != n % 2})
        for low, high in zip(least[n].tolist(), most[n].tolist(), strict=True):
            want[n] |= {(-s, i) for s, i in [p for p in pairs if low <= -p[0] <= high][:k]}
    got = {n: set() for n in range(6)}
    for key, anchor in tile.keys(True):
        code, score, vec_id, other = negatives._read(key)
        assert code == anchor + 100 and other
        got[anchor].add((score, vec_id))
    assert got == want


def test_a_positive_after_negatives_of_its_score(spark):
    """The window takes the first negatives of its own score, though their ids come before the positive's."""
    rows = [(0, [1.0], 0), (50, [0.5], 0)] + [(i, [0.5], 1) for i in range(1, 9)] + [(60, [0.45], 1), (61, [0.3], 1)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") == 0, negatives=9)
    assert [(r["positive_id"], r["negative_id"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(50, i) for i in [*range(1, 9), 60]]


def plain_nearest(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and ok(v) and any(v)]
    out = {}
    for a, v in rows:
        if a % every == 0:
            out.setdefault(a, []).append(sorted({(-float((v * w).sum()), i) for i, w in rows if i != a and len(w) == len(v)})[:k])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_on_awkward_rows(spark, seed, monkeypatch):
    """With all lists probed nothing may be lost; cells, blocks and steps are made small so that every path runs."""
    for name, value in (("ROWS", 16), ("QUERIES", 5), ("_STEP_QUERIES", 3), ("_STEP_ROWS", 8), ("COLUMNS", 3)):
        monkeypatch.setattr(nearest, name, value)
    rows = [(i, v and [x and 100 * x if i == 5 else x for x in v], c) for i, v, c in awkward(seed, 80, 8, 4)]
    got = nearest.search(frame(spark, rows), F.col("vec_id") % 10 == 0, 7, target=1.0)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = plain_nearest(rows, 10, 7)
    one = {a: lists[0] for a, lists in want.items() if len({tuple(x) for x in lists}) == 1 and lists[0]}
    assert {a: [i for _, i in x] for a, x in found.items() if a in one} == {a: [i for _, i in x] for a, x in one.items()}
    assert all(abs(p - q) < 1e-12 for a in one for (p, _), (q, _) in zip(found[a], one[a], strict=True))


def test_nearest_of_nothing_and_of_few(spark):
    rows = awkward(4, 20, 2, 3)
    assert nearest.search(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert nearest.search(frame(spark, rows), F.col("vec_id") == 77777).collect() == []
    assert [tuple(r) for r in nearest.search(frame(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)]), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert nearest.search(frame(spark, [(0, [1.0, 0.0], 0)]), F.col("vec_id") == 0).collect() == []


def test_recall_of_the_query(spark):
    import pyarrow.parquet as pq

    data = "/root/testdata/sf0.1"
    table = pq.read_table(f"{data}/embeddings.parquet").to_pandas()
    rows = list(zip(table["vec_id"].tolist(), table["embedding"].tolist(), table["label"].tolist(), strict=True))
    want = plain_nearest(rows, 20, 20)
    got = QUERIES["op13_nearest"](spark, data).collect()
    exact = {(a, i): -s for a, lists in want.items() for s, i in lists[0]}
    hits = [r for r in got if (r["query_id"], r["vec_id"]) in exact]
    assert len(got) == len(exact)
    assert len(hits) / len(exact) >= 0.9
    assert all(abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-12 for r in hits)


def test_the_dimension_test_keeps_near_rows():
    """Of the true neighbours under a bound, hardly one is abandoned, and most far rows are."""
    draw = np.random.default_rng(3)
    x = draw.standard_normal((4000, 63)) * np.r_[np.full(8, 4.0), np.full(55, 0.2)]
    y = nearest.raised(x, nearest.norms(x).max())
    turn = nearest.rotation(64)
    q = nearest.asked(x[:40]) @ turn
    distances = ((nearest.asked(x[:40])[:, None] - y[None]) ** 2).sum(axis=2)
    bound = np.sort(distances, axis=1)[:, 20]
    i, j = nearest.survivors(q, y @ turn, bound)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    true = {(a, b) for a in range(40) for b in np.flatnonzero(distances[a] <= bound[a]).tolist()}
    assert len(true - kept) <= len(true) // 500
    assert len(kept) == len(kept & true)  # after the last block the whole distance decides


TEXTS = [
    None, "", "\n", "\n\n\n", "no end", "a\r\nb\r\n", "<P>x\ny", "x<S>", "a\n<M>\n", "<\n<S\n<M\n>\nP>\nS>", "$1\\2\n$2\n\\E\\Q", "x y\u0085z\n\U0001f642\U0001f642\né", "\x00\n\x00",
    "<<\n<S<\nM>", "ab\n" * 700_000, "z" * 4_000_000, "\n" * 1_500_000, "q" * 2_000_000 + "\n" + "w" * 2_000_000,
]


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(t in text for t in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_a_plain_version(spark):
    import pyarrow.parquet as pq

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows += [(-k - 1, t) for k, t in enumerate(TEXTS)] + [(None, "a\nb\n"), (-1000, "twice\nthe same\n"), (-1000, "twice\nthe same\n")]
    rows += [(-2000 - k, "<\n<S\nx<M\n>\nP>\n<<\n") for k in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, text string, n int, form string, output string").repartition(6)
    out = infill.transform(docs).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("again", 256)).collect()), key=key)
    want = []
    for i, t in rows:
        *head, text = plain_infill(i, t)
        want.append((i, *head, sha(text), sha(t or "")))
    assert got == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_rates_and_nothing(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id bigint, text string")
    assert infill.transform(docs.limit(0)).collect() == []
    assert {r["form"] for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in infill.transform(docs, spm_rate=0).collect()} == {"psm"}
    forms = [r["form"] for r in infill.transform(docs, rate=50).collect()]
    assert 100 < forms.count("plain") < 200
