"""Fingerprints, language and quality models against plain loops."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import fingerprint, language, quality  # noqa: E402
from panelweft.llm.common import prefix_sums, range_hashes  # noqa: E402


def prose(draw, letters, n):
    word = lambda: "".join(draw.choice(list(letters), draw.integers(1, 9)))
    return " ".join(word() for _ in range(n))


def out_of_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


# --- fingerprints


def level(window):
    n = Counter(window)
    h = math.log2(len(window)) - sum(round(k * math.log2(k) * 1e6) for k in n.values()) / 1e6 / len(window)
    return min(max(round(h / math.log2(len(window)) * 1000), 0), 1000)


def plain_chain(text, ranks):
    w = fingerprint.WIDTH
    if not text:
        return 0, []
    if len(text) < w:
        features = [(0, len(text))]
    else:
        own = [ranks[level(text[i : i + w])] for i in range(len(text) - w + 1)]
        points = Counter(min(range(i, i + w), key=lambda j: (own[j], j)) for i in range(len(own) - w + 1))
        at = [i for i in range(len(own)) if points[i] >= fingerprint.POPULAR] or [min(range(len(own)), key=lambda j: (own[j], j))]
        features = [(i, i + w) for i in at]
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    filters = []
    for k, (a, b) in enumerate(features):
        if k % fingerprint.PER_FILTER == 0:
            filters.append(set())
        h = int(range_hashes(sums, np.array([a]), np.array([b]))[0])
        filters[-1] |= {(h >> (11 * j)) % fingerprint.BITS for j in range(fingerprint.HASHES)}
    return len(features), filters


def plain_text(chain):
    n, filters = chain
    if not n:
        return ""
    raw = b"".join(int("".join("1" if b in f else "0" for b in range(fingerprint.BITS)), 2).to_bytes(fingerprint.BITS // 8, "big") for f in filters)
    return f"{n}:{base64.b64encode(raw).decode()}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    if len(a[1]) > len(b[1]):
        a, b = b, a
    total = 0.0
    for x in a[1]:
        best = 0.0
        for y in b[1]:
            chance, most = len(x) * len(y) / fingerprint.BITS, min(len(x), len(y))
            floor = chance + fingerprint.CUTOFF * (most - chance)
            best = max(best, min(max((len(x & y) - floor) / max(most - floor, 1e-9), 0), 1))
        total += best
    return total / len(a[1])


def test_fingerprints_equal_a_plain_version(spark):
    draw = np.random.default_rng(8)
    texts = [prose(draw, "abcdefgh éß", n) for n in (3, 40, 90, 400, 1500)]
    texts += ["", None, "short", "x" * 300, texts[3], texts[3][:900] + prose(draw, "qrst", 30) + texts[3][900:], texts[2] + texts[1]]
    rows = [(i, t, 1, 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprint.digest(spark.createDataFrame(rows, "doc_id bigint, text string, part int, extra int").repartition(3)).collect()}
    raw = [(t or "").encode() for t in texts]
    counts = Counter(level(t[i : i + fingerprint.WIDTH]) for t in raw for i in range(len(t) - fingerprint.WIDTH + 1))
    ranks = {x: k for k, x in enumerate(sorted(range(1001), key=lambda x: (counts[x], x)))} | {x: 1001 for x in range(fingerprint.LEAST)}
    for i, t in enumerate(texts):
        after = texts[(i - 1) % len(texts)] or ""
        cut = len(t or "") // 3
        edited = ((t or "")[: len(t or "") - cut] + after[:cut]).encode()
        own, changed, following = (plain_chain(x, ranks) for x in (raw[i], edited, after.encode()))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t or ""), hashlib.sha256(edited).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_text(own), plain_text(changed)), i
        assert r["near_edited"] == pytest.approx(plain_likeness(own, changed), abs=1e-5)
        assert r["near_next"] == pytest.approx(plain_likeness(own, following), abs=1e-5)


# --- language


LETTERS = {"aa": "abcdef ", "bb": "cdefgh ", "cc": "efghij ", "dd": "ghijkl ", "ee": "ijklmn ", "ff": "klmnop "}


def language_rows(n_langs, each=9):
    draw = np.random.default_rng(n_langs)
    rows = [(100 * k + i, prose(draw, LETTERS[x], int(draw.integers(2, 30))), x, 5, "x") for k, x in enumerate(sorted(LETTERS)[:n_langs]) for i in range(each)]
    return rows + [(900, None, "aa", 1, "x"), (901, "", "aa", 1, "x"), (902, "12 34", None, 1, "x"), (None, "abc abc", "aa", 1, "x"), (903, "Ж", None, 1, "x"), (0, rows[0][1], "aa", 1, "x")]


def plain_language(rows):
    def features(text):
        raw = (text or "").encode()
        return [int(language._trigrams(np.frombuffer(raw[i : i + 3], np.uint8))[0]) for i in range(len(raw) - 2)]

    learn = [r for r in rows if r[0] is not None and not out_of_fold(r[0]) and r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in learn})
    code = language.codewords(len(langs))
    counts = {x: Counter(f for r in learn if r[2] == x for f in features(r[1])) for x in langs}
    total = {x: sum(counts[x].values()) + 0.5 * language.DIMS for x in langs}
    side = lambda f, b, s: np.mean([(counts[x][f] + 0.5) / total[x] for i, x in enumerate(langs) if code[i, b] == s])
    weight = {}

    def margins(text):
        own = features(text)
        for f in own:
            if f not in weight:
                weight[f] = [np.float32(math.log(side(f, b, 1)) - math.log(side(f, b, -1))) for b in range(code.shape[1])]
        return [sum(float(weight[f][b]) for f in own) / len(own) if own else 0.0 for b in range(code.shape[1])]

    right, n = np.zeros(code.shape), Counter()
    for r in learn:
        i = langs.index(r[2])
        n[i] += 1
        for b, m in enumerate(margins(r[1])):
            right[i, b] += m * code[i, b] > 0
    trust = np.array([[max(right[i, b] / n[i], 1e-6) for b in range(code.shape[1])] for i in range(len(langs))])
    trust /= trust.sum(1, keepdims=True)
    out = []
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            out.append(("und", 0.0, False))
            continue
        m = [math.tanh(8 * x) for x in margins(r[1])]
        loss = [round(float(sum(trust[i, b] * math.exp(-code[i, b] * m[b]) for b in range(len(m)))), 12) for i in range(len(langs))]
        share = [x**-4 for x in loss]
        one, two = sorted(loss)[:2]
        out.append((langs[loss.index(one)], max(share) / sum(share), two - one < language.GAP * one))
    return out


@pytest.mark.parametrize("n_langs", [2, 4, 6])
def test_language_equals_a_plain_version_however_rows_are_dealt(spark, n_langs):
    rows = language_rows(n_langs)
    want = Counter((r[0], out_of_fold(r[0]), w[0], round(w[1], 4), w[2]) for r, w in zip(rows, plain_language(rows), strict=True))
    for parts in (1, 4, 37):
        d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, feature int, n string").repartition(parts)
        got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 4), r["ambiguous"]) for r in language.identify(d).collect())
        assert got == want


def test_any_number_of_languages(spark):
    draw = np.random.default_rng(1)
    names = [f"l{k:02d}" for k in range(70)]
    letters = {x: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 7, replace=False)) + " " for x in names}
    rows = [(100 * k + i, prose(draw, letters[x], 60), x) for k, x in enumerate(names) for i in range(8)]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)).collect()
    true = {r[0]: r[2] for r in rows}
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in got if r["held_out"]]) > 0.9


# --- quality


def plain_features(text):
    """Distinct features of a text, by looking at each place."""
    raw = text.encode()
    out = set()
    for k in (2, 3, 4):
        for i in range(len(raw) - k + 1):
            out.add(int(quality._hashed(np.frombuffer(raw[i : i + k], np.uint8))[k - 2][0]))
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
    shapes = []
    for i, w in enumerate(words):
        b = w.encode()
        capitals, digits = sum(65 <= c <= 90 for c in b), any(48 <= c <= 57 for c in b)
        symbol = any(c < 128 and not (65 <= c <= 90 or 97 <= c <= 122 or 48 <= c <= 57 or c in b",.'") for c in b)
        low = lambda x: x.translate({c: c + 32 for c in range(65, 91)})
        shapes.append(2 * (capitals > 1) + 4 * digits + 8 * symbol + (len(b) <= 2) + 16 * (i > 0 and low(w) == low(words[i - 1])))
    return out | {quality.DIMS + a * 1024 + b * 32 + c for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)}


def plain_quality(rows, labels, sample=None):
    known = {}
    for i, y in labels:
        if i is not None and y is not None and not out_of_fold(i):
            known[i] = max(known.get(i, 0), y)
    text = {}
    for i, t in rows:
        if i in known:
            text[i] = min(text.get(i, "\U0010ffff"), t or "")
    ids = sorted(text)
    x, y = [sorted(plain_features(text[i])) for i in ids], [1 if known[i] > 0 else -1 for i in ids]
    size = quality.DIMS + (1 << 15)
    learn, apart = [k for k in range(len(ids)) if k % 4 != 3], [k for k in range(len(ids)) if k % 4 == 3]
    counts = {s: np.ones(size) for s in (1, -1)}
    for k in learn:
        for f in x[k]:
            counts[y[k]][f] += 1
    ratios = [math.log(a) - math.log(b) for a, b in zip(counts[1] / counts[1].sum(), counts[-1] / counts[-1].sum(), strict=True)]

    def scaled(own):
        norm = max(math.sqrt(sum(ratios[f] ** 2 for f in own)), 1e-9)
        return {f: ratios[f] / norm for f in own}

    # Dual coordinate descent of the hinge loss, one multiplier at a time.
    share = {s: sum(y[k] == s for k in learn) / len(learn) for s in (1, -1)}
    alpha, w, bias, draw = {k: 0.0 for k in learn}, Counter(), 0.0, np.random.default_rng(7)
    for _ in range(quality.PASSES):
        for j in draw.permutation(len(learn)):
            k = learn[j]
            own = scaled(x[k])
            gradient = y[k] * (sum(w[f] * v for f, v in own.items()) + bias) - 1
            new = min(max(alpha[k] - gradient / 2, 0), quality.COST * 0.5 / share[y[k]])
            for f, v in own.items():
                w[f] += (new - alpha[k]) * y[k] * v
            bias += (new - alpha[k]) * y[k]
            alpha[k] = new
    mean = sum(abs(v) for v in w.values()) / size
    mixed = lambda f: (1 - quality.BETA) * mean + quality.BETA * w[f]
    margin = lambda t: sum(mixed(f) * v for f, v in scaled(plain_features(t)).items()) + bias
    slope, offset = quality._curve(np.array([margin(text[ids[k]]) for k in apart]), np.array([y[k] for k in apart], float))
    return [1 / (1 + math.exp(-min(max(slope * margin(t or "") + offset, -40), 40))) for _, t in rows]


def test_quality_equals_a_plain_version(spark):
    draw = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(48):
        good = i % 2
        t = prose(draw, "abcde" if good else "defgh", int(draw.integers(5, 25)))
        rows.append((i, t if good else t.upper() + " 12 $$ ##"))
        labels.append((i, good))
    rows += [(200, None), (201, ""), (None, "abc ABC"), (202, "abc abc ABC 1,2"), (3, "other text of a known id")]
    labels += [(2, 0), (5, None), (None, 1), (4, 0), (777, 1)]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, y int, features string").repartition(3)
    lab = spark.createDataFrame([(*r, 0) for r in labels], "doc_id bigint, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    key = lambda i, s: (i is None, i or 0, round(s, 3))
    want = sorted(key(i, s) for (i, _), s in zip(rows, plain_quality(rows, labels), strict=True))
    assert sorted(key(r["doc_id"], r["score"]) for r in got) == want
    assert all(r["held_out"] == out_of_fold(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_sample_is_bounded_in_rows_and_features(spark):
    rows = [(i, "abc " * (i + 1)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    assert quality.fit(d, lab, features_limit=0)["prior"] == 0.5
    assert "w" not in quality.fit(d, lab, features_limit=0)
    assert "w" in quality.fit(d, lab, sample=12)


def test_quality_sends_the_model_alone_to_the_driver(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(k, bytes(draw.integers(32, 127, 30_000).astype(np.uint8)).decode(), k % 2) for k in range(60)]  # some 2 MB of features
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    sent, collect = [], type(d).collect

    def counted(df):
        got = collect(df)
        sent.append(sum(len(x) if isinstance(x, bytearray | bytes) else 8 for r in got for x in r))
        return got

    monkeypatch.setattr(type(d), "collect", counted)
    monkeypatch.setattr(type(d), "toArrow", lambda df: pytest.fail("rows of the sample went to the driver"))
    assert "w" in quality.fit(d, lab)
    assert max(sent) <= 2 * 4 * (quality.DIMS + (1 << 15) + 1) + 100
