"""Each text operator against a plain version, on real rows and on awkward ones."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pl = pytest.importorskip("panelweft.llm")

from panelweft.llm import bpe, decontamination, fingerprint, language, license, pii, quality, tokenfile  # noqa: E402

ODD = [
    (-1, None, None, None),
    (-2, "", "en", "s"),
    (-3, "   \n\t ", "en", "s"),
    (-4, "a", "en", None),
    (-5, "héllo wörld 你好 🙂🙂   x́ don't I'LL 1234567890", "fr", "s"),
    (-6, "x" * 3000, "en", "s"),
    (-7, "mail a@b.c_d@e.fg, +1 (222) 333-4444 and 4111 1111 1111 1111; 1.2.3.4 999.1.1.1 0012.0.0.255 12.13.14.15.16", "en", "s"),
    (-7, "mail a@b.c_d@e.fg, +1 (222) 333-4444 and 4111 1111 1111 1111; 1.2.3.4 999.1.1.1 0012.0.0.255 12.13.14.15.16", "en", "s"),
    (-8, "GNU General Public License, Apache LICENSE; CC BY mit license cc by-sa", "en", "s"),
    (-9, "gnu general publik licence and al rights reserved", "en", "s"),
    (-10, "aaaa " * 4000, "en", "s"),
    (None, "no id here the of and", "en", "s"),
]


@pytest.fixture(scope="module")
def rows(sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).slice(0, 120)
    return [tuple(r.values()) for r in table.to_pylist()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names clash with those that the operators make.
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, lang string, source string, n_words int, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_bpe_equals_tiktoken(spark, docs, rows, empty):
    import public_tokenizers as P
    import tiktoken

    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = by_id(bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            assert list(r["ids"]) == plain.encode_ordinary(text or "")
            assert bytes(r["decoded"]) == (text or "").encode()
    assert bpe.encode(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_on_random_pieces():
    import public_tokenizers as P
    import tiktoken

    draw = np.random.default_rng(5)
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        codec = bpe.codec(P.path(name), P.PATTERN)
        plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
        tokens = sorted(codec.ranks)
        for k in range(1500):
            piece = b"".join(tokens[i] for i in draw.integers(0, len(tokens), draw.integers(1, 6))) if k % 2 else bytes(draw.choice(list(b"aeinrst h"), draw.integers(1, 40)).astype(np.uint8))
            assert codec.piece(piece) == plain._encode_single_piece(piece), piece


def test_token_files(spark, docs, rows, empty, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenfile.write(docs, str(tmp_path / "a"), P.path("word_bpe_49k.json"), block=5000)
    got = sorted(tokenfile.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))  # repeated doc_ids of other texts do not occur here
    at = 0
    assert len(got) == len(want)
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokenfile.write(empty, str(tmp_path / "b"), P.path("word_bpe_49k.json"))
    assert tokenfile.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("top", [1, 2, 200, 1 << 16, 1 << 40, 1 << 61])
def test_simple8b_round_trip(top):
    draw = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 7, 239, 240, 241, 5000):
        ids = draw.integers(0, top, n, dtype=np.uint64) * (draw.random(n) < 0.7)
        assert np.array_equal(tokenfile.unpack(tokenfile.pack(ids)), ids)


def plain_spans(text):
    out = []
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (p, good) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if good(m[0])]
    return sorted(out)


def luhn(d):
    if not 12 <= len(d) <= 19:
        return False
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base_spans(docs, rows, empty):
    got = by_id(pii.spans(docs))
    seen = 0
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            want = plain_spans(text or "")
            seen += len(want)
            assert [(s["start"], s["kind"], s["end"]) for s in r["_base"]] == want
            assert {(s["start"], s["kind"], s["end"]) for s in r["_spans"]} >= set(want)
            if not want:
                assert not r["_spans"]
    assert seen > 10
    assert pii.spans(empty).count() == 0


def test_pii_terms_and_text(spark):
    made = [(i, f"call agent zorblax at +1 (555) 222-333{4} now {'filler ' * (i % 3)}", "en", "s", 9) for i in range(6)]
    made += [(100 + i, "call now at the filler desk agent", "en", "s", 9) for i in range(60)]
    d = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r for r in pii.sanitise(d).collect()}
    assert "zorblax" not in out[0]["text"] and "[PHONE]" in out[0]["text"] and "555" not in out[0]["text"]
    assert out[100]["text"] == made[6][1]
    assert out[0]["n_chars"] == len(out[0]["text"])


def test_fingerprints(docs, rows, empty):
    got = fingerprint.digest(docs).collect()
    want = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    assert len(got) == len(want)
    shas = sorted(r["edited_sha256"] for r in got)
    plain = []
    for (_, text, *_), (_, after, *_) in zip(want, want[1:] + want[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 3
        plain.append(hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    assert shas == sorted(plain)
    texts = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    real = [r for r in got if r["n_chars"] > 400 and (r["doc_id"] or -1) >= 0]
    assert np.median([r["near_edited"] for r in real]) > np.median([r["near_next"] for r in real]) + 0.2
    assert fingerprint.digest(empty).count() == 0


def test_entropy_levels():
    draw = np.random.default_rng(1)
    data = draw.choice(np.frombuffer(b"aaab cdefgh", np.uint8), 500)
    got = fingerprint.levels(data)
    for i in range(len(got)):
        p = np.bincount(data[i : i + 64], minlength=256) / 64
        p = p[p > 0]
        assert abs(got[i] - round(-(p * np.log2(p)).sum() / 6 * 1000)) <= 1


def words_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def test_decontamination(spark, docs, rows, empty, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("cast(item_id as string) item_id", "text")
    more = [("s1", "the of and"), ("s2", "Aaaa"), ("s3", None), ("s4", "..."), (None, "héllo wörld"), ("d", rows[0][1][:300]), ("e", rows[0][1][:300])]
    bench = bench.unionByName(spark.createDataFrame(more, "item_id string, text string"))
    for block in (1_000_000, 700):
        got = by_id(decontamination.report(docs, bench, block_hashes=block))
        items = [(r["item_id"], words_of(r["text"])) for r in bench.collect()]
        for doc_id, text, *_ in rows:
            words, hit, found = words_of(text), set(), set()
            for item, w in items:
                n = min(10, len(w))
                wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
                for k in range(len(words) - n + 1 if n else 0):
                    if tuple(words[k : k + n]) in wins:
                        hit.update(range(k, k + n))
                        found.add(item)
            for r in got[doc_id]:
                assert (r["n_words"], r["n_hit"], r["contaminated"]) == (len(words), len(hit), bool(hit))
                assert r["item_ids"] == sorted(x for x in found if x)
    assert decontamination.report(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.report(docs, bench.limit(0)).collect())


def test_license(docs, rows, empty):
    got = by_id(license.scan(docs))
    for doc_id, text, *_ in rows:
        words, places = words_of(text), []
        for phrase, label in license.PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        for r in got[doc_id]:
            assert (r["n_words"], r["n_base"]) == (len(words), len(places))
            assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    fuzzy = got[-9][0]
    assert fuzzy["labels"] == "copyright~,gpl~" and 0.8 < fuzzy["score"] < 1
    assert {(m["label"], m["edits"]) for m in fuzzy["matches"]} == {("gpl~", 2), ("copyright~", 1)}
    assert license.scan(empty).count() == 0


def test_license_finds_every_bounded_edit():
    search, draw = license.Searcher(list(license.NOTICES)), np.random.default_rng(3)
    for notice in license.NOTICES:
        for _ in range(25):
            s = list(notice)
            for _ in range(license.edits_of(notice)):
                i = int(draw.integers(0, len(s)))
                kind = int(draw.integers(0, 3))
                s[i : i + (kind != 1)] = [] if kind == 2 else ["q"]
            assert notice in {x[0] for x in search("zz zz " + "".join(s) + " zz")}


def test_license_finds_neighbouring_notices():
    search = license.Searcher(list(license.NOTICES))
    one, other = "gnu general publik license", "gnu general public license"
    for a, b in ((one, other), (other, one), (one, one), (other, other)):
        got = [x for x in search(f"{a} {b}") if x[0] == other]
        assert [(x[1], x[2], x[3]) for x in got] == [(0, 26, int(a == one)), (27, 53, int(b == one))]
    many = " ".join([one, other] * 300)
    assert len([x for x in search(many) if x[0] == other]) == 600


def test_language(spark, sf, docs, empty):
    full = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = language.identify(full).join(full.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = by_id(language.identify(docs))
    assert all(odd[i][0]["lang_pred"] == "und" and odd[i][0]["score"] == 0 for i in (-1, -2, -3))
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    code = language.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 8


def test_quality(spark, sf, docs, empty):
    full, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = quality.classify(full, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality.keep_good(full, labels)
    assert kept.columns == full.columns and kept.count() == quality.classify(full, labels).where("predicted = 1").count()
