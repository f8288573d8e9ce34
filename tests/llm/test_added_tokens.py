"""Token files of texts that hold added tokens, against the plain library."""

import zlib

import numpy as np
import pytest

pytest.importorskip("panelweft.llm")

from panelweft.llm import tokenfile  # noqa: E402

TEXTS = [
    "a <|endoftext|> b", "a<|endoftext|>b", "<|ENDOFTEXT|> <|Endoftext|> x", "don<|startoftext|>'t", "<|endoftext|>", "x  <|endoftext|>  y <|endoftext|><|startoftext|>",
    "A\u0301<|endoftext|>\u0301 b", "<<|endoftext|>|> <|endoftext|", ">|<|startoftext|>\n<|endoftext|>\n", "plain, after", None, "tail <|endof", "text|> head", "<|endoftext|><|endoftext|>",
]


def test_added_tokens_equal_the_library(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(2)
    tokenfile.write(docs, str(tmp_path / "a"), path)
    got = {r["doc_id"]: r for r in tokenfile.read(spark, str(tmp_path / "a")).collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), text
        at += len(ids)


def test_added_tokens_outlive_the_memo(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "MEMO", 3)
    words, plain = tokenfile.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in TEXTS * 2:
        raw = (text or "").encode()
        ids, _ = words.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "word_hashes", lambda data, starts, ends: np.uint64(7) * (ends - starts > 2).astype(np.uint64))
    words, plain = tokenfile.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for text in [*TEXTS, "ab ba ab cab bac cab abc a b", "x" * 300 + " " + "x" * 299 + "y " + "x" * 300]:
        raw = (text or "").encode()
        ids, _ = words.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    import json

    import public_tokenizers as P
    from tokenizers import Tokenizer

    top = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    top["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(top), encoding="utf-8")
    words, plain = tokenfile.Words(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    assert words.whole
    texts = ["Big and SMALL", "", *[t or "" for t in TEXTS]]
    raw = [t.encode() for t in texts]
    ids, cuts = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids
