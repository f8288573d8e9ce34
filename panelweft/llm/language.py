"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1; every bit is predicted by a binary n-gram classifier (log ratios of the smoothed
byte-trigram frequencies of the languages on either side of the bit). Loss-weighted decoding picks the language whose
codeword has the least loss, each bit weighted by how often its classifier is right for that language on the learning rows.

Frequencies and bit weights come from all learning rows, as sums of whole numbers: the model is the same however the rows are
dealt. A model holds a number for each of DIMS features and each bit, and a few for each language, of which there may be any number.

Defined cases: null text or text without a letter is `und` with score 0 and not ambiguous; without any learning row every document
is `und`; one language wins alone with score 1; rows of null doc_id are neither held out nor learned from; repeated rows are scored
alike and each learned from; of languages at equal loss the first by name wins; other columns play no part; texts may be of any
length; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, only, steps, written

#: Feature hash size, languages whose counts a task holds at a time, and the relative loss gap under which a prediction is ambiguous.
DIMS, HELD, GAP = 1 << 14, 64, 0.05
_STATS = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])
_BITS = pa.schema([("lang", pa.int32()), ("bit", pa.int32()), ("n", pa.int64())])
_WEIGHTS = pa.schema([("feature", pa.int32()), ("weights", pa.list_(pa.float32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

_SYMBOLS = LOWER.copy()
_SYMBOLS[:97] = 32
_SYMBOLS[65:91] = np.arange(97, 123)
_SYMBOLS[123:128] = 32


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram that starts at each byte (the last two bytes have none)."""
    s = _SYMBOLS[data].astype(np.uint32)
    return ((s[:-2] * 40503 + s[1:-1] * 2654435 + s[2:] * 97) * np.uint32(2654435769) >> np.uint32(18)).astype(np.int64) if len(s) > 2 else np.zeros(0, np.int64)


def codewords(n: int) -> np.ndarray:
    """A +1/-1 row per class: every split of up to five classes, else the best separated of several seeded random codes."""
    if n <= 5:
        splits = [k for k in range(1, 1 << max(n - 1, 0))]
        return np.array([[1 if (k >> i) & 1 else -1 for k in splits] for i in range(n)], np.float64).reshape(n, len(splits))
    best, apart = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        least = int((code.shape[1] - np.where(np.eye(n) > 0, -np.inf, code @ code.T).max()) / 2)
        if least > apart:
            best, apart = code, least
    return best


def counted(docs: DataFrame) -> DataFrame:
    """(lang, feature, n): trigrams of the rows (text, lang), summed in each task before they are shuffled."""

    def rows(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], schema=_STATS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in steps(batch.column(0)):
                features = _trigrams(data)
                for i in range(b - a):
                    own = features[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
                    if langs[a + i] not in totals and len(totals) == HELD:
                        yield from rows(totals)
                        totals = {}
                    totals.setdefault(langs[a + i], np.zeros(DIMS, np.int64)).__iadd__(np.bincount(own, minlength=DIMS))
        yield from rows(totals)

    return docs.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def bit_weights(counts: DataFrame, langs: list[str], code: np.ndarray) -> np.ndarray:
    """Per feature and bit: the log ratio of the mean smoothed frequencies of the languages on either side."""
    at = {x: i for i, x in enumerate(langs)}
    sums = np.zeros(len(langs))
    for lang, n in counts.groupBy("lang").agg(F.sum("n")).collect():  # a row per language
        sums[at[lang]] = n
    sums += 0.5 * DIMS
    plus = (code > 0) / (code > 0).sum(0)
    minus = (code < 0) / (code < 0).sum(0)
    none = 0.5 / sums  # frequencies of a feature that no language has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                p = none.copy()
                for x in own:
                    p[at[x["lang"]]] += x["n"] / sums[at[x["lang"]]]
                out.append((np.log(p @ plus) - np.log(p @ minus)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out, pa.list_(pa.float32()))], schema=_WEIGHTS)

    by_feature = counts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("own"))
    got = by_feature.mapInArrow(run, "feature int, weights array<float>").toArrow()  # at most DIMS rows
    out = np.tile((np.log(none @ plus) - np.log(none @ minus)).astype(np.float32), (DIMS, 1))
    if got.num_rows:
        out[got.column(0).to_numpy()] = got.column(1).combine_chunks().values.to_numpy().reshape(-1, code.shape[1])
    return out


def _margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text (rows) for each bit."""
    features = _trigrams(data)
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    if not len(features):
        return out
    lo = np.minimum(offsets[:-1], len(features))
    hi = np.maximum(lo, np.minimum(offsets[1:] - 2, len(features)))
    some = np.flatnonzero(hi > lo)
    if len(some):
        cuts = np.stack([lo[some], hi[some]], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] == len(features) else cuts
        for b in range(0, weights.shape[1], 8):  # a few bits at a time, so that memory does not grow with the languages
            out[some, b : b + 8] = np.add.reduceat(weights[features, b : b + 8], cuts, 0)[::2] / (hi[some] - lo[some])[:, None]
    return out


def right_bits(docs: DataFrame, langs: list[str], code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit is right for each language, and the rows of each language."""
    at = {x: i for i, x in enumerate(langs)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((len(langs), code.shape[1] + 1), np.int64)  # the last column counts rows
        for batch in batches:
            own = np.array([at[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, data, offsets in steps(batch.column(0)):
                np.add.at(full[:, :-1], own[a:b], _margins(data, offsets, weights) * code[own[a:b]] > 0)
                np.add.at(full[:, -1], own[a:b], 1)
        lang, bit = np.nonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bit.astype(np.int32)), pa.array(full[lang, bit])], schema=_BITS)

    full = np.zeros((len(langs), code.shape[1] + 1), np.int64)
    for lang, bit, n in docs.mapInArrow(judge, "lang int, bit int, n bigint").groupBy("lang", "bit").agg(F.sum("n")).collect():
        full[lang, bit] = n
    return full[:, :-1], full[:, -1]


def fit(docs: DataFrame) -> dict:
    """The model of the given learning rows (text, lang): languages, codewords, trigram weights by bit, bit weights."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    code = codewords(len(langs))
    if len(langs) < 2:
        return {"langs": langs}
    weights = bit_weights(written(counted(docs), "language-counts"), langs, code)
    right, rows = right_bits(docs, langs, code, weights)
    trust = np.maximum(right / np.maximum(rows, 1)[:, None], 1e-6)
    return {"langs": langs, "code": code, "weights": weights, "trust": trust / trust.sum(1, keepdims=True)}


def predict(docs: DataFrame, model: dict, gap: float = GAP) -> DataFrame:
    """doc_id, lang_pred, score (share of the inverse losses), ambiguous (the next codeword is within `gap` of the nearest)."""
    langs = model["langs"]
    code, weights, trust = (model.get(k) for k in ("code", "weights", "trust"))
    names = np.array([*langs, "und"], object)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                sums = np.concatenate([[0], np.cumsum(letter[data])])
                known = sums[offsets[1:]] > sums[offsets[:-1]]
                for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                    known[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                if len(langs) < 2:
                    best, score, close = np.where(known & (len(langs) == 1), 0, len(langs)), (known & (len(langs) == 1)).astype(float), np.zeros(b - a, bool)
                else:
                    margins = np.tanh(8 * _margins(data, offsets, weights))
                    loss = np.round(np.exp(-margins) @ (trust * (code > 0)).T + np.exp(margins) @ (trust * (code < 0)).T, 12)
                    two = np.partition(loss, 1, 1)[:, :2]
                    share = loss**-4.0
                    best = np.where(known, loss.argmin(1), len(langs))
                    score = np.where(known, share.max(1) / share.sum(1), 0.0)
                    close = known & (two[:, 1] - two[:, 0] < gap * two[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score), pa.array(close)], schema=_OUT)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out quarter and predict every row: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = only(docs, "doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
