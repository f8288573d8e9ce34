"""Quality classifier: naive Bayes support vectors.

Texts are indicator vectors of hashed byte 2-, 3- and 4-grams and of word-shape trigrams (shapes: repeats the word before, all
capitals, holds symbols, holds digits, is short). Indicators are scaled by their log-count ratios between the two classes,
rows get unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve, fitted on a
quarter of the sample that the descent does not see, turns margins into scores.

The model is fitted on a bounded sample of the labelled rows: at most SAMPLE, by the hash of doc_id, and of those as many, in the same
order, as have FEATURES features together. One task fits it, and only the model reaches the driver. Every row is scored on its whole text.

Defined cases: null text is empty; of several labels of one doc_id the largest holds; of several texts the least;
null labels and labels of null doc_id are skipped; with labels of one class only, or none, every score is the smoothed share of label
1; rows of equal doc_id are scored each; an empty table has no rows; other columns play no part; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SOLID, only, steps, table_of, word_hashes, word_spans, written
from .language import held_out

#: Most labelled rows, and most features of all of them, that the model is fitted on (4 bytes each, in one task).
SAMPLE, FEATURES = 4000, 25_000_000
#: Rows of the sample that Spark hands over at a time, so that the executor does not hold the sample a second time.
_BATCH, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 64
#: Feature hash size; passes of the descent; hinge cost; share of the ratios.
DIMS, PASSES, COST, BETA = 1 << 16, 12, 1.0, 0.5
THRESHOLD = 0.7
_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("features", pa.list_(pa.int32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_MODEL = pa.schema([("prior", pa.float64()), ("ratios", pa.binary()), ("w", pa.binary()), ("slope", pa.float64()), ("offset", pa.float64())])

_KIND = np.full(256, 1, np.uint8)  # 1 letter, 2 capital, 4 digit, 8 symbol
_KIND[:128] = 8
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 4
_KIND[[44, 46, 39]] = 0


def _hashed(data: np.ndarray) -> list[np.ndarray]:
    d = data.astype(np.uint32)
    out, h = [], d * np.uint32(2654435761)
    for k in (1, 2, 3):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + d[k:] * np.uint32(3266489917) + np.uint32(k)
        out.append(((h ^ (h >> np.uint32(16))) & np.uint32(DIMS - 1)).astype(np.int64))
    return out


def _rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    grams = _hashed(data) if len(data) > 3 else [np.zeros(0, np.int64)] * 3
    starts, ends, firsts = word_spans(data, offsets, SOLID)
    hashes = word_hashes(LOWER[data], starts, ends)
    kinds = _KIND[data]
    shape = np.zeros(len(starts), np.int64)
    if len(starts):
        for bit in (2, 4, 8):
            sums = np.concatenate([[0], np.cumsum((kinds & bit) > 0)])
            n = sums[ends] - sums[starts]
            shape += bit * ((n > 0) if bit != 2 else (n > 1))
        shape += ends - starts <= 2
        shape[1:] += 16 * (hashes[1:] == hashes[:-1])
        shape[firsts[:-1][firsts[:-1] < len(shape)]] &= 15
    triples = DIMS + shape[:-2] * 1024 + shape[1:-1] * 32 + shape[2:] if len(shape) > 2 else np.zeros(0, np.int64)
    slot = np.zeros(DIMS + (1 << 15), np.int64)
    for i in range(len(offsets) - 1):
        parts = [g[offsets[i] : max(offsets[i], offsets[i + 1] - k - 1)] for k, g in enumerate(grams)]
        parts.append(triples[firsts[i] : max(firsts[i], firsts[i + 1] - 2)])
        own = np.concatenate(parts)
        order = np.arange(len(own))
        slot[own] = order
        yield own[slot[own] == order]


def _descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, passes: int, cost: float) -> np.ndarray:
    """Weights of the hinge-loss model on the scaled unit rows; each class has the same total cost."""
    lengths = [max(np.sqrt((x * x).sum()), 1e-9) for x in (ratios[r] for r in rows)]
    share = np.array([(y > 0).mean(), (y < 0).mean()])
    cap = np.where(y > 0, cost * 0.5 / share[0], cost * 0.5 / share[1])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratios)), 0.0
    draw = np.random.default_rng(7)
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            scaled = ratios[rows[i]] / lengths[i]  # made again each time: all rows together would be twice the features
            gradient = y[i] * (w[rows[i]] @ scaled + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cap[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                w[rows[i]] += change * scaled
                bias += change
                alpha[i] = new
    return np.append(w, bias)


def _margin(row: np.ndarray, ratios: np.ndarray, w: np.ndarray) -> float:
    x = ratios[row]
    return float(w[row] @ x / max(np.sqrt((x * x).sum()), 1e-9) + w[-1])


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with smoothed targets."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x, t = np.stack([margins, np.ones_like(margins)], 1), np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * t)
        t = t + np.clip(step, -2, 2)
    return float(t[0]), float(t[1])


def _learn(batches: Iterator[pa.RecordBatch], passes: int, cost: float, beta: float) -> Iterator[pa.RecordBatch]:
    """The model of all rows (doc_id, y, features) as one row; ratios, w and the curve are null where there is only one class."""
    rows = []
    for batch in batches:
        lists = batch.column(2)
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True)
    rows.sort(key=lambda r: r[0])
    y = np.array([1.0 if r[1] > 0 else -1.0 for r in rows])
    x = [r[2] for r in rows]
    prior = float(((y > 0).sum() + 1) / (len(y) + 2))
    if not (y > 0).any() or not (y < 0).any():
        yield table_of({"prior": [prior], "ratios": [None], "w": [None], "slope": [None], "offset": [None]}, _MODEL)
        return
    size = DIMS + (1 << 15)
    apart = np.arange(len(y)) % 4 == 3
    if len({*y[apart]}) < 2 or len({*y[~apart]}) < 2:
        apart = np.zeros(len(y), bool)
    learn = np.flatnonzero(~apart)
    counts = {s: np.ones(size, np.int64) for s in (1.0, -1.0)}
    for i in learn:
        counts[y[i]][x[i]] += 1  # a row's features are distinct
    ratios = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    w = _descent([x[i] for i in learn], y[learn], ratios, passes, cost)
    w[:-1] = (1 - beta) * np.abs(w[:-1]).mean() + beta * w[:-1] if beta < 1 else w[:-1]
    curve_rows = np.flatnonzero(apart) if apart.any() else learn
    slope, offset = _curve(np.array([_margin(x[i], ratios, w) for i in curve_rows]), y[curve_rows])
    del rows, x, batch, lists, values
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
    yield table_of({"prior": [prior], "ratios": [ratios.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()], "slope": [slope], "offset": [offset]}, _MODEL)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features_limit: int = FEATURES, passes: int = PASSES, cost: float = COST, beta: float = BETA) -> dict:
    """The model from labels (doc_id, quality) of rows outside the held-out quarter."""
    known = only(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows: fit to broadcast
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                own = [r.astype(np.int32) for r in _rows(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), batch.column(2)[a:b].cast(pa.int32()), pa.array(own, pa.list_(pa.int32()))], schema=_FEATURES)

    got = written(rows.mapInArrow(features, "doc_id bigint, y int, features array<int>"), "quality-features")
    sizes = got.select("doc_id", F.size("features").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    within = [r[0] for r, total in zip(sizes, np.cumsum([r[1] for r in sizes]), strict=True) if total <= features_limit]
    if len(within) < len(sizes):
        got = got.where(F.col("doc_id").isin(within))
    got = got.coalesce(1).mapInArrow(lambda batches: _learn(batches, passes, cost, beta), "prior double, ratios binary, w binary, slope double, offset double")
    spark = docs.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH)
    try:
        model = next(iter(got.collect()), None)  # two numbers of four bytes for each feature hash
    finally:
        spark.conf.set(_BATCH, before)
    if model is None:  # Spark knows that there are no rows, and runs no task
        return {"prior": 0.5}
    if model["w"] is None:
        return {"prior": model["prior"]}
    return {"prior": model["prior"], "ratios": np.frombuffer(model["ratios"], np.float32), "w": np.frombuffer(model["w"], np.float32), "curve": (model["slope"], model["offset"])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row; equal texts score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                if "w" in model:
                    slope, offset = model["curve"]
                    z = np.array([slope * _margin(np.sort(r), model["ratios"], model["w"]) + offset for r in _rows(data, offsets)])
                    out = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                else:
                    out = np.full(b - a, model["prior"])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array(out)], schema=_OUT)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, in one pass over them."""
    model = fit(docs, labels)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots do not pass through Arrow
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in steps(batch.column(at)):
                if "w" in model:
                    slope, offset = model["curve"]
                    z = np.array([slope * _margin(np.sort(r), model["ratios"], model["w"]) + offset for r in _rows(data, offsets)])
                    keep[a:b] = 1 / (1 + np.exp(-np.clip(z, -40, 40))) >= threshold
                else:
                    keep[a:b] = model["prior"] >= threshold
            yield batch.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
