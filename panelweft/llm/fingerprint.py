"""Document fingerprints: a digest of improbable features.

Every window of WIDTH bytes is a feature candidate. Its entropy falls in one of 1,001 levels; levels are ranked by how rare
they are among the windows of all documents, rarest first. Within each run of WIDTH windows the leftmost window of least rank
gains a point, and windows with POPULAR points are selected. Their hashes go into a chain of Bloom filters of at most
PER_FILTER features each. Two chains are compared by the overlap of set bits, normalised between what chance gives and the most
there can be, averaged over the filters of the shorter chain.

Defined cases: null is empty; an empty text has the empty fingerprint; a text under WIDTH bytes is one feature; equal
fingerprints are 1 alike, an empty and another one 0; null doc_ids come after all others, repeated doc_ids are ordered by text;
the only document is its own next one; an empty table has no rows; a text may be of any length (one task reads it whole, and its chain
has as many filters as its features need); other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prefix_sums, range_hashes, spread, steps

#: Bytes in a window, points of a selected window, features and bits of a filter, bits set by a feature, least entropy level.
WIDTH, POPULAR, PER_FILTER, BITS, HASHES, LEAST = 64, 16, 160, 2048, 5, 100
#: Share of the span between chance and the most that an overlap must pass to count.
CUTOFF = 0.3
_TERMS = np.round(np.concatenate([[0], np.arange(1, WIDTH + 1) * np.log2(np.arange(1, WIDTH + 1))]) * 1e6).astype(np.int64)
_LEVELS = pa.schema([("level", pa.int32()), ("n", pa.int64())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 to 1000) of the window that starts at each byte; windows run across text borders here."""
    n = len(data) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    gain = _TERMS[1:] - _TERMS[:-1]
    total = np.empty(n, np.int64)
    total[0] = _TERMS[np.bincount(data[:WIDTH], minlength=256)].sum()
    total[1:] = gain[before[WIDTH:]] - gain[after[: n - 1]]
    np.cumsum(total, out=total)
    entropy = np.log2(WIDTH) - total / 1e6 / WIDTH
    return np.clip(np.round(entropy / np.log2(WIDTH) * 1000), 0, 1000).astype(np.int64)


def _inside(offsets: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Whether the `reach` bytes from each of the first n bytes lie in one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + reach <= ends


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each level by its count over the windows of all documents, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                own = levels(data)
                total += np.bincount(own[_inside(offsets, len(own), WIDTH)], minlength=1001)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1001, dtype=np.int32)), pa.array(total)], schema=_LEVELS)

    counts = np.zeros(1001, np.int64)
    for level, n in docs.select("text").mapInArrow(count, "level int, n bigint").groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    ranks = np.empty(1001, np.int64)
    ranks[np.lexsort((np.arange(1001), counts))] = np.arange(1001)
    ranks[:LEAST] = 1001
    return ranks


def _running_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width]."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.int64).max)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, 1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


Chain = tuple[int, np.ndarray]  # features, filters (rows of packed bits)


def chains(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[Chain]:
    """The filter chain of each text."""
    sums, own = prefix_sums(data), levels(data)
    points, order = np.zeros(len(data), np.int64), np.zeros(0, np.int64)
    if len(own):
        order = ranks[own] << 40 | np.arange(len(own))
        if len(own) >= WIDTH:
            least = _running_least(order, WIDTH) & ((1 << 40) - 1)
            points = np.bincount(least[_inside(offsets, len(least), 2 * WIDTH - 1)], minlength=len(data))
    selected = np.flatnonzero(points >= POPULAR)
    cuts = np.searchsorted(selected, offsets)
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = selected[cuts[i] : cuts[i + 1]]
        if a == b:
            out.append((0, np.zeros((0, BITS // 8), np.uint8)))
            continue
        if b - a < WIDTH:
            hashes = range_hashes(sums, np.array([a]), np.array([b]))
        else:
            at = at if len(at) else np.array([a + int(np.argmin(order[a : b - WIDTH + 1]))])
            hashes = range_hashes(sums, at, at + WIDTH)
        bits = np.zeros((-(-len(hashes) // PER_FILTER), BITS), bool)
        for k in range(HASHES):
            bits[np.arange(len(hashes)) // PER_FILTER, (hashes >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
        out.append((len(hashes), np.packbits(bits, 1)))
    return out


def text_of(chain: Chain) -> str:
    return f"{chain[0]}:{base64.b64encode(chain[1].tobytes()).decode()}" if chain[0] else ""


def chain_of(text: str) -> Chain:
    n, _, body = text.partition(":")
    return (int(n or 0), np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BITS // 8))


def likeness(a: Chain, b: Chain) -> float:
    """0 (no more overlap than chance) to 1."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    if len(a[1]) > len(b[1]):
        a, b = b, a
    x, y = np.unpackbits(a[1], axis=1).astype(np.float32), np.unpackbits(b[1], axis=1).astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    chance, most = nx * ny / BITS, np.minimum(nx, ny)
    floor = chance + CUTOFF * (most - chance)
    return float(np.clip((x @ y.T - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(1).mean())


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text) ranged over partitions by descending doc_id; each part ends with an extra row, the next one's first.

    Only the split points and the first id of each part, one per partition, pass through the driver.
    """
    spark, n = docs.sparkSession, spread(docs.sparkSession)
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    splits = sorted({int(x) for x in docs.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    part = F.lit(0)
    if splits:
        part = F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s > key))
    docs = docs.withColumn("part", part.cast("int"))
    tops = {r[0]: r[1] for r in docs.groupBy("part").agg(F.max(key)).collect()}
    if not tops:
        return docs.withColumn("extra", F.lit(0))
    ordered = sorted(tops)
    before = {p: ordered[i - 1] for i, p in enumerate(ordered)}
    firsts = docs.where(key.isin([int(x) for x in tops.values()])).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    moves = spark.createDataFrame([(p, int(tops[p]), before[p]) for p in ordered], "own int, top bigint, target int")
    extra = firsts.join(F.broadcast(moves), (F.col("part") == F.col("own")) & (key == F.col("top")))
    rows = docs.withColumn("extra", F.lit(0)).unionByName(extra.select("doc_id", "text", F.col("target").alias("part"), F.lit(1).alias("extra")))
    return rows.repartitionByRange(n, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: n_chars, the edited text's hash, both fingerprints, and the likeness to the edited text and to the next document."""
    ranks = rarity(only(docs, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows (part, extra, doc_id, text); the last one waits for what follows

        def flush() -> pa.RecordBatch:
            pairs = [(a, b) for a, b in zip(held[:-1], held[1:], strict=True) if not a[1]]
            edited = []
            for a, b in pairs:
                cut = len(a[3]) // 3
                edited.append((a[3][: len(a[3]) - cut] + b[3][:cut]).encode())
            own = chains(*_joined([r[3].encode() for r in held]), ranks)
            place = [i for i, r in enumerate(held[:-1]) if not r[1]]
            changed = chains(*_joined(edited), ranks)
            out = [
                [a[2] for a, _ in pairs],
                [len(a[3]) for a, _ in pairs],
                [hashlib.sha256(e).hexdigest() for e in edited],
                [text_of(own[i]) for i in place],
                [text_of(c) for c in changed],
                [likeness(own[i], c) for i, c in zip(place, changed, strict=True)],
                [likeness(own[i], own[i + 1]) for i in place],
            ]
            del held[:-1]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)

        size = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    size = 0
                    yield flush()
        if len(held) > 1:
            yield flush()

    rows = neighbours(docs).select("part", "extra", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
