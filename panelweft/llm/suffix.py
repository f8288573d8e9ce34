"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in any document. Every such string holds
length - Q + 1 q-grams; the suffix at its leftmost q-gram of least hash stands for it, so equal strings are always found at
equal suffixes, about one suffix in 80 bytes. The suffixes fall into buckets by their q-gram. A bucket of one is done. A
bucket of more is refined: each suffix stands for the strings that start up to length - Q bytes before it, cut into a few
ranges of offsets, and each range gets two bucket identifiers, of the bytes that all strings of the range share and of the
bytes that they cover together. Neither is made of bytes: the bucket that the range was in is refined by the buckets of the
q-grams at the offsets beyond it, and the new identifier is the bucket that the next round refines. Buckets are named by hashes, which are
the same in every text, so a suffix finds the bucket of a later one in its own text, without a join. Each width divides the one before, so that a range never passes the strings that hold its suffix's
q-gram: two suffixes of one text then never name the same place. A single identifier of the first kind ends the range (none of its strings repeats), a repeated
one of the second kind marks it (all repeat), and only what is left is refined again, down to single offsets, beside one
range of each marked identifier of the same bucket.

Only identifiers are shuffled, counted in each task first; texts lie bucketed by row in one written table, so that no round
moves them again; tables of repeated identifiers are written before they are joined, so that Spark may split a frequent one.

Defined cases: null is empty; strings never cross texts; rows of equal doc_id are rows of their own; texts under `length` bytes
stay whole; an empty table has no rows; other columns play no part. One text is handled by one task, in some 30 times its size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, mix, only, powers, prefix_sums, spread, steps, written

#: Bytes in a string that may stand once only, bytes of the first buckets' q-grams, and offsets in a range, coarse to fine.
LENGTH, Q, RANGES = 200, 41, (160, 32, 8, 1)
#: Bits of a place in a text, which Spark holds to 2 GB.
_PLACE = 31
#: Odd multipliers of the two lanes of an identifier, and open ranges that are refined at a time.
_LANES = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)
_BLOCK = 20_000
_SUFFIX = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("low", pa.int16()), ("high", pa.int16()), ("shared", pa.int64())])
_RANGE = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("shared", pa.int64()), ("covered", pa.binary())])
_OUT = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes: position, first and last start of the strings that each stands for, and the hash of its q-gram."""
    n, width = len(data) - q + 1, length - q + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    grams = mix((sums[q:] - sums[:-q]) * down[:n])
    order = (grams >> np.uint64(1)).astype(np.int64) & ~np.int64((1 << _PLACE) - 1) | np.arange(n)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    blocks[:n] = order
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, 1).ravel()
    m = n - width + 1
    least = np.minimum(ahead[:m], behind[width - 1 : width - 1 + m]) & ((1 << _PLACE) - 1)
    inside = np.arange(m) + length <= np.repeat(offsets[1:], np.diff(offsets))[:m]
    starts = np.flatnonzero(inside)
    own = least[starts]
    change = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    firsts = np.concatenate([[0], change]) if len(own) else none
    lasts = np.concatenate([change, [len(own)]])[: len(firsts)] - 1 if len(own) else none
    at = own[firsts]
    return at, starts[firsts], starts[lasts], grams[at].view(np.int64)


def _folded(lanes: np.ndarray, pointers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Both lanes of each identifier with one more pointer taken in, where wanted."""
    return np.where(wanted, mix((lanes ^ (lanes >> np.uint64(29))) * _LANES + pointers), lanes)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The distinct identifiers that occur more than once; counted in each task before the shuffle."""
    return written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "suffix-repeated")


def widths(length: int = LENGTH, q: int = Q, ranges: tuple[int, ...] = RANGES) -> tuple[int, ...]:
    """The widths of ranges, from all offsets to one; each has to divide the one before."""
    out = (length - q + 1, *[r for r in ranges if r < length - q + 1])
    if q < 1 or out[0] < 1 or out[-1] != 1 or any(a % b for a, b in zip(out[:-1], out[1:], strict=True)):
        raise ValueError(f"widths {out}: each has to divide the one before, down to 1")
    return out


def _first_buckets(docs: DataFrame, length: int, q: int) -> DataFrame:
    """All sampled suffixes: (row, at, low, high, shared); low and high bound the offsets back from the suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for a, _, data, offsets in steps(batch.column(1)):
                at, first, last, grams = suffixes(data, offsets, length, q)
                text = np.searchsorted(offsets, at, "right") - 1
                out = [rows[a + text], (at - offsets[text]).astype(np.int32), (at - last).astype(np.int16), (at - first).astype(np.int16), grams]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SUFFIX, strict=True)], schema=_SUFFIX)

    return docs.mapInArrow(run, "row bigint, at int, low smallint, high smallint, shared bigint")


def _ranges(texts: DataFrame, open_: DataFrame, size: int, before: int, length: int, q: int) -> DataFrame:
    """The open ranges, `before` offsets wide, cut into ranges of `size`: the two identifiers of each (row, at, low, high, shared, covered).

    An identifier is the bucket that the range comes from, refined by the q-gram buckets at the offsets beyond what that one stands for.
    """
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("at", "low", "high", "shared")).alias("open"))

    def refined(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, part: pa.StructArray) -> list:
        at, low, high = (part.field(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
        pieces = high // size - low // size + 1
        item = np.repeat(np.arange(len(at)), pieces)
        k = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (low // size)[item]
        near, far = k * size, k * size + size - 1  # offsets of the full range, the same in every text
        wide_near = near // before * before
        wide_far = wide_near + before - 1
        here = (start[text] + at)[item]
        lanes = mix(part.field("shared").to_numpy().view(np.uint64)[item] + (k + 1).astype(np.uint64) * _LANES)

        def point(lanes: np.ndarray, first: np.ndarray, bytes_: np.ndarray, step: int, of: np.ndarray) -> np.ndarray:
            """The buckets of the q-grams that cover bytes_ bytes from `first` on (backwards from it, if step < 0)."""
            for j in range(-(-int(bytes_[of].max(initial=0)) // q)):
                more = of & (bytes_ > j * q)
                place = np.where(more, first + step * j * q, 0)
                lanes = _folded(lanes, mix((sums[place + q] - sums[place]) * down[place]), more)
            return lanes

        # What all strings of the range share lies inside each text that holds one of them, and holds what the wider range shared.
        every = np.ones(len(item), bool)
        lanes = point(lanes, here - near, near - wide_near, 1, every)
        lanes = point(lanes, here - far + length - q, wide_far - far, -1, every)
        shared = lanes[0]
        # What they cover together may pass the ends of the text: then nothing repeats it.
        inside = (here - far >= start[text][item]) & (here - near + length <= end[text][item])
        lanes = point(lanes, here - far, far - near, 1, inside)
        lanes = point(lanes, here - near + length - q, far - near, -1, inside)
        covered = pa.Array.from_buffers(pa.binary(16), len(item), [None, pa.py_buffer(np.ascontiguousarray(lanes.T))]).cast(pa.binary())
        covered = pc.if_else(pa.array(inside), covered, pa.scalar(None, pa.binary()))
        return [item, at[item], np.maximum(near, low[item]), np.minimum(far, high[item]), shared.view(np.int64), covered]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for a, b, data, offsets in steps(batch.column(1)):
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                text = np.repeat(np.arange(b - a), pc.list_value_length(lists).to_numpy())
                sums = prefix_sums(data)
                _, down = powers(len(data) + 1)
                for i in range(0, len(flat), _BLOCK):
                    own = text[i : i + _BLOCK]
                    out = refined(sums, down, offsets[:-1], offsets[1:], own, flat.slice(i, _BLOCK))
                    out[0] = rows[a + own[out[0]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if f.name != "covered" else x for x, f in zip(out, _RANGE, strict=True)], schema=_RANGE)

    return texts.join(wanted, "row").select("row", "text", "open").mapInArrow(run, "row bigint, at int, low int, high int, shared bigint, covered binary")


def refine(docs: DataFrame, length: int = LENGTH, q: int = Q, ranges: tuple[int, ...] = RANGES) -> tuple[DataFrame, DataFrame]:
    """(texts, marked): the bucketed texts (row, doc_id, text) and the starts (row, first, last) of repeated strings."""
    spark = docs.sparkSession
    ranges = widths(length, q, ranges)
    rows = only(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    name = f"suffix_texts_{uuid.uuid4().hex}"
    n = spread(spark)
    rows.repartition(n, "row").write.options(path=folder(spark, "suffix-texts"), compression="zstd").bucketBy(n, "row").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files lie in the shared folder and stay

    first = written(_first_buckets(texts.select("row", "text"), length, q), "suffix-buckets")
    state = first.join(_repeated(first.select("shared"), "shared"), "shared")  # a bucket of one is done
    marked = []
    for level, size in enumerate(ranges):
        wide = ranges[max(level - 1, 0)]
        state = written(_ranges(texts.select("row", "text"), state.select("row", "at", "low", "high", "shared"), size, wide, length, q), f"suffix-ranges-{size}")
        if level and size > 1:
            state = written(state.join(_repeated(state, "shared"), "shared"), f"suffix-open-{size}")
        twice = _repeated(state, "covered").withColumn("twice", F.lit(True))
        # The identifier is of use further on only where it is repeated.
        state = state.join(twice, "covered", "left").withColumn("covered", F.when(F.col("twice"), F.col("covered")))
        state = written(state, f"suffix-level-{size}")
        marked.append(state.where("twice").select("row", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last")))
        left = state.where("twice IS NULL").select("row", "at", "low", "high", "shared")
        # What is left may repeat a part of a marked range: one range of each marked identifier goes on in such buckets.
        one = state.where("twice").groupBy("covered").agg(F.min(F.struct("row", "at", "low", "high", "shared")).alias("x")).select("x.*")
        open_ = written(left.select("shared").distinct(), "suffix-open")
        state = left.unionByName(one.join(open_, "shared", "left_semi").select(*left.columns))
    out = marked[0]
    for more in marked[1:]:
        out = out.unionByName(more)
    return texts, out


def removed(docs: DataFrame, length: int = LENGTH, q: int = Q, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), starts and ends of the removed runs."""
    texts, marked = refine(docs, length, q, ranges)
    places = marked.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                where = batch.column(2)[a:b].to_pylist()
                out: list[list] = [[] for _ in _OUT]
                for i in range(b - a):
                    own = data[offsets[i] : offsets[i + 1]]
                    ends = np.zeros(len(own) + 1, np.int64)
                    for x in where[i] or ():
                        ends[x["first"]] += 1
                        ends[x["last"] + length] -= 1
                    gone = np.cumsum(ends[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    for column, value in zip(out, (None, len(own), int(gone.sum()), len(edges) // 2, own[~gone].tobytes(), edges[::2], edges[1::2]), strict=True):
                        column.append(value)
                out[0] = batch.column(0)[a:b].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)

    joined = texts.select("row", "doc_id", "text").join(places, "row", "left")
    cut = joined.select(F.col("doc_id").alias("row"), "text", "places").mapInArrow(run, "row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, starts array<bigint>, ends array<bigint>")
    return cut.withColumnRenamed("row", "doc_id")


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by looking at every string; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out
