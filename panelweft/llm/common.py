"""Shared helpers: Arrow text buffers, vectorised words and hashes, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at a time (a longer document is a step of its own).
STEP_BYTES = 2 << 20
_M = np.uint64(0x9E3779B97F4A7C13)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_POWERS = {"n": 0}
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; only a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "panelweft-checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: cuts the lineage, is computed once, and survives lost executors; its shuffle files go."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids or keys (up to some 50 bytes each) that a join may broadcast, and bitmaps of row numbers (4 kB each, 32,768 rows).
SMALL, BITMAPS = 100_000, 4096


def small(keys: DataFrame, limit: int = SMALL) -> DataFrame:
    """keys (a written table of ids or keys), to be broadcast if it has at most `limit` rows; Spark shuffles a longer one."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def numbered(df: DataFrame, column: str, numbers: DataFrame, limit: int = BITMAPS) -> DataFrame:
    """The rows of df whose number is among numbers (one column of the same name): by bitmaps, a bit a row, if few enough to be broadcast, else by a join."""
    bucket = F.bitmap_bucket_number(column)
    bitmaps = written(numbers.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("_bitmap")), "row-bitmaps")
    if bitmaps.count() > limit:
        return df.join(numbers, column, "left_semi")
    joined = df.join(F.broadcast(bitmaps), bucket == F.col("_bucket"))
    return joined.where(_bit("_bitmap", F.bitmap_bit_position(column))).select(*df.columns)


#: Bits of a bitmap of keys (2 MB, whatever the number of keys).
BITMAP = 1 << 24


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of equal doc_id (null equals null) and text (null is empty), and for no others."""
    return F.unhex(F.sha2(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))), 256))


def marked(df: DataFrame, key: str, keys: DataFrame, bits: int = BITMAP) -> DataFrame:
    """df with _maybe: false only where key is surely not among those of keys. A bitmap of at most `bits` bits is broadcast.

    It spares the rows that cannot match a shuffle; with many more keys than bits it spares none, and a join behind it stays right.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    bitmap = keys.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bitmap"))
    joined = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(slot) == F.col("_bucket"), "left")
    return joined.withColumn("_maybe", _bit("_bitmap", F.bitmap_bit_position(slot))).drop("_bucket", "_bitmap")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose row key is not among those of gone (key), with all their columns. Texts that surely stay are not moved."""
    packed = docs.select(row_key(docs["doc_id"], docs["text"]).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = marked(packed, "key", gone)
    stay = rows.where("NOT _maybe").select("row").unionByName(rows.where("_maybe").join(gone, "key", "left_anti").select("row"))
    return stay.select("row.*")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a missing one is null. Extra columns, whatever their names, are left behind."""
    have = set(df.columns)
    kinds = {"text": "string", "lang": "string", "doc_id": "bigint", "item_id": "bigint"}
    return df.select(*[df[n] if n in have else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])


def spread(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def steps(array: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets from 0) of runs of texts of about `limit` bytes; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    n = len(array)
    if not n:
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, STEP_BYTES)
        for key, base in (("up", _M), ("down", _M_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range, equal for equal bytes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `table` marks, never across texts nor `breaks` (word starts of their own); first word of each text (one more than texts)."""
    inside = table[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
    if breaks is not None and len(breaks):
        before[breaks] = False
        after[breaks - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range, equal for equal bytes, eight bytes at a time; meant for many short ranges."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    own, at = np.arange(len(out)), 0
    while len(own) and at < 128:
        left = np.clip(sizes[own] - at, 1, 8).astype(np.uint64)
        part = eight[starts[own] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        out[own] = mix(out[own] ^ part)
        at += 8
        own = own[sizes[own] > at]
    for i in own.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each byte range equals the other one; meant for many short ranges."""
    sizes = ends - starts
    out = sizes == other_ends - others
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    own, at = np.flatnonzero(out & (starts != others)), 0
    while len(own) and at < 128:
        left = np.clip(sizes[own] - at, 1, 8).astype(np.uint64)
        out[own] = (eight[starts[own] + at] ^ eight[others[own] + at]) & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8))) == 0
        at += 8
        own = own[out[own] & (sizes[own] > at)]
    for i in own.tolist():
        out[i] = data[starts[i] : ends[i]].tobytes() == data[others[i] : other_ends[i]].tobytes()
    return out


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of digits, a-z and everything outside ASCII, after LOWER.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def table_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
