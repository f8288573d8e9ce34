"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A window is
the set of its word shingles; shingles are ordered by rarity in the whole corpus. Containment of a window asks for all of its
shingles, so its necessary prefix is one token, the rarest. Documents that hold the prefix token are joined to the window, the
length and positional bounds drop what cannot fit, and the words of the item-sized document window are compared.

Defined cases: null or wordless text has no words and no hits; a null or wordless item has no window; items of equal text all
count; a null item_id adds hits but is not listed; repeated rows each get a row; an empty table gives clean documents; shingles of equal
rarity are ordered by hash; a text may be of any length (one task reads it whole); other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, mix, only, row_key, steps, without, word_hashes, word_spans, written

#: Words in a window, words in a shingle, and shingle hashes that one block of the benchmark may broadcast (8 bytes each).
WINDOW, SHINGLE, BLOCK_HASHES = 10, 3, 1_000_000

_WINDOWS = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("shingle", pa.int64()), ("times", pa.int64())])
_CANDIDATE = pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("words", pa.string())])
_DOCS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(_CANDIDATE))])


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, by its first word."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = mix(out ^ words[k : k + n]) + np.uint64(size)
    return out


def _words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, ALNUM)
    return low, starts, ends, firsts, word_hashes(low, starts, ends)


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per window of each item: item_id, words, n, and the hashes of its shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, data, offsets in steps(batch.column(1)):
                low, starts, ends, firsts, hashes = _words(data, offsets)
                raw, rows = low.tobytes(), []
                for i in range(len(offsets) - 1):
                    own = range(firsts[i], firsts[i + 1])
                    size = min(window, len(own))
                    for k in range(len(own) - size + 1 if size else 0):
                        at = own[k]
                        text = " ".join(raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in range(at, at + size))
                        rows.append((ids[a + i], text, size, _shingles(hashes[at : at + size], min(shingle, size)).view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)

    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text")
    return items.mapInArrow(cut, "item_id string, words string, n int, shingles array<bigint>").distinct()


def _probe(data, offsets, wanted: np.ndarray, sizes: list[int]):
    """Words of the texts and the places where a wanted shingle starts: text, word, words in it, hash."""
    low, starts, ends, firsts, hashes = _words(data, offsets)
    none = np.zeros(0, np.int64)
    texts, places, widths, found = [none], [none], [none], [none.astype(np.uint64)]
    for size in sizes:
        all_ = _shingles(hashes, size)
        at = np.searchsorted(wanted, all_)
        at[at == len(wanted)] = 0
        hit = np.flatnonzero(wanted[at] == all_) if len(wanted) else np.zeros(0, np.int64)
        text = np.searchsorted(firsts, hit, "right") - 1
        whole = hit + size <= firsts[text + 1]
        texts.append(text[whole])
        places.append(hit[whole])
        widths.append(np.full(int(whole.sum()), size))
        found.append(all_[hit[whole]])
    return low, starts, ends, firsts, np.concatenate(texts), np.concatenate(places), np.concatenate(widths), np.concatenate(found)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, item_ids, contaminated, key.

    The shingle hashes of the benchmark are broadcast in blocks of at most `block_hashes`; documents are read once more per
    block, so a benchmark of any size is joined in bounded memory.
    """
    docs = only(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text", row_key(docs["doc_id"], docs["text"]).alias("key"))
    cut = written(windows(benchmark, window, shingle), "decontamination-windows")
    tokens = cut.select("words", "n", F.posexplode("shingles").alias("at", "shingle"))
    distinct = tokens.select("shingle").distinct()
    n_blocks = max(1, -(-distinct.count() // block_hashes))
    sizes = [r[0] for r in cut.select(F.least(F.col("n"), F.lit(shingle))).distinct().orderBy(F.lit(1)).limit(shingle).collect()]

    def hashes_of(df: DataFrame, block: int) -> np.ndarray:
        own = df.where(F.pmod(F.xxhash64("shingle"), F.lit(n_blocks)) == block).select("shingle").distinct()
        return np.sort(own.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))

    def counts(block: int) -> DataFrame:
        wanted = hashes_of(distinct, block)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for _, _, data, offsets in steps(batch.column(0)):
                    found = _probe(data, offsets, wanted, sizes)[-1]
                    times += np.bincount(np.searchsorted(wanted, found), minlength=len(wanted))[: len(wanted)]
            seen = times > 0
            yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(times[seen])], schema=_COUNTS)

        return docs.select("text").mapInArrow(count, "shingle bigint, times bigint")

    rarity = reduce(DataFrame.unionByName, [counts(b) for b in range(n_blocks)]).groupBy("shingle").agg(F.sum("times").alias("times"))
    # A shingle that no document holds makes its window impossible: the inner join with the counts drops such windows later on.
    ranked = tokens.join(rarity, "shingle", "left").groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "at")).alias("best")
    )
    prefixes = written(ranked.where("best.times > 0").select("words", "n", "best.shingle", "best.at"), "decontamination-prefixes")

    def candidates(block: int) -> DataFrame:
        wanted = hashes_of(prefixes, block)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, b, data, offsets in steps(batch.column(1)):
                    low, starts, ends, firsts, texts, places, widths, found = _probe(data, offsets, wanted, sizes)
                    raw = low.tobytes()
                    rows: list[list] = [[] for _ in range(b - a)]
                    for t, p, w, h in zip(texts.tolist(), places.tolist(), widths.tolist(), found.view(np.int64).tolist(), strict=True):
                        # A shingle of fewer words is a whole item: nothing beside it is compared.
                        lo, hi = (max(firsts[t], p - window + 1), min(firsts[t + 1], p + window)) if w == shingle else (p, p + w)
                        near = " ".join(raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in range(lo, hi))
                        rows[t].append({"shingle": h, "pos": p - int(firsts[t]), "first": int(lo - firsts[t]), "words": near})
                    yield pa.RecordBatch.from_arrays([batch.column(2)[a:b].cast(pa.binary()), pa.array(ids[a:b], pa.int64()), pa.array(np.diff(firsts).astype(np.int64)), pa.array(rows, pa.list_(_CANDIDATE))], schema=_DOCS)

        return docs.mapInArrow(probe, "key binary, doc_id bigint, n_words bigint, found array<struct<shingle:bigint,pos:int,first:int,words:string>>")

    read = [written(candidates(b), "decontamination-candidates") for b in range(n_blocks)]
    found = reduce(DataFrame.unionByName, [r.select("key", "n_words", F.explode("found").alias("f")) for r in read])
    start = F.col("pos") - F.col("at")
    hits = (
        found.select("key", "n_words", "f.shingle", "f.pos", "f.first", F.col("f.words").alias("near"))
        .join(prefixes, "shingle")
        .where((start >= F.col("first")) & (start + F.col("n") <= F.col("n_words")))
        .where(F.concat_ws(" ", F.slice(F.split("near", " "), start - F.col("first") + 1, F.col("n"))) == F.col("words"))
        .select("key", "words", start.alias("start"), "n")
        .distinct()
    )
    hit_words = hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word")).distinct()
    n_hit = hit_words.groupBy("key").agg(F.count("*").alias("n_hit"))
    items = hits.select("key", "words").distinct().join(cut.select("words", "item_id").distinct(), "words")
    items = items.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = read[0].select("key", "doc_id", "n_words").join(n_hit, "key", "left").join(items, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "key",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a benchmark passage. Each row is judged by its own text, whether its doc_id is null, repeated or unique."""
    return without(docs, written(report(docs, benchmark, **options).where("contaminated").select("key").distinct(), "decontamination-gone"))
