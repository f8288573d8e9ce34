"""Token ids in files of word-aligned Simple-8b blocks.

A block holds the ids of whole documents: a header (magic, ids, words, groups, escapes), the number of ids before each group
of GROUP words, the 64-bit words and the escapes. The top four bits of a word select how many ids of how many bits it packs;
an id that does not fit 60 bits is an escape, kept whole at the end. All words of one selector are decoded at once, and the
group offsets let a reader start in the middle of a block. Blocks are rows (shard, block, first, doc_ids, counts, payload) of
Parquet files, so that any store which Spark writes to and reads from can hold them.

Defined cases: null and empty texts hold the end id only; null doc_ids come first; repeated doc_ids keep a row each,
ordered by their texts' hash and then the text; equal rows in any order, which gives the same files; texts may be of any length that
one block's list of documents can hold whole; an empty table gives no block; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, only, same_bytes, spread, steps, word_hashes, word_spans

#: Ids after which a block is closed, words in a group, words of text that a worker's memo holds.
BLOCK, GROUP, MEMO = 1 << 16, 128, 1_000_000
#: Ids and bits of each selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_MAGIC, _ESCAPE = b"PS8B", (1 << 60) - 1
_COUNTS = np.array([c for c, _ in SELECTORS])
_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())]
)
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def pack(ids: np.ndarray) -> bytes:
    """The payload of one block."""
    ids = ids.astype(np.uint64)
    large = ids >= _ESCAPE
    escapes = ids[large]
    ids = np.where(large, np.uint64(_ESCAPE), ids)
    n = len(ids)
    need = np.zeros(n + 240, np.int8)
    for bits in sorted({b for _, b in SELECTORS[:-1]}):
        need[:n] += ids >> np.uint64(bits) > 0
    level = {b: i for i, b in enumerate(sorted({b for _, b in SELECTORS}))}  # need: smallest level that holds the id
    by_count = {c: i for i, (c, _) in enumerate(SELECTORS)}
    best = np.full(n, len(SELECTORS) - 1, np.int8)
    most = need.copy()
    for c in range(2, 241):
        most = np.maximum(most[:-1], need[c - 1 :])
        if (i := by_count.get(c)) is not None:
            fits = most[:n] <= level[SELECTORS[i][1]]
            best[fits] = i
        if c >= 8 and c % 8 == 0 and not (most[:n] <= level[7]).any():
            break
    jump, at, starts = _COUNTS[best].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts] if n else np.zeros(0, np.int8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for i in np.unique(chosen):
        c, bits = SELECTORS[i]
        own = np.flatnonzero(chosen == i)
        if bits:
            values = padded[starts[own][:, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(bits))
            words[own] |= np.bitwise_or.reduce(values, 1)
    groups = starts[::GROUP].astype("<u4")
    head = _MAGIC + struct.pack("<4I", n, len(words), len(groups), len(escapes))
    return head + groups.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one block."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a block of token ids")
    n, n_words, n_groups, n_escapes = struct.unpack_from("<4I", payload, 4)
    at = 20 + 4 * n_groups
    words = np.frombuffer(payload, "<u8", n_words, at)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 240, np.uint64)
    for i in np.unique(chosen):
        c, bits = SELECTORS[i]
        own = np.flatnonzero(chosen == i)
        if bits:
            values = words[own][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
            out[starts[own][:, None] + np.arange(c)] = values
    out = out[:n]
    if n_escapes:
        out[out == _ESCAPE] = np.frombuffer(payload, "<u8", n_escapes, at + 8 * n_words)
    return out


def cuts_between_words(path: str) -> bool:
    """Whether the tokenizer of this file is of the kind whose ids of a text are those of its words: it lower-cases, white space only
    parts, and letters and marks are pieces of their own."""
    with open(path, encoding="utf-8") as f:
        top = json.load(f)
    flat = lambda x, key: x.get(key, [x]) if x else []
    before = [(n["type"], n.get("pattern"), n.get("content")) for n in flat(top.get("normalizer"), "normalizers")]
    pieces = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in flat(top.get("pre_tokenizer"), "pretokenizers")]
    return before == _NORMALISER and pieces == _PIECES and not top.get("post_processor") and not top["model"].get("dropout")


class Words:
    """The tokenizers library behind a memo of words: what stands between ASCII blanks or line ends, without the marks after a letter.

    The tokenizer normalises, cuts and merges between blanks only, and cuts between a letter and a mark that is no apostrophe, so
    the ids of a text are those of its words. Each step of texts looks every distinct word up once, by its bytes. An added token
    that stands in a text, letter for letter, is a word of its own. A tokenizer of another kind encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        added = {t.content.encode(): (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.whole = not cuts_between_words(path) or any(t.normalized or t.lstrip or t.rstrip or t.single_word or b" " in c or b"\n" in c for c, (_, t) in added.items())
        self.tokenizer.encode_special_tokens = not self.whole
        self.added = {c: i for c, (i, _) in added.items()}
        self.literal = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

    def literals(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens in the texts."""
        raw = data.tobytes()
        if not any(c in raw for c in self.added):
            return []
        return [(*m.span(), self.added[m[0]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.literal.finditer(raw, a, b)]

    def made(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        found = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
        for i, made in zip(new, self.made([words[i] for i in new]) if new else [], strict=True):
            found[i] = self.known[words[i]] = made
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if self.whole:
            raw = data.tobytes()
            ids = self.made([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *[len(x) // 4 for x in ids]])
        low = LOWER[data]
        cut = np.zeros(len(low) + 1, bool)
        cut[1:-1] = _LETTER[low[:-1]] & _MARK[low[1:]]
        literals = self.literals(data, offsets)
        for a, b, _ in literals:
            cut[a : b + 1] = False
        for a, b, _ in literals:
            cut[[a, b]] = True
        cut[[0, -1]] = False
        starts, ends, firsts = word_spans(low, offsets, _INSIDE, np.flatnonzero(cut))
        hashes = word_hashes(low, starts, ends)
        fixed = {int(np.searchsorted(starts, a)): i for a, _, i in literals}  # words that are added tokens
        for w, i in fixed.items():
            hashes[w] = _ADDED + np.uint64(i)
        which, distinct = pd.factorize(hashes)
        one = np.zeros(len(distinct), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]
        # Words of one hash and other bytes stand for themselves.
        same = same_bytes(low, starts, ends, starts[one][which], ends[one][which])
        if fixed:
            token = np.full(len(starts), -1, np.int64)
            token[list(fixed)] = list(fixed.values())
            same &= token == token[one][which]
        other = np.flatnonzero(~same)
        which[other] = len(one) + np.arange(len(other))
        one = np.concatenate([one, other])
        raw = low.tobytes()
        ids = self.ids([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        for k, w in enumerate(one.tolist() if fixed else ()):
            if w in fixed:
                ids[k] = np.array([fixed[w]], "<u4").tobytes()
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        after = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(begin[which] - after[:-1], each) + np.arange(after[-1])], after[firsts]


#: The normaliser and the pieces of tokenizers that encode by words.
_NORMALISER = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
_PIECES = [
    ("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, None, None),
    ("ByteLevel", None, None, None, False, False),
]
#: With its id, what stands for the hash of an added token.
_ADDED = np.uint64(0xADDED70C << 32)
_INSIDE = np.ones(256, bool)
_INSIDE[[10, 32]] = False
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False  # apostrophes join letters: 's, 't
_WORDS: dict[str, Words] = {}


def words_of(tokenizer: str) -> Words:
    """One memo per file in each Python worker."""
    if tokenizer not in _WORDS:
        _WORDS[tokenizer] = Words(tokenizer)
    return _WORDS[tokenizer]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK) -> None:
    """Encode all texts and write their ids in ascending doc_id order as blocks under `path`.

    Texts are ranged by doc_id first: the ranges are sampled from the plan below them, which is then a plain scan and no encoder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list = []

        def close() -> pa.RecordBatch:
            nonlocal number, first, held, sizes, names
            ids = np.concatenate(held)
            out = [[shard], [number], [first], [len(ids)], [names], [np.concatenate(sizes)], [pack(ids)]]
            number, first, held, sizes, names = number + 1, first + len(ids), [], [], []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                ids, cuts = words.encode(data, offsets)
                ids = np.insert(ids, cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
                doc_ids, at = batch.column(0)[a:b].to_pylist(), 0
                # A block takes whole documents up to its size; a longer document is a block of its own.
                while at < len(doc_ids):
                    room = block - sum(map(len, held))
                    to = max(int(np.searchsorted(cuts, cuts[at] + room, "right")) - 1, at + (not held))
                    if to > at:
                        held.append(ids[cuts[at] : cuts[to]])
                        sizes.append(np.diff(cuts[at : to + 1]))
                        names += doc_ids[at:to]
                    at = to
                    if at < len(doc_ids):
                        yield close()
        if names:
            yield close()

    ordered = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # Rows of one doc_id, or equal ones, may fall into several ranges.
    ordered = ordered.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(spread(docs.sparkSession), "doc_id", "hash", "row")
    ordered = ordered.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(shards.select("shard", before.alias("before"))), "shard")  # a row per written partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = unpack(row["payload"]).astype("<u4"), np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts, strict=True)]
                out = [row["doc_ids"], row["start"] + ends - counts, counts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _READ, strict=True)], schema=_READ)

    placed = placed.select("doc_ids", "counts", "payload", (F.col("before") + F.col("first")).alias("start"))
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
