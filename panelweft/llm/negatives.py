"""Hard-negative mining by a secondary sort: pair scores as (anchor, descending score, id) keys, read once by a streaming iterator.

Anchors are a stated query set, packed in blocks of at most BLOCK rows; every row meets every anchor, once for the positives and once for
the negatives. A task is a cell of (part of the rows, group of blocks): it holds the group's anchors, the part's chunks stream past, and a
tile of anchors meets a run of rows in one matrix product. Of each anchor it keeps the first rows so far of its own label, then the first
of each window, and these alone leave it when the part is through. No row beyond these can be among the first of all rows, so nothing is
lost, and what is shuffled is a few rows an anchor and part, whatever the number of close rows. Rows are copied to each group and blocks to
each part; neither goes through the driver, whatever the threshold for broadcasts. The keys go through
repartitionAndSortWithinPartitions; the iterator keeps the open windows and the ids of the last score, never an anchor's rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. A pair of vectors of different
lengths has no score; vectors of length 0 score 0 with each other. Scores are exact integers; beyond 64 bits they are held at the bounds.
Ties go by id. Rows that share an anchor's id are the anchor itself; of rows that share id and score (repeated rows), one counts; anchors
that share id, label and vector are one, others that share only the id are anchors each. Without anchors, positives or negatives there is
no row; an empty table gives an empty one. A positive with a negative score has an empty window. Other columns are left behind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written
from .vectors import finite, joined, leaders, matrices, real

#: Rows of a chunk, and anchors of a block (a chunk of anchors); a number in a chunk has 13 bits, and one of a piece's blocks 12.
CHUNK, BLOCK = 4096, 1024
_BITS, _PIECE = 13, 12
#: Anchors, and bytes of their packed vectors, that a task holds.
HELD, HELD_BYTES = 1 << 16, 16 << 20
#: Anchors and rows of one product; an anchor's first products are of fewer rows, until scores are known that others must reach.
TILE, ROWS, FIRST = 512, 1024, 16
#: Scores lie between -_MOST and _MOST, ids from _LEAST on.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_PACKED = "chunk long, width int, kind string, ids binary, labels binary, data binary"
_WINDOWS = "number long, places binary, least binary, most binary"


def _packer(scale: float, limit: int):
    """Arrow rows to chunks: scaled whole components, in the shortest type that holds them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            out: list[list] = [[], [], [], [], [], []]
            for rows, x in matrices(joined(batch, "vector")):
                with np.errstate(over="ignore"):
                    x = np.nan_to_num(np.floor(x.astype(np.float64) * scale))
                order = np.argsort(ids[rows], kind="stable")
                rows, x = rows[order], x[order]
                for at in range(0, len(rows), limit):
                    part, block = rows[at : at + limit], x[at : at + limit]
                    most = np.abs(block).max() if block.size else 0
                    kind = "int16" if most < 1 << 15 else "float32" if most < 1 << 24 else "float64"
                    for column, value in zip(out, (number, x.shape[1], kind, ids[part].tobytes(), labels[part].tobytes(), block.astype(kind).tobytes()), strict=True):
                        column.append(value)
                    number += 1
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            names = ("chunk", "width", "kind", "ids", "labels", "data")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    return run


def _unpacked(width: int, kind: str, ids: bytes, labels: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
    x = np.frombuffer(data, kind).reshape(len(ids), width)
    return ids, labels, x.astype(np.float32) if kind == "int16" else x


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.linalg.norm(x.astype(np.float64), axis=1)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole-number rows: in the narrowest arithmetic that cannot round, held at the 64-bit bounds.

    No partial sum, in any order, is larger than `most`, the product of the greatest lengths.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.float32)
    if most < (1 << 23):
        return a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T
    if most < float(1 << 52):
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


class _Tile:
    """Anchors of one width, each with as many windows (least to most score, both included), and the first k rows so far of each window."""

    def __init__(self, own: np.ndarray, labels: np.ndarray, codes: np.ndarray, x: np.ndarray, lengths: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
        self.own, self.labels, self.codes, self.x, self.length, self.k = own, labels, codes, x, float(lengths.max()), k
        self.windows, self.least, self.most = least.shape[1], least.ravel(), most.ravel()
        # Entries as (window, score, id); the last of a full window is what a further one must come before.
        self.kept, self.new, self.waiting, self.seen = [np.zeros(0, np.int64)] * 3, [], 0, 0
        self.last_score, self.last_id = np.full(self.least.shape, _LEAST), np.full(self.least.shape, _MOST)
        self.low = self._lowest()

    def _lowest(self) -> np.ndarray:
        reach = np.where(self.least > self.most, _MOST, np.maximum(self.least, self.last_score))
        return reach.reshape(-1, self.windows).min(axis=1)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lengths: np.ndarray, other: bool) -> None:
        at = 0
        while at < len(ids):
            step = min(ROWS, max(FIRST, self.seen))
            rows = slice(at, at + step)
            scores = products(self.x, x[rows], self.length * float(lengths[rows].max()))
            # A bound that this type rounds is beyond all of the scores, and stays so.
            low = self.low.astype(scores.dtype)
            near = np.flatnonzero(scores.max(axis=1) >= low)
            if len(near):
                found = np.flatnonzero((scores := scores[near]) >= low[near, None])
                a, r = np.divmod(found, scores.shape[1])
                s, a, i = scores.ravel()[found].astype(np.int64), near[a], ids[rows][r]
                fit = (i != self.own[a]) & ((labels[rows][r] != self.labels[a]) == other)
                self._add(a[fit], s[fit], i[fit])
            at, self.seen = at + step, self.seen + step
            if self.waiting and (step < ROWS or self.waiting >= max(4096, len(self.kept[0]))):
                self.settle()

    def _add(self, a: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        for n in range(self.windows):
            w = a * self.windows + n
            last = self.last_score[w]
            fit = np.flatnonzero((s >= self.least[w]) & (s <= self.most[w]) & ((s > last) | ((s == last) & (i < self.last_id[w]))))
            if len(fit):
                self.new.append([w[fit], s[fit], i[fit]])
                self.waiting += len(fit)

    def settle(self) -> None:
        w, s, i = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        order = leaders(w, s, i, self.k)
        self.kept, self.new, self.waiting = [w[order], s[order], i[order]], [], 0
        w, s, i = self.kept
        full = np.arange(len(w)) - np.searchsorted(w, w) == self.k - 1
        self.last_score[w[full]], self.last_id[w[full]] = s[full], i[full]
        self.low = self._lowest()

    def keys(self, other: bool) -> Iterator[tuple[bytes, int]]:
        self.settle()
        w, s, i = self.kept
        a = w // self.windows
        order = np.lexsort((i, s, a))
        a, s, i = a[order], s[order], i[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        for code, score, vec_id, own in zip(self.codes[a[new]].tolist(), s[new].tolist(), i[new].tolist(), self.own[a[new]].tolist(), strict=True):
            yield _key(code, score, vec_id, other), own


def _key(anchor: int, score: int, vec_id: int, other: bool) -> bytes:
    """Sorts by anchor, descending score, ascending id; last, whether the label is another one."""
    return struct.pack(">QQQ?", anchor, _MOST - score, vec_id - _LEAST, other)


def _read(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, vec_id, other = struct.unpack(">QQQ?", key)
    return anchor, _MOST - score, vec_id + _LEAST, other


def _part(n: int):
    return lambda key: ((int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32) % n


def _met(chunks: DataFrame, blocks: DataFrame, parts: int, groups: int) -> DataFrame:
    """The cells: each part of the chunks behind each group of the blocks, a cell in a partition of its own."""
    columns = ["number", "width", "kind", "ids", "labels", "data", "places", "least", "most"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = chunks.select("*", each(groups).alias("group")).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
    kept = blocks.select("*", each(parts).alias("part")).withColumn("group", F.pmod(F.shiftright("number", _PIECE), F.lit(groups)))
    for name, kind in (("number", "bigint"), ("places", "binary"), ("least", "binary"), ("most", "binary")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
        kept = kept if name in kept.columns else kept.withColumn(name, F.lit(None).cast(kind))
    cell = (F.col("part") * groups + F.col("group")).cast("int").alias("cell")
    both = kept.select(cell, *columns).unionByName(rows.select(cell, *columns))
    return both.repartitionById(parts * groups, "cell").sortWithinPartitions("cell", F.col("number").isNull())


def _cleaned(rdd: RDD) -> None:
    """Removes the shuffle files of an RDD whose rows are written: the next cells need the disk."""
    inner = rdd._jrdd.rdd()
    inner.dependencies()  # Spark cleans known dependencies only
    inner.cleanShuffleDependencies(True)


def _windows(low: int, high: int):
    """(number, positives) to the distinct windows of a block's anchors: places in the block, least and most scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lambda n: min(max(n, _LEAST), _MOST)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for number, positives in zip(batch.column("number").to_pylist(), batch.column("positives").to_pylist(), strict=True):
                found = sorted({(p["anchor"] - (number << _BITS), held(-(-low * p["score"] // 100)), held(high * p["score"] // 100)) for p in positives if p["score"] >= 0})
                for column, value in zip(out, (number, *(np.array([f[n] for f in found], np.int64).tobytes() for n in range(3))), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["number", "places", "least", "most"])

    return run


def _held(blocks: list, k: int, other: bool) -> dict[int, list[_Tile]]:
    """The tiles of a group's anchors by width: for positives in the order of labels, for negatives those with windows; then by length."""
    out: dict[int, list[_Tile]] = {}
    for width in sorted({b["width"] for b in blocks}):
        parts: list[list] = [[], [], [], [], [], []]
        for b in blocks:
            if b["width"] != width:
                continue
            own, labels, x = _unpacked(width, b["kind"], b["ids"], b["labels"], b["data"])
            if other:
                places, least, most = (np.frombuffer(b[c], np.int64) for c in ("places", "least", "most"))
            else:
                places, least, most = np.arange(len(own)), np.full(len(own), _LEAST), np.full(len(own), _MOST)
            with_window, first = np.unique(places, return_index=True)
            bounds = np.tile(np.array([_MOST, _LEAST]), (len(with_window), int(np.diff([*first, len(places)]).max(initial=1)), 1))
            row = np.searchsorted(with_window, places)
            bounds[row, np.arange(len(places)) - first[row]] = np.stack([least, most], axis=1)
            for part, values in zip(parts, (own[with_window], labels[with_window], (b["number"] << _BITS) + with_window, x[with_window], _lengths(x[with_window]), bounds), strict=True):
                part.append(values)
        most = max(b.shape[1] for b in parts[-1])
        parts[-1] = [np.concatenate([b, np.tile(np.array([_MOST, _LEAST]), (len(b), most - b.shape[1], 1))], axis=1) for b in parts[-1]]
        own, labels, codes, x, lengths, bounds = (np.concatenate(p) for p in parts)
        order = np.lexsort((lengths,) if other else (lengths, labels))
        at = [order[n : n + TILE] for n in range(0, len(order), TILE)]
        out[width] = [_Tile(own[t], labels[t], codes[t], x[t], lengths[t], bounds[t, :, 0], bounds[t, :, 1], k) for t in at]
    return out


def _close(k: int, other: bool):
    """The first k rows of each window of each anchor in each cell, as keys: of the anchor's own label (its one window is all scores), or of others."""

    def run(stream):
        cell, blocks, tiles = None, [], {}
        for row in stream:
            if row["cell"] != cell:
                yield from (key for of_width in tiles.values() for tile in of_width for key in tile.keys(other))
                cell, blocks, tiles = row["cell"], [], {}
            if row["number"] is not None:
                blocks.append(row)
                continue
            if blocks:
                blocks, tiles = [], _held(blocks, k, other)
            if row["width"] not in tiles:
                continue
            ids, labels, x = _unpacked(*(row[c] for c in ("width", "kind", "ids", "labels", "data")))
            if not other:
                order = np.argsort(labels, kind="stable")
                ids, labels, x = ids[order], labels[order], x[order]
            lengths = _lengths(x)
            for tile in tiles[row["width"]]:
                # Positives: only the rows from a tile's first label to its last.
                some = slice(None) if other else slice(*np.searchsorted(labels, [tile.labels[0], tile.labels[-1] + 1]))
                tile.meet(ids[some], labels[some], x[some], lengths[some], other)
        yield from (key for of_width in tiles.values() for tile in of_width for key in tile.keys(other))

    return run


def _leading(k: int):
    """The first k of each anchor, of keys in order."""

    def run(stream):
        anchor, last, n = None, None, 0
        for key, own in stream:
            if key == last:
                continue
            this, score, vec_id, _ = _read(key)
            if this != anchor:
                anchor, n = this, 0
            last, n = key, n + 1
            if n <= k:
                yield anchor, own, score, vec_id

    return run


def windows(stream, k: int, low: int, high: int):
    """(anchor's id, positive, rank, negative, both scores) from (key, anchor's id) in the order of keys.

    A positive opens a window at its score; the negatives that follow go to each open window until it has k or the score falls below it.
    At most k negatives of the current score are remembered, for a positive of that score that comes after them.
    """
    anchor, last, open_, tied, tied_at = None, None, [], [], None
    for key, own in stream:
        if key == last:
            continue
        last = key
        this, score, vec_id, other = _read(key)
        if this != anchor:
            anchor, open_, tied, tied_at = this, [], [], None
        if score != tied_at:
            tied, tied_at = [], score
        if not other:
            window = [vec_id, score, 0]
            for negative in tied:
                if low * score <= 100 * score <= high * score:
                    window[2] += 1
                    yield own, vec_id, window[2], negative, score, score
            if window[2] < k:
                open_.append(window)
            continue
        if len(tied) < k:
            tied.append(vec_id)
        for window in open_:
            if low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield own, window[0], window[2], vec_id, window[1], score
        open_ = [w for w in open_ if w[2] < k and low * w[1] <= 100 * score]


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor of `vectors` (vec_id, embedding, label).

    A score is the inner product of floor(scale * x). An anchor's positives are its first other rows of its own label; a positive's
    negatives are the first rows of another label whose score is from low to high percent of the positive's (low < high <= 100).
    """
    if not low < high <= 100:
        raise ValueError("a window reaches from low to high percent, low < high <= 100")
    spark = vectors.sparkSession
    kind = real(vectors, "embedding")
    rows = vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    chunks = written(rows.select("vec_id", "label", "vector").mapInArrow(_packer(scale, CHUNK), _PACKED), "negative-rows")
    asked = written(rows.where("anchor").select("vec_id", "label", "vector").distinct(), "negative-anchors")
    # Blocks are numbered by bounded pieces of the written anchors.
    anchors = asked.count()
    n_pieces = max(1, -(-anchors // BLOCK))
    pieces = asked.repartition(n_pieces).mapInArrow(_packer(scale, BLOCK), _PACKED)
    number = F.shiftright("number", 32) * (1 << _PIECE) + F.col("number") % (1 << _PIECE)
    blocks = written(pieces.withColumnRenamed("chunk", "number"), "negative-blocks").withColumn("number", number)

    # More groups copy the rows more often, more parts the anchors (with what is found for them, some five times a row's bytes).
    salts, size = spread(spark), blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    n_rows = (chunks.agg(F.sum(F.length("ids"))).first()[0] or 0) // 8
    groups = min(n_pieces, max(1, -(-anchors // HELD), -(-size // HELD_BYTES), round((5 * salts * anchors / max(1, n_rows)) ** 0.5)))
    parts = -(-salts // groups)
    found = _met(chunks, blocks, parts, groups).rdd.mapPartitions(_close(positives, False))
    found = found.repartitionAndSortWithinPartitions(salts, _part(salts)).mapPartitions(_leading(positives), preservesPartitioning=True)
    best = written(spark.createDataFrame(found, "anchor long, own long, score long, vec_id long", verifySchema=False), "negative-positives")
    _cleaned(found)

    of_block = best.groupBy(F.shiftright("anchor", _BITS).alias("number")).agg(F.collect_list(F.struct("anchor", "score")).alias("positives"))
    of_block = of_block.mapInArrow(_windows(low, high), _WINDOWS).hint("merge")
    close = _met(chunks, blocks.join(of_block, "number"), parts, groups).rdd.mapPartitions(_close(negatives, True))
    opened = best.rdd.map(lambda r: (_key(r[0], r[2], r[3], False), r[1]))
    keys = opened.union(close).repartitionAndSortWithinPartitions(salts, _part(salts))
    result = keys.mapPartitions(lambda stream: windows(stream, negatives, low, high))
    return spark.createDataFrame(result, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
