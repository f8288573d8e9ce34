"""Approximate nearest neighbours by inner product: inverted lists, and within each probed list an adaptive scan over dimensions.

A vector is divided by the largest norm and gets one more component, the root of one less its squared norm; by then the largest inner
product is the smallest distance. Each row belongs to the list of its nearest centroid. Within a cell (a bounded piece of a list, beside
the queries that probe the list) vectors are turned by one random rotation, and squared distances are summed over blocks of columns. After
d of D columns a candidate is abandoned when its sum times D / d is over (1 + EPSILON / sqrt(d))^2 times the squared distance of the
query's k-th neighbour so far: for a random rotation, a hypothesis test that fails for a near one about once in a million. The first scan
is of each query's nearest list; its k-th neighbours are the bounds that the scan of the other probed lists starts from. What survives
is scored on the original vectors in double precision.

Fitted on bounded samples: centroids on at most SAMPLE rows (SAMPLE_NUMBERS components), at most LISTS lists (half the root of the number
of rows); the number of probed lists on at most TRIED queries, whose true neighbours among all rows are found by brute force: the smallest
number of lists that hold TARGET of them. Every row is indexed, no list is cut, and a list that holds a third of all rows is many cells.

Defined cases: rows with a null id or vector, a vector of zeros or without components, or a null or non-finite component, take no part.
Vectors of different lengths never meet; each length has an index of its own. Ties go by id. Rows that share the query's id are the query
itself; of rows that share id and score (repeated rows), one counts; queries that share id and vector are one. Fewer candidates than k are
all returned if they lie in probed lists. An empty table gives an empty one. Other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import finite, joined, leaders, matrices, real

#: Rows and components that the lists are fitted on, and the most lists.
SAMPLE, SAMPLE_NUMBERS, LISTS = 32_768, 4_000_000, 1024
#: Queries that the number of probed lists is chosen on, and the share of their neighbours that those lists have to hold.
TRIED, TARGET = 256, 0.97
#: Rows and queries of a cell, columns of a block, and the width of the test.
ROWS, QUERIES, COLUMNS, EPSILON = 8192, 16_384, 16, 2.1
#: Queries and rows of one step of a scan.
_STEP_QUERIES, _STEP_ROWS = 256, 1024
_HITS = "query long, query_id long, vec_id long, score double"


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow on the way."""
    most = np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def raised(x: np.ndarray, most: float) -> np.ndarray:
    """Rows divided by the largest norm, with the component that makes them unit vectors."""
    x = x / most
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def asked(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, with a last component of 0."""
    return np.column_stack([x / norms(x)[:, None], np.zeros(len(x))])


def rotation(width: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix that every task makes alike."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def fitted(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; an empty list takes the row that is farthest from its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own, far = nearest_list(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=lists)
        centroids = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centroids


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = _distances(x[at : at + 4096], centroids)
        own[at : at + 4096] = d.argmin(axis=1)
        far[at : at + 4096] = d.min(axis=1)
    return own, far


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    found = matrices(vectors)
    return found[0][1].astype(np.float64) if found else np.zeros((0, 0))


def survivors(q: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (query, row) of turned vectors that no test abandons; bound: squared distance of each query's k-th neighbour so far."""
    width, total = q.shape[1], None
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for a in range(0, width, COLUMNS):
        b = min(a + COLUMNS, width)
        if pairs is None:
            part = _distances(q[:, a:b], y[:, a:b])
            total = part if total is None else total + part
            limit = bound[:, None]
        else:
            total = total + ((q[pairs[0], a:b] - y[pairs[1], a:b]) ** 2).sum(axis=1)
            limit = bound[pairs[0]]
        stays = total * (width / b) <= (limit * (1 + EPSILON / math.sqrt(b)) ** 2 if b < width else limit + 1e-9)
        if pairs is not None:
            pairs, total = (pairs[0][stays], pairs[1][stays]), total[stays]
        elif b == width or np.count_nonzero(stays) * 5 < stays.size:
            # Few are left: from here on pair by pair.
            pairs = np.nonzero(stays)
            total = total[pairs]
    return pairs


def scanned(q: np.ndarray, qid: np.ndarray, least: np.ndarray, x: np.ndarray, xid: np.ndarray, most: float, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row id, score): of each query, the first k rows of a cell that reach its score so far (`least`)."""
    turned, rows = asked(q) @ turn, raised(x, most) @ turn
    size = norms(q) * most
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), _STEP_QUERIES):
        here = slice(at, at + _STEP_QUERIES)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        low = least[here].copy()
        for row in range(0, len(x), _STEP_ROWS):
            bound = np.where(np.isneginf(low), np.inf, 2 - 2 * np.where(np.isneginf(low), 0, low) / size[here])
            i, j = survivors(turned[here], rows[row : row + _STEP_ROWS], bound)
            i, j = i + at, j + row
            other = qid[i] != xid[j]
            i, j = i[other], j[other]
            score = (q[i] * x[j]).sum(axis=1)
            new = score >= low[i - at]
            best = tuple(np.concatenate(c) for c in zip(best, (i[new], xid[j[new]], score[new]), strict=True))
            keep = leaders(best[0], best[2], best[1], k)
            best = tuple(c[keep] for c in best)
            # best is in order of query and score: the last of k is the bound from here on.
            full = np.flatnonzero(np.bincount(best[0] - at, minlength=len(low)) == k)
            last = np.searchsorted(best[0] - at, full, "right") - 1
            low[full] = np.maximum(low[full], best[2][last])
        out.append(best)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _cell_scan(most: float, width: int, k: int):
    """One cell: (its rows, its queries) to hits."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        one = lambda t, c: t.column(c).combine_chunks()
        number, qid, least = (one(queries, c).to_numpy(zero_copy_only=False) for c in ("query", "query_id", "least"))
        i, vec_id, score = scanned(_matrix(one(queries, "vector")), qid, least, _matrix(one(rows, "vector")), one(rows, "vec_id").to_numpy(), most, rotation(width + 1), k)
        return pa.Table.from_arrays([pa.array(number[i]), pa.array(qid[i]), pa.array(vec_id), pa.array(score)], schema=schema)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The first k different hits of each query, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _measures(rows: DataFrame) -> list:
    """Number of rows and largest norm of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.shape[1], len(x), float(norms(x.astype(np.float64)).max(initial=0))) for _, x in matrices(joined(batch, "vector"))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["width", "n", "most"])

    each = rows.select("vector").mapInArrow(run, "width long, n long, most double")
    return each.groupBy("width").agg(F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("width").collect()


def _sample(rows: DataFrame, n: int, size: int, *columns: str) -> np.ndarray:
    """About nine tenths of `size` rows, never more than `size`, by a hash of id and vector; in order of the hash."""
    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 31))
    few = rows.where(place < int((1 << 31) * 0.9 * size / n)).limit(size) if n > size else rows
    return few.orderBy(place, "vec_id").select(*columns).collect()


def _indexed(rows: DataFrame, centroids: np.ndarray, most: float, kind: str) -> DataFrame:
    """Rows with their list, and a number of their own; written, so that numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _ = nearest_list(raised(_matrix(joined(batch, "vector")), most), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "list"])

    found = rows.select("vec_id", "query", "vector").mapInArrow(run, f"vec_id long, query boolean, vector array<{kind}>, list int")
    return written(found.withColumn("slot", F.monotonically_increasing_id()), "nearest-rows")


def _probes(index: DataFrame, centroids: np.ndarray, k: int, tried: list, target: float) -> int:
    """The smallest number of lists, nearest first, that hold the target's share of the true neighbours of the tried queries."""
    q, qid = np.array([r["vector"] for r in tried], np.float64), np.array([r["vec_id"] for r in tried], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, own = _matrix(joined(batch, "vector")), batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
            out: list[list] = [[], [], [], []]
            for i, scores in enumerate(q @ x.T if len(ids) else ()):
                near = np.argpartition(-scores, min(2 * k, len(scores) - 1))[: 2 * k]
                near = near[ids[near] != qid[i]]
                for column, value in zip(out, (np.full(len(near), i), ids[near], scores[near], own[near]), strict=True):
                    column.append(value)
            flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(flat, ("i8", "i8", "f8", "i4"), strict=True)], names=["query", "vec_id", "score", "list"])

    hits = _best(index.mapInArrow(run, "query long, vec_id long, score double, list int"), k).select("query", "list").collect()
    if not hits:
        return 1
    order = np.argsort(np.argsort(_distances(asked(q), centroids), axis=1, kind="stable"), axis=1)
    ranks = np.sort([order[h["query"], h["list"]] for h in hits])
    return int(ranks[math.ceil(target * len(ranks)) - 1]) + 1


def _spread(queries: DataFrame, centroids: np.ndarray, cells: np.ndarray, first: int, last: int, kind: str) -> DataFrame:
    """Queries beside each cell of their lists from the first-th to before the last-th nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(asked(_matrix(joined(batch, "vector"))), centroids) if batch.num_rows else np.zeros((0, len(cells)))
            lists = np.argsort(d, axis=1, kind="stable")[:, first:last]
            many = cells[lists]
            row = np.repeat(np.repeat(np.arange(len(lists)), lists.shape[1]), many.ravel())
            which = np.repeat(lists.ravel(), many.ravel())
            cell = np.arange(len(row)) - np.repeat(np.cumsum(many.ravel()) - many.ravel(), many.ravel())
            for at in range(0, len(row), 20_000):
                part = batch.take(pa.array(row[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(which[at : at + 20_000], pa.int32()), pa.array(cell[at : at + 20_000], pa.int32())], names=[*part.schema.names, "list", "cell"])

    return queries.select("query", "query_id", "least", "block", "vector").mapInArrow(run, f"query long, query_id long, least double, block int, vector array<{kind}>, list int, cell int")


def _of_one_length(rows: DataFrame, n: int, width: int, most: float, k: int, kind: str, target: float) -> DataFrame:
    spark = rows.sparkSession
    most = min(most, float(np.finfo(np.float64).max))
    lists = max(1, min(LISTS, n, round(math.sqrt(n) / 2)))
    sample = raised(np.array([r[0] for r in _sample(rows, n, max(lists, min(SAMPLE, SAMPLE_NUMBERS // width)), "vector")], np.float64), most)
    centroids = fitted(sample, min(lists, len(sample)))
    index = _indexed(rows, centroids, most, kind)

    queries = index.where("query").groupBy("vec_id", "vector").agg(F.min("slot").alias("query"))
    queries = written(queries.select("query", F.col("vec_id").alias("query_id"), "vector"), "nearest-queries")
    m = queries.count()
    if not m:
        return spark.createDataFrame([], f"{_HITS}, rank int")
    tried = _sample(queries.withColumnRenamed("query_id", "vec_id"), m, TRIED, "vec_id", "vector")
    probes = _probes(index, centroids, k, tried, target)

    sizes = np.zeros(len(centroids), np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    cells, blocks = np.maximum(-(-sizes // ROWS), 1), max(1, -(-m // QUERIES))
    counts = F.array(*[F.lit(int(c)) for c in cells]) if cells.max() > 1 else None
    cell = F.pmod(F.col("slot"), F.element_at(counts, F.col("list") + 1)) if counts is not None else F.lit(0)
    placed = index.select("list", cell.cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector")

    def scan(asking: DataFrame, first: int, last: int) -> DataFrame:
        asking = asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        key = ["list", "cell", "block"]
        return placed.groupBy(*key).cogroup(_spread(asking, centroids, cells, first, last, kind).groupBy(*key)).applyInArrow(_cell_scan(most, width, k), _HITS)

    near = written(_best(scan(queries.withColumn("least", F.lit(float("-inf"))), 0, 1), k), "nearest-first")
    if probes == 1:
        return near
    known = near.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    bounded = queries.join(known, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return _best(near.drop("rank").unionByName(scan(bounded, 1, probes)), k)


def search(vectors: DataFrame, query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` (vec_id, embedding) with the largest inner product with each row where `query` holds."""
    spark: SparkSession = vectors.sparkSession
    kind = real(vectors, "embedding")
    rows = vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    found = spark.createDataFrame([], f"{_HITS}, rank int")
    for r in _measures(rows):
        one = rows.where(F.size("vector") == r["width"])
        found = found.unionByName(_of_one_length(one, r["n"], r["width"], r["most"], k, kind, target))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
