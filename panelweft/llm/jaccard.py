"""N-gram Jaccard join: sets of word shingles that are at least 0.9 alike, by prefix-tree join.

Shingles have one global order: by hash, but those of a bounded list of frequent ones come last. Equal sets form a class and go
on once. Two linked sets share one of their first n - ceil(0.9 n) + 1 shingles, and what is behind the shared one has to be long
enough in both: classes that share such a shingle and pass these bounds and a parity sketch are candidates. Each candidate goes to the
trie of the class that has most of them: the sets of a trie are paths in the global order, a probe walks it once, shares the overlap
of common beginnings, and leaves a subtree as soon as the lengths that remain cannot reach the similarity.

A shingle that many classes share does not pair all of them. Its classes are paired with one centre of their size band; a class that
links ends up in one component with the centre, and only classes outside the shingle's main component are then compared with the
rest, so no link between two components is missed and no group meets in one task. Sets travel as eight bytes a shingle, texts only once.

Defined cases: null, empty and wordless texts have no shingles, link with nothing and are their own component; rows without
doc_id link with nothing and have no component; rows of equal doc_id are sets of their own; ties go to the smallest doc_id; an empty
table has no rows; a text may be of any length (one task makes its set); other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SOLID, marked, mix, numbered, only, row_key, small, spread, steps, without, word_hashes, word_spans, written

#: Words in a shingle, likeness in hundredths, shingles in the sets of one trie (a longer set has a trie of its own).
SHINGLE, LIKE, BLOCK = 3, 90, 50_000
#: Length of the list of frequent shingles, documents that make one frequent, classes that are all paired on a shared shingle.
FREQUENT, OFTEN, FEW = 500_000, 4, 8
#: Bits of the parity sketch, hashes counted at a time.
SKETCH, COUNTED = 1024, 2_000_000
_COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("bits", pa.list_(pa.int64())), ("head", pa.list_(pa.int64()))])
_SETS_SQL = "doc_id bigint, key binary, n bigint, sig binary, bits array<bigint>, head array<bigint>"
_WHOLE = pa.schema([("cls", pa.int64()), ("whole", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_lists(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's shingles, repeats included; a text of fewer words is one shingle."""
    low = LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, SOLID)
    words = word_hashes(low, starts, ends)
    n = max(len(words) - size + 1, 0)
    all_ = np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        all_ = mix(all_ ^ words[k : k + n]) + np.uint64(size)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(all_[a : b - size + 1])
        else:
            h = np.zeros(1 if b > a else 0, np.uint64)
            for w in words[a:b]:
                h = mix(h ^ w) + np.uint64(b - a)
            out.append(h)
    return out


def frequent(docs: DataFrame, like: int = LIKE, size: int = SHINGLE, limit: int = FREQUENT) -> np.ndarray:
    """The shingles of the low part of the hash range that most documents hold: rows of (shingle, documents), by shingle.

    Counted over all documents. The low part is two and a half times as long as a prefix: prefixes are taken from it, unless most of a
    text is frequent. The order of shingles needs no more than this bounded list: any order gives the same links, and this one keeps
    the shingles that many documents share out of the prefixes.
    """
    low = np.uint64(min(1.0, 0.025 * (100 - like)) * (2**64 - 2**12))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times)], schema=_COUNTS)

        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                for hashes in shingle_lists(data, offsets, size):
                    own = np.unique(hashes[hashes < low])
                    held.append(own)
                    n += len(own)
                if n > COUNTED:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    counts = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    out = np.stack([top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy().astype(np.uint64)], 1) if top.num_rows else np.zeros((0, 2), np.uint64)
    return out[np.argsort(out[:, 0])]


def _ordered(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Distinct hashes in the global order: by the documents of the frequent list (0 outside), then by hash."""
    if not len(often):
        return own
    at = np.searchsorted(often[:, 0], own)
    at[at == len(often)] = 0
    times = np.where(often[at, 0] == own, often[at, 1], 0)
    return own[np.argsort(times, kind="stable")]


def sets(docs: DataFrame, often: np.ndarray, like: int = LIKE, size: int = SHINGLE) -> DataFrame:
    """Per row (doc_id, text, key): doc_id, key, n, sig (of the whole set), bits (parities of the hashes by their low bits), and the first shingles (head) in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                out: list[list] = [[], [], [], []]
                for hashes in shingle_lists(data, offsets, size):
                    own = np.unique(hashes)
                    n = len(own)
                    out[0].append(n)
                    out[1].append(xxhash.xxh3_128_digest(own.tobytes()))
                    out[2].append(np.packbits((np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).view(np.int64))
                    own = _ordered(own, often)
                    out[3].append(own[: n + (-like * n) // 100 + 1 if n else 0].view(np.int64))
                arrays = [batch.column(0)[a:b].cast(pa.int64()), batch.column(2)[a:b].cast(pa.binary()), *[pa.array(x, f.type) for x, f in zip(out, list(_SETS)[2:], strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=_SETS)

    return docs.select("doc_id", "text", "key").mapInArrow(run, _SETS_SQL)


def _long_enough(like: int, a: str, b: str) -> Column:
    """Of two classes that share a shingle: whether the sizes behind it (n less pos, after the suffix) allow a link."""
    behind = F.least(F.col(f"n{a}") - F.col(f"pos{a}"), F.col(f"n{b}") - F.col(f"pos{b}"))
    return behind * (100 + like) >= like * (F.col(f"n{a}") + F.col(f"n{b}"))


def _alike(like: int, a: str, b: str) -> Column:
    """Whether the parities allow a link: no more bits differ than elements do."""
    differ = F.aggregate(F.zip_with(f"bits{a}", f"bits{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col(f"n{a}") + F.col(f"n{b}")
    return (total - differ) * (100 + like) >= 2 * like * total


def _named(df: DataFrame, suffix: str, *keys: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def shared(classes: DataFrame) -> DataFrame:
    """(token, cls, n, pos, c) of the prefix shingles that c > 1 classes (cls, n, head) hold, at position pos of the class."""
    heads = classes.select("cls", "n", F.posexplode("head").alias("pos", "token"))
    counts = heads.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    return heads.join(counts, "token")


def candidates(held: DataFrame, classes: DataFrame, like: int = LIKE, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot): pairs (a, b) of classes that may link, and the rows of shingles that more than `few` classes share.

    All classes of a shingle that few share are paired. Of one that many share, each is paired with the centre of its size band, the
    class in which the shingle stands first.
    """
    bits = classes.select("cls", "bits")
    some = held.where(F.col("c") <= few).drop("c")
    pairs = _named(some, "_a", "token").join(_named(some, "_b", "token"), "token").where(F.col("cls_a") < F.col("cls_b")).where(_long_enough(like, "_a", "_b"))
    pairs = pairs.select("cls_a", "cls_b", "n_a", "n_b").distinct()
    pairs = pairs.join(_named(bits, "_a"), "cls_a").join(_named(bits, "_b"), "cls_b").where(_alike(like, "_a", "_b"))

    hot = written(held.where(F.col("c") > few).drop("c").join(bits, "cls"), "jaccard-hot")
    # Linked sizes are within one band of each other, and each class is in its own band and the next.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / like)))
    banded = hot.withColumn("band", F.explode(F.array(band, band + 1)))
    centres = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "cls", "n", "bits")).alias("x")).select("token", "band", "x.*")
    centres = written(centres, "jaccard-centres")
    star = _named(banded, "_b", "token", "band").join(_named(centres, "_a", "token", "band"), ["token", "band"]).where(F.col("cls_a") != F.col("cls_b"))
    star = star.where(_long_enough(like, "_a", "_b") & _alike(like, "_a", "_b"))
    ends = [F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")]
    return written(pairs.select(*ends).unionByName(star.select(*ends)).distinct(), "jaccard-pairs"), hot


def outsiders(hot: DataFrame, labels: DataFrame, like: int = LIKE) -> DataFrame:
    """Pairs (a, b) of different components on a shingle that many classes share: those outside its main component with all others."""
    known = hot.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    known = written(known, "jaccard-labelled")
    main = known.groupBy("token", "label").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels"))
    main = written(main.where("labels > 1").select("token", F.col("x.label").alias("main")), "jaccard-main")
    placed = written(known.join(main, "token"), "jaccard-outside")
    out = _named(placed.where("label <> main"), "_a", "token").join(_named(placed, "_b", "token"), "token")
    out = out.where("label_a <> label_b AND (label_b = main_b OR cls_a < cls_b)").where(_long_enough(like, "_a", "_b") & _alike(like, "_a", "_b"))
    return written(out.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct(), "jaccard-more-pairs")


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): the least id that it reaches. Labels spread and jump until none changes."""
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(ends.unionByName(ends.select("a", F.col("a").alias("b"))).distinct(), "links")  # with a loop at every node
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")), "labels")
    while True:
        known = both.join(labels, both["b"] == labels["id"])
        step = known.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("via"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        far = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = step.join(far, "via").select("id", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("old")).alias("moved"))
        new = written(new, "labels")
        moved = bool(new.where("moved").take(1))
        labels = new.select("id", "label")
        if not moved:
            return labels


class Trie:
    """Sets as paths of tokens in the global order; a node holds the tokens up to the next branching and its range of sets."""

    def __init__(self, paths: list[np.ndarray]):
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.roots = self._nodes(0, len(self.paths), 0)

    def _nodes(self, lo: int, hi: int, depth: int) -> list[tuple]:
        """Nodes under a path of `depth` tokens: (tokens, first set, set past the last, ends here, children), built without recursion."""
        top: list[tuple] = []
        todo = [(lo, hi, depth, top)]
        while todo:
            lo, hi, depth, into = todo.pop()
            while lo < hi:
                first = self.paths[lo]
                if len(first) == depth:  # a set that ends at the node above
                    into.append((first[depth:], lo, lo + 1, []))
                    lo += 1
                    continue
                end = lo + 1
                while end < hi and self.paths[end][depth] == first[depth]:
                    end += 1
                last = self.paths[end - 1]
                n = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:n] != last[depth:n])
                stop = depth + int(differ[0]) if len(differ) else n
                below: list[tuple] = []
                into.append((first[depth:stop], lo, end, below))
                if end - lo > 1:
                    todo.append((lo, end, stop, below))
                lo = end
        return top

    def walk(self, member: np.ndarray, n: int, like: int) -> Iterator[int]:
        """Sets at least `like` hundredths like the probe (its tokens marked in `member`, n in number)."""
        stack = [(node, 0, 0) for node in self.roots]
        while stack:
            (tokens, lo, hi, below), depth, overlap = stack.pop()
            leaf = not below
            depth += len(tokens)
            overlap += int(member[tokens].sum())
            sizes = self.sizes[lo:hi]
            # The most that each set below can still share: what remains of it, and what remains of the probe.
            reach = overlap + np.minimum(sizes - depth, n - overlap)
            if leaf:
                reach = np.array([overlap])
            if not (reach * (100 + like) >= like * (sizes + n)).any():
                continue
            if leaf:
                yield self.order[lo]
            else:
                stack += [(node, depth, overlap) for node in below]


def trie_links(probe: bytes, paths: list[bytes], like: int = LIKE) -> list[int]:
    """Which of the sets link with the probe; sets are hashes in the global order."""
    raw = [np.frombuffer(p, np.uint64) for p in [probe, *paths]]
    _, tokens = np.unique(np.concatenate(raw), return_inverse=True)
    cuts = np.cumsum([0, *[len(r) for r in raw]])
    own = [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    member = np.zeros(int(tokens.max()) + 1, bool)
    member[own[0]] = True
    return list(Trie(own[1:]).walk(member, len(own[0]), like))


def wholes(docs: DataFrame, wanted: DataFrame, often: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """(cls, whole): the sets, in the global order, of the wanted classes (key, cls) from the texts of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                own = [_ordered(np.unique(hashes), often).tobytes() for hashes in shingle_lists(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array(own, pa.binary())], schema=_WHOLE)

    # Few wanted keys are broadcast; of many, only texts that a bitmap of them lets through are moved. Repeated rows give a set each.
    rows = docs.select("key", "text")
    few = small(wanted)
    rows = rows if few is not wanted else marked(rows, "key", wanted).where("_maybe").drop("_maybe")
    return rows.join(few, "key").select("cls", "text").mapInArrow(run, "cls bigint, whole binary")


def links(pairs: DataFrame, held: DataFrame, sizes: DataFrame, like: int = LIKE, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) that link, by walking tries: each pair goes to the class with more pairs, whose sets make tries of about `block` shingles."""
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = written(ends.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.count("*").alias("d"), F.sum("n").alias("tokens")), "jaccard-degrees")
    known = pairs.join(degrees.select(F.col("a"), F.col("d").alias("da"), F.col("tokens").alias("ta")), "a").join(degrees.select(F.col("a").alias("b"), F.col("d").alias("db"), F.col("tokens").alias("tb")), "b")
    hub = F.col("da") >= F.col("db")
    dealt = known.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("probe"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("cls"), F.ceil(F.when(hub, F.col("ta")).otherwise(F.col("tb")) / block).alias("parts"))
    dealt = written(dealt.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("parts"), "jaccard-dealt")
    probes = dealt.select("probe", "part").distinct().withColumn("cls", F.col("probe"))
    rows = dealt.unionByName(probes).join(held, "cls").select("probe", "part", "cls", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in batch.to_pylist())
        for (probe, _), group in groupby(each, key=lambda r: (r["probe"], r["part"])):
            own = {r["cls"]: r["whole"] for r in group}
            first = own.pop(probe)
            ids = list(own)
            if found := trie_links(first, list(own.values()), like):
                yield pa.RecordBatch.from_arrays([pa.array([probe] * len(found)), pa.array([ids[j] for j in found])], schema=_LINKS)

    rows = rows.repartition(spread(rows.sparkSession), "probe", "part").sortWithinPartitions("probe", "part")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _components(docs: DataFrame, like: int, size: int, block: int, few: int) -> DataFrame:
    """Per row of docs (doc_id, text, key): doc_id, key, n_shingles, component_id."""
    often = frequent(docs, like, size)
    rows = written(sets(docs, often, like, size).withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    # A class is named by the first of its rows.
    named = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least"))
    named = written(named, "jaccard-classes")
    classes = numbered(rows, "row", named.select(F.col("cls").alias("row"))).select(F.col("row").alias("cls"), "key", "n", "bits", "head")
    classes = written(classes, "jaccard-heads")
    sizes = classes.select("cls", "n")

    pairs, hot = candidates(written(shared(classes), "jaccard-shared"), classes, like, few)
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(hot.select("cls")).distinct()
    wanted = written(classes.select("cls", "key").join(written(wanted, "jaccard-wanted"), "cls").select("key", "cls"), "jaccard-keys")
    held = written(wholes(docs, wanted, often, size), "jaccard-sets")
    if held.count() > wanted.count():  # repeated rows gave their set each
        held = written(held.groupBy("cls").agg(F.first("whole").alias("whole")), "jaccard-sets")
    labels = connected(written(links(pairs, held, sizes, like, block), "jaccard-links"))
    more = outsiders(hot, labels, like)
    if more.take(1):
        found = written(links(more, held, sizes, like, block), "jaccard-more-links")
        name = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        joined = found.join(name("a"), "a", "left").join(name("b"), "b", "left")
        merged = connected(joined.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
        merged = merged.select(F.col("id").alias("label"), F.col("label").alias("last"))
        ends = labels.unionByName(merged.select(F.col("label").alias("id"), "label")).distinct()
        labels = written(ends.join(merged, "label", "left").select("id", F.coalesce("last", "label").alias("label")).groupBy("id").agg(F.min("label").alias("label")), "jaccard-labels")
    linked = written(named.join(labels.withColumnRenamed("id", "cls"), "cls").select("sig", "least", "label"), "jaccard-linked")
    smallest = written(linked.groupBy("label").agg(F.min("least").alias("component")), "jaccard-components")
    found = linked.join(smallest, "label").select("sig", "component")
    named = written(named.join(found, "sig", "left").select("sig", F.coalesce("component", "least").alias("component")), "jaccard-named")
    has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "key", "n", F.when(has, F.col("sig")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")).cast("binary")).alias("sig"))
    return out.join(named, "sig", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _keyed(docs: DataFrame) -> DataFrame:
    docs = only(docs, "doc_id", "text")
    return docs.select("doc_id", "text", row_key(docs["doc_id"], docs["text"]).alias("key"))


def components(docs: DataFrame, like: int = LIKE, size: int = SHINGLE, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _components(_keyed(docs), like, size, block, few).drop("key")


def keep_one(docs: DataFrame, like: int = LIKE, size: int = SHINGLE, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; rows without doc_id, and repeats of a kept row, stay.

    Each row is judged by its own doc_id and text, also where its doc_id is repeated with another text.
    """
    gone = _components(_keyed(docs), like, size, block, few).where("component_id < doc_id").select("key").distinct()
    gone = written(gone, "jaccard-gone")
    return without(docs, gone)
