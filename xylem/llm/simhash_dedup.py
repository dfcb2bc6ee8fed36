"""SimHash near-dedup with an LSH forest over word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, bit_filter, cut, fresh_path, keep_one, lookup, may_hold, pieces, release, text_of
from ._graph import Buckets, linked, near_pairs
from ._words import PIECE_CHARS, mix, shingles_of, simhashes

WORDS = 5
SIMILARITY = 0.8
#: Chance that a pair just at the similarity shares a group in some tree.
RECALL = 0.97
#: Fingerprints are of 128 bits; a pair is verified if at most so many differ (19.4 expected at similarity 0.8, deviation 4).
MAX_BITS = 36
#: Distinct texts under a prefix beyond which it is made longer, and bits that a sparse region's prefix may be shorter than a dense one's.
LEAF, SHORTER = 512, 6
FILTER_BITS = 1 << 24
SEED = 20240229


def agreement(similarity: float) -> float:
    """Chance that a bit of two SimHashes agrees, for sets of about equal size of this Jaccard similarity."""
    return 1 - acos(2 * similarity / (1 + similarity)) / pi


def forest_shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(trees, depth) for n texts: with so many trees, prefixes of ``depth`` bits give the recall; a leaf of texts shares one on average."""
    depth = min(28, max(4, ceil(log2(max(2, n / leaf)))))
    return ceil(log(1 - recall) / log(1 - agreement(similarity) ** depth)), depth


def permutations(trees: int) -> np.ndarray:
    """For each tree the order in which it takes the 128 bits."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(128) for _ in range(trees)])


class Forest(Buckets):
    """Tries over permuted bits. A text's prefix grows in a tree while more than ``leaf`` texts share it; where that makes it
    longer than ``depth``, at which the trees together reach the target recall, it climbs back to ``depth``.

    So in sparse regions prefixes are shorter, by up to SHORTER bits, and all that share the prefix are compared, in dense
    ones as many as the recall needs. Buckets are the prefixes that any region has at least.
    """

    def __init__(self, trees: int, depth: int, leaf: int = LEAF):
        self.depth, self.leaf, self.above = depth, leaf, max(0, depth - SHORTER)
        self.order = permutations(trees)
        self.masks = np.array([[sum(1 << int(p) for p in o[:depth] if p < 64), sum(1 << int(p - 64) for p in o[:depth] if p >= 64)] for o in self.order], np.uint64)

    @staticmethod
    def _bits(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.uint64)
        for p in places.tolist():
            out = (out << np.uint64(1)) | ((prints[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1))
        return out

    def of(self, prints: np.ndarray) -> np.ndarray:
        return np.stack([self._bits(prints, o[: self.above]) | np.uint64(k << 32) for k, o in enumerate(self.order)], axis=1)

    def key(self, bucket: np.ndarray) -> np.ndarray:
        return (bucket >> np.uint64(32)).astype(np.int64)

    def groups(self, bucket: np.ndarray, prints: np.ndarray, wholly: bool) -> np.ndarray:
        more = self.depth - self.above
        label = np.zeros(len(bucket), np.uint64)
        tree = self.key(bucket)
        for t in np.unique(tree).tolist():
            own = tree == t
            label[own] = self._bits(prints[own], self.order[t, self.above : self.depth])
        label |= bucket << np.uint64(more)
        length = np.full(len(bucket), more if not wholly else -1)
        if wholly:
            order = np.argsort(label, kind="stable")
            ranked = label[order]
            for e in range(more + 1):  # the shortest prefix that a leaf holds, or the longest
                x = ranked >> np.uint64(more - e)
                heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
                n = np.diff(np.append(heads, len(x)))
                few = np.repeat((n <= self.leaf) | (e == more), n)
                now = order[few]
                length[now] = np.where(length[now] < 0, e, length[now])
        return ((label >> (more - length).astype(np.uint64)) << np.uint64(4)) | length.astype(np.uint64)


def _set_keys(h: np.ndarray, first: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's set of shingles; of the text itself where it has none."""
    import xxhash

    n = np.diff(first)
    keys = np.zeros((2, len(n)), dtype=np.uint64)
    used = np.flatnonzero(n)
    if len(used):
        for k in range(2):
            keys[k, used] = mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5 * k + 1 & 0xFFFFFFFFFFFFFFFF)), first[:-1][used]) + n[used].astype(np.uint64))
    for i in np.flatnonzero(n == 0):
        d = xxhash.xxh3_128_digest(b"text:" + texts[i].encode("utf-8", "surrogatepass"))
        keys[:, i] = np.frombuffer(d, dtype=np.uint64)
    return keys[0], keys[1]


def signatures(df: DataFrame, id_col: str, text_col: str, width: int = WORDS) -> DataFrame:
    """(_id, k0, k1, size, f0, f1) of every row: keys of its shingle set, their number, its SimHash."""
    arrow_rows(df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = []
            for lo, hi in pieces([len(t) for t in texts], PIECE_CHARS):
                h, first = shingles_of(texts[lo:hi], width)
                parts.append((*_set_keys(h, first, texts[lo:hi]), np.diff(first).astype(np.int32), *simhashes(h, first).T))
            k0, k1, n, f0, f1 = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in (k0, k1)), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (f0, f1))], names=["_id", "k0", "k1", "size", "f0", "f1"])

    kind = dict(df.dtypes)[id_col]
    return df.select(df[id_col], text_of(df, text_col)).mapInArrow(sign, f"_id {kind}, k0 long, k1 long, size int, f0 long, f1 long")


def shingle_sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles binary: ascending 32-bit hashes) of the nodes (node, _id, k0, k1).

    Texts are read again, and only of ids that a filter of fixed size lets through; where ids repeat the keys decide.
    """
    wanted = df.select(df[id_col].alias("_id"), text_of(df, text_col).alias("_text")).filter(may_hold(bit_filter(nodes, "_id", FILTER_BITS), F.col("_id"), FILTER_BITS))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in pieces([len(t) for t in texts], PIECE_CHARS):
                h, first = shingles_of(texts[lo:hi], width)
                k0, k1 = _set_keys(h, first, texts[lo:hi])
                sets = [np.unique((h[a:z] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k0.view(np.int64)), pa.array(k1.view(np.int64)), pa.array(sets, pa.binary())], names=["k0", "k1", "shingles"])

    sets = wanted.select("_text").mapInArrow(cut_up, "k0 long, k1 long, shingles binary")
    return nodes.select("node", "k0", "k1").join(sets, ["k0", "k1"]).dropDuplicates(["node"]).select("node", "shingles")


def jaccard_at_least(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return met.mapInArrow(check, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, max_bits: int = MAX_BITS) -> DataFrame:
    """Classes of near-duplicate texts: connected by pairs whose sets of ``words``-word shingles have Jaccard similarity of at least ``similarity``.

    Texts of equal sets of shingles are one node. Each tree of the forest takes the bits of their SimHashes in an order of
    its own; nodes with a common prefix, as long as the density where they are asks for, are compared by Hamming distance;
    see Forest. The number of trees follows from the recall wanted at the similarity. Near pairs are verified on the
    shingles themselves, so none is false (but for collisions of 32-bit hashes).

    Returns a row for each of df's rows: id_col, class_id (largest id of the class), class_size (rows), kept (one row of
    the class: that of the largest id), n_shingles. Words are lower-cased runs of letters, digits and underscores. A text
    of fewer words is one shingle; texts without words are in a class only with equal texts; null counts as empty. Null
    ids come before all others; of rows equal in id and text exactly one may be kept. An empty table gives no rows.
    """
    spark = df.sparkSession
    signed = cut(signatures(df, id_col, text_col, words).withColumn("_row", F.monotonically_increasing_id()))
    members = cut(keep_one(signed, ["k0", "k1"], ["_id", "_row"]).withColumn("node", F.col("_keep._row")))
    nodes = members.filter("_row = node")
    within = nodes.filter("size > 0")
    n = within.count()
    pairs = cut(near_pairs(within, Forest(*forest_shape(n, similarity, recall)), most=max_bits, ratio=similarity))
    release(spark)
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    where = fresh_path(spark, "shingles")
    shingle_sets(df, nodes.join(used, "node", "left_semi"), id_col, text_col, words).write.parquet(where)
    sets = spark.read.parquet(where)
    comp = linked(pairs, lambda p: jaccard_at_least(p, sets, similarity))
    joined = nodes.select("node", "_id", "_row", F.col("_size").alias("rows")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = keep_one(joined, ["comp"], ["_id", "_row"], weight="rows").select("node", F.struct("_keep", F.col("_size").alias("class_size")).alias("_class"))
    found = lookup(members.select("_id", "_row", "node", "size"), "node", classes, "_class")
    return found.select(F.col("_id").alias(id_col), F.col("_class._keep._id").alias("class_id"), F.col("_class.class_size").alias("class_size"), (F.col("_class._keep._row") == F.col("_row")).alias("kept"), F.col("size").cast("long").alias("n_shingles"))
