"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence kept of each connected group."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, bit_filter, cut, fresh_path, keep_one, may_hold, pieces, release, text_of, together
from ._edits import distances_within
from ._graph import Buckets, linked, near_pairs
from ._words import WEIGHTS, code_points, folded, mix, powers, runs, simhashes, span_hashes, word_table

SIMILARITY = 0.8
#: Two fingerprints of 128 bits with at most so many differing bits surely share a key, at every size; see Blocks.
SURE_BITS = 11
#: Lines that share a key are verified if at most so many of the 128 bits differ.
MAX_BITS = 28
FILTER_BITS = 1 << 24
#: Spreads a line's number over the bits of a filter.
SPREAD = 0x9E3779B1
#: Characters of texts, and bytes of pairs of lines, that are handled at a time.
PIECE, VERIFY_BYTES = 200_000, 3 << 24


def _take(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of (n, 2) prints at these places, as one number."""
    out = np.zeros(len(prints), np.uint64)
    for a, z in zip(*runs_of(places), strict=True):  # a run of consecutive places within a word at a time
        out = (out << np.uint64(z - a)) | ((prints[:, a // 64] >> np.uint64(a % 64)) & np.uint64((1 << (z - a)) - 1))
    return out


def runs_of(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of consecutive places, cut at 64."""
    cuts = np.flatnonzero((np.diff(places) != 1) | (places[1:] == 64)) + 1
    parts = np.split(places, cuts)
    return [int(x[0]) for x in parts], [int(x[-1]) + 1 for x in parts]


class Blocks(Buckets):
    """Fingerprints cut into ``sure`` + c blocks; each choice of c blocks is a key.

    By the pigeonhole principle, of two fingerprints that differ in at most ``sure`` bits c blocks at least agree, so one
    key is the same. Large groups can be searched the same way again, for pairs within ``sure`` bits: in the bits outside
    their key, cut into ``sure`` + 1 parts, one part of such a pair is the same.
    """

    once = True

    def __init__(self, sure: int = SURE_BITS, together: int = 1):
        self.sure = sure
        edges = np.linspace(0, 128, sure + together + 1).astype(int)
        blocks = [np.arange(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        self.places = [np.concatenate(x) for x in combinations(blocks, together)]
        self.masks = np.array([[sum(1 << int(p) for p in x if p < 64), sum(1 << int(p - 64) for p in x if p >= 64)] for x in self.places], np.uint64)

    def of(self, prints: np.ndarray) -> np.ndarray:
        return np.stack([_take(prints, x) | np.uint64(k << 48) for k, x in enumerate(self.places)], axis=1)

    def key(self, bucket: np.ndarray) -> np.ndarray:
        return (bucket >> np.uint64(48)).astype(np.int64)

    def parts(self, prints: np.ndarray, bucket: int) -> np.ndarray:
        rest = np.setdiff1d(np.arange(128), self.places[bucket >> 48])
        return np.stack([_take(prints, x) for x in np.array_split(rest, self.sure + 1)], axis=1)


class Lines:
    """The lines with a word of some texts: their text, number in it, keys of the sequence of words, size in characters, SimHash and place in the code points."""

    def __init__(self, texts: list[str], prints: bool = True):
        codes, begin = code_points(texts)
        self.low = folded(codes)
        s, e = runs(self.low != 0)
        words = span_hashes(self.low, s, e)
        feeds = np.flatnonzero(codes == 10)
        first = np.searchsorted(s, np.concatenate([[0], feeds]))
        n = np.diff(first)
        line = np.flatnonzero(n)
        self.text = np.searchsorted(begin, feeds[line], side="right") - 1
        self.number = line - np.searchsorted(feeds, begin[:-1])[self.text]
        self.start, self.end = s[first[line]] if len(line) else line, e[first[line + 1] - 1] if len(line) else line
        heads = first[line]
        at = np.arange(len(words)) - np.repeat(heads, n[line])
        up = powers(int(n.max(initial=0)))[0]
        sums = lambda x: np.add.reduceat(x * up[at], heads) if len(heads) else np.zeros(0, np.uint64)
        self.k0, self.k1 = mix(sums(words)), mix(sums(mix(words ^ np.uint64(0x5BD1E9955BD1E995))))
        self.size = (np.add.reduceat(e - s + 1, heads) - 1 if len(heads) else heads).astype(np.int32)
        if prints:
            self.prints = simhashes(mix(words), np.append(heads, len(words)), 2, np.minimum(e - s, WEIGHTS - 1))

    def normal(self, i: int) -> str:
        """The lower-cased words of a line, with one space between them."""
        low = self.low[self.start[i] : self.end[i]]
        return " ".join(np.where(low == 0, np.uint32(32), low).tobytes().decode("utf-32-le", "surrogatepass").split())


@lru_cache(maxsize=1)
def has_word() -> re.Pattern:
    """A character of a word, as word_table has them."""
    s, e = runs(word_table())
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z - 1))}" for a, z in zip(s.tolist(), e.tolist(), strict=True)) + "㄀-\U0010ffff]")


KEYED = ["_id", "_t0", "_t1"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _t0, _t1, _text) of every row: id and 128 bits of hash tell rows apart that differ in id or text."""
    docs = df.select(df[id_col].alias("_id"), text_of(df, text_col).alias("_text"))
    return docs.select("_id", F.xxhash64("_text").alias("_t0"), F.xxhash64(F.lit(1), "_text").alias("_t1"), "_text")


def line_table(docs: DataFrame) -> DataFrame:
    """(_id, _t0, _t1, line, k0, k1, size, f0, f1) of the keyed rows: one for every line with a word."""
    kind = dict(docs.dtypes)["_id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in pieces([len(t) for t in texts], PIECE):
                x = Lines(texts[lo:hi])
                at = pa.array(x.text + lo)
                f0, f1 = (np.ascontiguousarray(x.prints[:, k]).view(np.int64) for k in range(2))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), *(pa.array(v) for v in (x.number.astype(np.int32), x.k0.view(np.int64), x.k1.view(np.int64), x.size, f0, f1))], names=[*KEYED, "line", "k0", "k1", "size", "f0", "f1"])

    return docs.mapInArrow(split, f"_id {kind}, _t0 long, _t1 long, line int, k0 long, k1 long, size int, f0 long, f1 long")


def _line_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line_text) of the nodes (node, _at, k0, k1): texts are read again, of rows and lines in them that filters of fixed size let through."""
    at = nodes.select(F.col("_at._t0").alias("_t0"), F.col("_at.line").cast("long").alias("_line"))
    wanted = docs.filter(may_hold(bit_filter(at, "_t0", FILTER_BITS), F.col("_t0"), FILTER_BITS))
    places = at.select(F.col("_t0").bitwiseXOR(F.col("_line") * F.lit(SPREAD)).alias("_place"))
    own = bit_filter(places, "_place", FILTER_BITS, hashed=True).toArrow().column(0).combine_chunks().values.to_numpy().view(np.uint64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, t0 = b.column(0).to_pylist(), b.column(1).to_numpy()
            for lo, hi in pieces([len(t) for t in texts], 8 * PIECE):
                parts = [t.split("\n") for t in texts[lo:hi]]
                n = np.array([len(x) for x in parts], np.int64)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                bit = ((np.repeat(t0[lo:hi], n) ^ (number * SPREAD)) & (FILTER_BITS - 1)).astype(np.uint64)
                held = np.flatnonzero((own[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                lines = [line for x in parts for line in x]
                lines = [lines[i] for i in held.tolist()]
                for k, m in pieces([len(t) for t in lines], PIECE):
                    x = Lines(lines[k:m], prints=False)
                    yield pa.RecordBatch.from_arrays([pa.array(x.k0.view(np.int64)), pa.array(x.k1.view(np.int64)), pa.array([x.normal(i) for i in range(len(x.k0))], pa.string())], names=["k0", "k1", "line_text"])

    lines = wanted.select("_text", "_t0").mapInArrow(split, "k0 long, k1 long, line_text string")
    return nodes.select("node", "k0", "k1").join(lines, ["k0", "k1"]).dropDuplicates(["node"]).select("node", "line_text")


def edit_similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with 1 - distance / longer length of at least the similarity."""
    met = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("line_text").alias("_x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line_text").alias("_y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(batches, VERIFY_BYTES):
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            most = np.array([int(max(len(s), len(t)) * (1 - similarity) + 1e-9) for s, t in zip(x, y, strict=True)], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(distances_within(x, y, most), pa.bool_()))

    return met.select("a", "b", "_x", "_y").mapInArrow(check, "a long, b long")


def line_nodes(docs: DataFrame) -> DataFrame:
    """(node, k0, k1, size, f0, f1, lines, _at: the first occurrence) of the distinct lines, cut."""
    at = F.struct(*KEYED, "line")
    grouped = line_table(docs).groupBy("k0", "k1").agg(F.min(at).alias("_at"), F.count(F.lit(1)).alias("lines"), F.min("size").alias("size"), F.min("f0").alias("f0"), F.min("f1").alias("f1"))
    return cut(grouped.withColumn("node", F.monotonically_increasing_id()))


def near_lines(nodes: DataFrame, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b, distance) of the nodes whose fingerprints share a key and differ in at most max_bits bits, cut.

    The keys are the same for any number of nodes, and all that share one are compared, so whether a pair is found depends
    on its two lines alone; comparisons grow as the square of the nodes.
    """
    return cut(near_pairs(nodes, Blocks(), most=max_bits, ratio=similarity))


def line_classes(docs: DataFrame, *, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """The line occurrences that stay, of keyed rows: (_id, _t0, _t1, line, class_lines), the first of each class of lines.

    Lines are compared as lower-cased words with single spaces; equal ones are one node. A word counts in a line's SimHash
    by its length, as edits do. Nodes that share a pigeonhole key, and whose fingerprints differ in at most ``max_bits``
    bits, are verified by edit similarity; classes are connected by pairs that hold. Lines without words belong to no class.
    """
    spark = docs.sparkSession
    nodes = line_nodes(docs)
    release(spark)
    pairs = near_lines(nodes, similarity, max_bits)
    release(spark)
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    where = fresh_path(spark, "lines")
    own = cut(nodes.join(used, "node", "left_semi").select("node", "_at", "lines", "k0", "k1"))
    _line_texts(docs, own).write.parquet(where)
    texts = spark.read.parquet(where)
    comp = linked(pairs, lambda p: edit_similar(p, texts, similarity))
    fuzzy = own.select("node", "_at", "lines").join(comp, "node").groupBy("comp").agg(F.min("_at").alias("_at"), F.sum("lines").alias("class_lines"))
    alone = nodes.join(comp, "node", "left_anti").select("_at", F.col("lines").alias("class_lines"))
    return alone.unionByName(fuzzy.select("_at", "class_lines")).select("_at.*", "class_lines")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, n_lines, n_dropped, clean_text) of every row: the text without the lines that stay elsewhere, or earlier in it.

    Of a class of lines the occurrence stays that comes first by id (null before all others), then by the text's hash and
    the line's number. n_lines counts lines with words; lines without any stay. A null text counts as empty. Of rows equal
    in id and text, lines stay in one alone. An empty table gives no rows.
    """
    arrow_rows(df.sparkSession)
    docs = keyed(df, id_col, text_col)
    stay = line_classes(docs, similarity=similarity, max_bits=max_bits).groupBy(*KEYED).agg(F.array_sort(F.collect_list("line")).alias("_stay"))  # of one text, so as large as it at most
    release(df.sparkSession)
    again = lambda *keys: docs.groupBy(*keys).count().filter("count > 1").drop("count")
    repeated = None if again("_id").isEmpty() else cut(again(*KEYED))  # texts are read only where ids repeat
    if repeated is None or repeated.isEmpty():
        met = _with_stay(docs, stay)
    else:  # a hot row may make up any part of the table: the salted group gives one of its copies what stays
        at = F.struct(F.col("_id").isNull(), *KEYED)
        whole = cut(docs.withColumn("_again", may_hold(bit_filter(repeated.select(F.xxhash64(at).alias("_k")), "_k", FILTER_BITS), F.xxhash64(at), FILTER_BITS)).withColumn("_row", F.monotonically_increasing_id()))
        copies = whole.filter("_again").select(F.xxhash64(at).alias("_k"), "_t1", "_row")
        first = keep_one(copies, ["_k", "_t1"], ["_row"]).filter("_keep._row = _row").select("_row")
        one = whole.filter("not _again").drop("_again", "_row").unionByName(whole.join(first, "_row", "left_semi").drop("_again", "_row"))
        other = whole.filter("_again").join(first, "_row", "left_anti").select("_id", "_text", F.lit(None).cast("array<int>").alias("_stay"))
        met = _with_stay(one, stay).unionByName(other)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = has_word()
        for b in batches:
            out, total, dropped = [], [], []
            for text, stays in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keep = set(stays or ())
                lines = text.split("\n")
                kept = [x for i, x in enumerate(lines) if i in keep or not word.search(x)]
                dropped.append(len(lines) - len(kept))
                total.append(len(keep) + dropped[-1])
                out.append("\n".join(kept) if dropped[-1] else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], names=[id_col, "n_lines", "n_dropped", "clean_text"])

    return met.mapInArrow(clean, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_lines long, n_dropped long, clean_text string")


def _with_stay(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """(_id, _text, _stay) of the keyed rows."""
    own = stay.select(F.col("_id").alias("_i"), "_t0", F.col("_t1").alias("_u"), "_stay").hint("shuffle_hash")
    return docs.join(own, (docs["_t0"] == own["_t0"]) & (docs["_t1"] == own["_u"]) & docs["_id"].eqNullSafe(own["_i"]), "left").select(docs["_id"], "_text", "_stay")
