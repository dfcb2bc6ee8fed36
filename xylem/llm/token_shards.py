"""Training-order materialisation: a keyed Feistel permutation gives every sequence a slot, ranges of slots are written as fixed-stride shards."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import arrow_rows, fresh_path, open_fs, release, text_of

SEQUENCE = 1024
#: Sequences in a shard.
SHARD_SLOTS = 4096
#: Parts of the slots that are shuffled and written one after the other, so that shuffle files take a part of the disk at a time.
WAVES = 3
ROUNDS = 6
KEY = 0x5DEECE66D
#: Bytes before a sequence's ids: ids used, its pieces in the shard's index (the first, and their number), and spare bytes.
HEAD = np.dtype([("used", "<i4"), ("first", "<i4"), ("pieces", "<i4"), ("spare", "<i4")])
#: A run of a document's ids in a sequence: where in the document and in the sequence it begins, and whether the id is null.
PIECE = np.dtype([("doc", "<i8"), ("offset", "<i8"), ("start", "<i4"), ("null", "<i4")])
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("slots", pa.int64()), ("stride", pa.int64())])
SHARD_KINDS = "shard long, path string, slots long, stride long"
PACKED = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("used", pa.int32()), ("pieces", pa.binary()), ("body", pa.binary())])
PACKED_KINDS = "part int, at long, used int, pieces binary, body binary"


class Feistel:
    """A keyed permutation of 0 .. n - 1: a Feistel network over the least even number of bits that holds n, walked along its cycle until a value falls below n."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        rng = np.random.default_rng(key)
        self.keys = rng.integers(0, 1 << 63, rounds, dtype=np.uint64)

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._f(right, k)
        return right << np.uint64(self.half) | left  # halves change places, so the reversed keys undo it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():  # a cycle that begins below n comes back below n
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("xylem", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def vocabulary_of(path: str) -> int:
    """One more than the largest id of a rank file."""
    return max(_ranks(path).values(), default=0) + 1


def token_rows(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, tokens binary: 4-byte little-endian ids, n_tokens) of every row, by a rank file's byte-level BPE. A null text has no tokens."""
    arrow_rows(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_path)
        for b in batches:
            ids = [enc.encode_to_numpy(t, disallowed_special=()).astype("<u4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=["_id", "tokens", "n_tokens"])

    return df.select(df[id_col], text_of(df, text_col)).mapInArrow(encode, f"_id {dict(df.dtypes)[id_col]}, tokens binary, n_tokens long")


def _pack(documents: Iterator[tuple[int | None, np.ndarray]], sequence: int, wide: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    """Full sequences of a task's documents, one after another, and a last shorter one: PACKED, some hundred at a time."""
    part, at, ids, pieces, held = TaskContext.get().partitionId(), 0, [], [], 0

    def rows(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal at, ids, pieces, held
        every = np.concatenate(ids) if ids else np.zeros(0, wide)
        n = len(every) // sequence if whole else -(-len(every) // sequence)
        begin = np.array([x[2] for x in pieces] + [len(every)], np.int64)
        where, used, body = [], [], []
        for k in range(n):
            lo, hi = k * sequence, min((k + 1) * sequence, len(every))
            i, j = int(np.searchsorted(begin, lo, side="right")) - 1, int(np.searchsorted(begin, hi))
            own = np.zeros(j - i, PIECE)
            for m, (doc, offset, b) in enumerate(pieces[i:j]):
                own[m] = (doc or 0, offset + max(0, lo - b), max(0, b - lo), doc is None)
            where.append(own.tobytes())
            used.append(hi - lo)
            body.append(every[lo:hi].tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(used, pa.int32()), pa.array(where, pa.binary()), pa.array(body, pa.binary())], schema=PACKED)
        i = max(0, int(np.searchsorted(begin[:-1], n * sequence, side="right")) - 1) if n * sequence < len(every) else len(pieces)
        pieces = [(doc, offset + max(0, n * sequence - b), max(0, b - n * sequence)) for doc, offset, b in pieces[i:]]
        at, ids, held = at + n, [every[n * sequence :]], len(every) - n * sequence

    for doc, own in documents:
        if len(own):
            if int(own.max()) >= vocabulary:
                raise ValueError(f"id {int(own.max())} is beyond the vocabulary of {vocabulary}")
            pieces.append((doc, 0, held))
            ids.append(own.astype(wide))
            held += len(own)
        if held >= 256 * sequence:
            yield from rows(True)
    yield from rows(False)


def _wide(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65536 else "<u4"


def write_shards(docs: DataFrame, folder: str, *, ranks_path: str | None = None, id_col: str = "_id", text_col: str = "text", sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS, vocabulary: int | None = None, key: int = KEY, waves: int = WAVES) -> DataFrame:
    """Writes documents in training order; returns the manifest (shard, path, slots, stride).

    docs are token rows (_id, tokens), or with ``ranks_path`` rows of ids and texts that are encoded on the way. Ids are
    whole numbers, null, or repeated. A task's documents are packed one after another into sequences, of which only its
    last may be padded, with zeros; documents without tokens leave nothing. Sequences are numbered by task and order in
    it, and a keyed permutation of these numbers gives the slots, so each slot from 0 on is used once. Shard k holds slots
    k * shard_slots and on, each at offset (slot - first) * stride: HEAD, then ``sequence`` ids of 2 bytes (4 if the
    vocabulary needs it); beside it, its index of PIECEs in order. Without any sequence there are no shards, only the layout.

    What reaches the driver is a count for each task. Each attempt of a task writes under names of its own, and a shard
    gets its name once it is whole, so a lost or repeated task leaves the same bytes.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids of shards are whole numbers; {id_col} is {dict(docs.dtypes)[id_col]}")
    vocabulary = vocabulary or (vocabulary_of(ranks_path) if ranks_path else 65536)
    wide = _wide(vocabulary)
    stride = HEAD.itemsize + sequence * np.dtype(wide).itemsize
    held = folder.rstrip("/") + "-tokens"
    arrow_rows(spark)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            enc = _encoder(ranks_path) if ranks_path else None
            for b in batches:
                if enc:
                    yield from ((i, enc.encode_to_numpy(t, disallowed_special=())) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                else:
                    yield from ((i, np.frombuffer(raw.as_buffer(), "<u4") if raw.is_valid else np.zeros(0, "<u4")) for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True))

        yield from _pack(documents(), sequence, wide, vocabulary)

    given = docs.select(F.col(id_col).cast("long"), text_of(docs, text_col) if ranks_path else "tokens")
    given.mapInArrow(cut_up, PACKED_KINDS).write.option("compression", "zstd").parquet(held)
    rows = spark.read.schema(PACKED_KINDS).parquet(held)
    counted = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(int(max(counted.column(0).to_numpy(), default=-1)) + 1, np.int64)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    begin, n = np.cumsum(counts) - counts, int(counts.sum())
    shards = -(-n // shard_slots)

    def place(lo: int, hi: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = Feistel(n, key)
            for b in batches:
                slot = order.slots(begin[b.column(0).to_numpy()] + b.column(1).to_numpy())
                own = np.flatnonzero((slot >= lo * shard_slots) & (slot < hi * shard_slots))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(slot[own]), *(c.take(pa.array(own)) for c in b.columns[2:])], names=["slot", "used", "pieces", "body"])

        return run

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(folder)
        attempt = uuid.uuid4().hex
        out, name, shard, written, index, done = None, "", -1, 0, [], []

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{name}.idx.{attempt}", compression=None) as f:
                f.write(b"".join(index))
            fs.move(f"{name}.idx.{attempt}", f"{name}.idx")
            fs.move(f"{name}.bin.{attempt}", f"{name}.bin")
            done.append((shard, f"{name}.bin", written, stride))

        for b in batches:
            head = np.zeros(1, dtype=HEAD)
            for k, used, where_, body in zip((b.column(0).to_numpy() // shard_slots).tolist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != shard:
                    if out:
                        close()
                    shard, written, index, name, pieces = k, 0, [], f"{where}/{k:08d}", 0
                    out = fs.open_output_stream(f"{name}.bin.{attempt}", compression=None)
                head[0] = (used, pieces, len(where_) // PIECE.itemsize, 0)
                pieces += len(where_) // PIECE.itemsize
                index.append(where_)
                out.write(head.tobytes() + body + bytes(stride - HEAD.itemsize - len(body)))
                written += 1
        if out:
            close()
        yield pa.RecordBatch.from_pydict({x: [d[i] for d in done] for i, x in enumerate(SHARDS.names)}, schema=SHARDS)

    manifest = folder.rstrip("/") + "-manifest"
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)
    spark.createDataFrame([], SHARD_KINDS).write.parquet(manifest)
    step = -(-shards // waves)
    for lo in range(0, shards, max(1, step)):
        hi = min(lo + step, shards)
        tasks = min(hi - lo, max(int(spark.conf.get("spark.sql.shuffle.partitions")) // waves, (hi - lo) // 16, 1))
        group = -(-(hi - lo) // tasks)
        # ranges of whole shards: the partition's number is its range's, so each task writes consecutive slots
        placed = rows.mapInArrow(place(lo, hi), "slot long, used int, pieces binary, body binary")
        ranged = placed.repartitionById(-(-(hi - lo) // group), F.floor((F.col("slot") - lo * shard_slots) / (group * shard_slots)).cast("int")).sortWithinPartitions("slot")
        ranged.mapInArrow(write, SHARD_KINDS).write.mode("append").parquet(manifest)
        del placed, ranged
        release(spark)
    with fs.open_output_stream(where + "/layout.json", compression=None) as f:
        f.write(json.dumps({"sequences": n, "sequence": sequence, "stride": stride, "ids": wide, "head": HEAD.itemsize, "shard_slots": shard_slots, "key": key, "rounds": ROUNDS}).encode())
    fs.delete_dir(open_fs(held)[1])
    return spark.read.schema(SHARD_KINDS).parquet(manifest)


def read_sequences(folder: str, slot: int, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slot, pieces, ids) of ``count`` slots from ``slot`` on, reading only their bytes and their shards' indexes: training resumes at any slot."""
    fs, where = open_fs(folder)
    with fs.open_input_file(where + "/layout.json") as f:
        layout = json.loads(f.read())
    at, stop = slot, min(slot + count, layout["sequences"])
    while at < stop:
        shard, off = divmod(at, layout["shard_slots"])
        here = min(stop - at, layout["shard_slots"] - off)
        with fs.open_input_file(f"{where}/{shard:08d}.idx") as f:
            index = np.frombuffer(f.read(), PIECE)
        with fs.open_input_file(f"{where}/{shard:08d}.bin") as f:
            f.seek(off * layout["stride"])
            for k in range(here):
                raw = f.read(layout["stride"])
                head = np.frombuffer(raw[: layout["head"]], dtype=HEAD)[0]
                yield at + k, index[head["first"] : head["first"] + head["pieces"]], np.frombuffer(raw[layout["head"] :], dtype=layout["ids"])[: head["used"]]
        at += here


@lru_cache(maxsize=2)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, width) decimal digits and a comma of each number, which of them are used, and how many."""
    text = [f"{i}," for i in range(n)]
    width = max(map(len, text))
    table = np.frombuffer("".join(x.ljust(width) for x in text).encode(), np.uint8).reshape(n, width)
    return table, table != ord(" "), (table != ord(" ")).sum(axis=1)


def decimal(ids: np.ndarray, vocabulary: int) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, a comma after each, and where each begins, and the end."""
    table, used, length = _digits(1 << max(16, (vocabulary - 1).bit_length()))
    return table[ids][used[ids]].tobytes(), np.concatenate([[0], np.cumsum(length[ids])])


def read_shards(spark: SparkSession, manifest: DataFrame, *, shard_slots: int = SHARD_SLOTS, vocabulary: int = 65536) -> DataFrame:
    """(slot, shard, start, doc_id, token_offset, n_tokens, ids_sha256) of every piece of a document in the shards.

    Start is the piece's place in its sequence, token_offset its place in the document; ids_sha256 is of its ids in
    decimal, joined by commas. A shard is read by one task. doc_id is null where it was.
    """
    import hashlib

    wide = _wide(vocabulary)
    kinds = "slot long, shard long, start int, doc_id long, token_offset long, n_tokens int, ids_sha256 string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, slots, stride in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, where = open_fs(path)
                with fs.open_input_file(where[: -len("bin")] + "idx") as f:
                    index = np.frombuffer(f.read(), PIECE)
                with fs.open_input_file(where) as f:
                    for lo in range(0, slots, 512):
                        n = min(512, slots - lo)
                        raw = np.frombuffer(f.read(n * stride), np.dtype([("head", HEAD), ("ids", wide, (stride - HEAD.itemsize) // np.dtype(wide).itemsize)]))
                        head = raw["head"]
                        own = index[head["first"][0] : head["first"][-1] + head["pieces"][-1]]
                        row = np.repeat(np.arange(n), head["pieces"])
                        last = np.append(row[1:] != row[:-1], True)
                        end = np.where(last, head["used"][row], np.append(own["start"][1:], 0))
                        told = [decimal(ids[:k], vocabulary) for ids, k in zip(raw["ids"], head["used"], strict=True)]
                        sha = [hashlib.sha256(told[r][0][told[r][1][s] : told[r][1][e] - 1]).hexdigest() for r, s, e in zip(row.tolist(), own["start"].tolist(), end.tolist(), strict=True)]
                        m = len(row)
                        yield pa.RecordBatch.from_arrays([pa.array(shard * shard_slots + lo + row), pa.array(np.full(m, shard, np.int64)), pa.array(own["start"]), pa.array(own["doc"], mask=own["null"] != 0), pa.array(own["offset"]), pa.array((end - own["start"]).astype(np.int32)), pa.array(sha, pa.string())], names=[x.split()[0] for x in kinds.split(", ")])

    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).mapInArrow(read, kinds)


def materialise(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every whole text, writes the shards (below the shared folder if none is given) and reads them back; see write_shards and read_shards. A null text has no tokens."""
    manifest = write_shards(df, folder or fresh_path(df.sparkSession, "shards"), ranks_path=ranks_path, id_col=id_col, text_col=text_col)
    return read_shards(df.sparkSession, manifest, vocabulary=vocabulary_of(ranks_path))
