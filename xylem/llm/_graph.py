"""Connected components, and pairs of near fingerprints from buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, lookup
from ._words import mix

#: Slots that buckets are hashed to: their counts are what the driver plans tasks by, so at most 2^22 numbers reach it.
SLOTS = (1 << 10, 1 << 22)
#: Rows in a task, and rows of a slot beyond which it is split.
TASK_ROWS, SPLIT_ROWS = 1 << 19, 1 << 20
#: Nodes that a task scatters at a time, and rows of a group that are compared with those of their size at a time.
CHUNK, STEP = 1 << 16, 64
#: Segments of STEP rows that are compared at once (so that their arrays stay near the processor), and offsets for which rows are laid out at a time.
SIDE, OFFSETS = 512, 256
#: Edges that one task joins (some 60 bytes each); more are first contracted across the cluster.
LOCAL_EDGES = 2_000_000


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, comp) of every node of the edges (a, b: long): comp is the same for nodes that are connected, else not.

    Each round every node goes to the neighbour (or itself) of the least hash, with another hash each round, and edges
    follow; an edge whose ends meet is gone. The number of nodes falls by a constant factor on average, so rounds grow as
    the logarithm of the longest chain. Minima are aggregated before they are shuffled, and lookups are salted. Once no
    more than ``local`` edges are left, one task joins the rest (16 bytes an edge).
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = cut(ordered.distinct())
    labels: DataFrame | None = None
    step = 0
    while left.count() > local:
        rank = lambda c, step=step: F.xxhash64(F.col(c), F.lit(f"round {step}"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("b"))).alias("_m"))
        to = cut(best.select("a", F.when(rank("a") < F.col("_m.r"), F.col("a")).otherwise(F.col("_m.b")).alias("to")))
        labels = _follow(labels, to.withColumnRenamed("a", "node"))
        ends = lookup(left, "a", to, "to").select("b", F.col("to").alias("x"))
        ends = lookup(ends, "b", to.withColumnRenamed("a", "b"), "to").select(F.col("x").alias("a"), F.col("to").alias("b"))
        left = cut(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        step += 1
    return _follow(labels, left.coalesce(1).mapInArrow(_join_all, "node long, to long"))


def _follow(labels: DataFrame | None, to: DataFrame) -> DataFrame:
    """Labels (node, comp) after their comps went where ``to`` (node, to) says."""
    if labels is None:
        return cut(to.select("node", F.col("to").alias("comp")))
    moved = lookup(labels, "comp", to.withColumnRenamed("node", "comp"), "to")
    return cut(moved.select("node", F.coalesce("to", "comp").alias("comp")))


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's edges: (node, least node of its component)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    up = least_of_components(len(nodes), a, b)
    for k in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(nodes[up[k : k + 100_000]])], names=["node", "to"])


def least_of_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that the edges (a, b) connect it with: roots are hooked below lesser ones, and paths halved, until no edge joins two."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return up


class Buckets:
    """What puts rows into buckets and groups. ``masks`` (keys, 2): rows whose 128-bit prints agree in all bits of a mask surely share a group."""

    masks: np.ndarray
    #: Pairs that differ in at most so many bits and agree in a mask are found by the finer keys of parts, too.
    sure: int = 128
    #: Whether rows share a group only where they agree in its mask, so that each pair is told once, by its first key.
    once: bool = False

    def of(self, prints: np.ndarray) -> np.ndarray:
        """(n, keys) numbers (uint64) of the buckets of (n, 2) prints."""
        raise NotImplementedError

    def key(self, bucket: np.ndarray) -> np.ndarray:
        """The key of each bucket."""
        raise NotImplementedError

    def groups(self, bucket: np.ndarray, prints: np.ndarray, wholly: bool) -> np.ndarray:
        """A number for each row of buckets held here (all of their rows, if ``wholly``): rows of the same bucket and group are compared."""
        return bucket

    def parts(self, prints: np.ndarray, bucket: int) -> np.ndarray | None:
        """For a large group of a bucket, (n, keys) of a finer search that keeps its guarantee; None where there is none."""
        return None


def near_within(group: np.ndarray, size: np.ndarray, prints: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, Hamming distance) of rows of a group whose (n, 2) prints differ in at most ``most`` bits and whose sizes are in ratio at least.

    Rows are ordered by group and size, so each is compared only with those that follow it up to its size over the ratio.
    SIDE by SIDE segments of STEP rows, those that reach as far together, are compared with the rows an offset further, so
    that a step is a few operations over long arrays. What is set in either half of the difference counts at most as many
    bits as both halves together, so one count tells most pairs apart.
    """
    order = np.lexsort((size, group))
    n = len(order)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    group, size = group[order], size[order].astype(np.int64)
    rank = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
    wide = int(size.max() / ratio) + 2
    ahead = np.searchsorted(rank * wide + size, rank * wide + (size / ratio + 1e-6).astype(np.int64), side="right") - 1 - np.arange(n)
    f, g = (np.concatenate([prints[order, k], np.zeros(STEP + int(ahead.max()), np.uint64)]) for k in range(2))
    starts = np.arange(0, n, STEP)
    reach = np.maximum.reduceat(ahead, starts)
    by = np.argsort(-reach, kind="stable")
    starts, reach = starts[by], reach[by]
    x, y, count, near = (np.empty(SIDE * STEP, t) for t in (np.uint64, np.uint64, np.uint8, np.bool_))
    out = []
    for at, far in ((starts[k : k + SIDE], reach[k : k + SIDE]) for k in range(0, len(starts), SIDE)):
        rows = at[None, :] + np.arange(STEP)[:, None]
        fs, gs = f[rows], g[rows]
        for lo in range(1, int(far[0]) + 1, OFFSETS):
            hi = min(lo + OFFSETS, int(far[0]) + 1)
            rows = at[None, :] + np.arange(lo, hi - 1 + STEP)[:, None]
            ft, gt = f[rows], g[rows]
            found = []
            for o, k in zip(range(lo, hi), np.searchsorted(-far, -np.arange(lo, hi), side="right").tolist(), strict=True):
                m = k * STEP
                np.bitwise_xor(ft[o - lo : o - lo + STEP, :k], fs[:, :k], out=x[:m].reshape(STEP, k))
                np.bitwise_xor(gt[o - lo : o - lo + STEP, :k], gs[:, :k], out=y[:m].reshape(STEP, k))
                np.bitwise_or(x[:m], y[:m], out=x[:m])
                np.less_equal(np.bitwise_count(x[:m], out=count[:m]), most, out=near[:m])
                if len(hit := near[:m].view(np.uint64).nonzero()[0]):  # eight at a time
                    found.append((hit, near[:m].reshape(-1, 8)[hit], np.full(len(hit), k), np.full(len(hit), o)))
            if found:
                hit, held, k, o = (np.concatenate(v) for v in zip(*found, strict=True))
                p, q = np.nonzero(held)
                row, segment = np.divmod(hit[p] * 8 + q, k[p])
                i, o = at[segment] + row, o[p]
                ok = o <= np.where(i < n, ahead[np.minimum(i, n - 1)], 0)
                i, j = i[ok], (i + o)[ok]
                d = np.bitwise_count(f[i] ^ f[j]) + np.bitwise_count(g[i] ^ g[j])
                ok = (d <= most) & (ratio * size[j] <= size[i] + 1e-9)
                out.append((order[i[ok]], order[j[ok]], d[ok]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(v[k] for v in out)]).astype(np.int64) for k in range(3))  # type: ignore[return-value]


def near_across(group: np.ndarray, side: np.ndarray, size: np.ndarray, prints: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as near_within's, of all rows of one side (False) with all rows of the other (True)."""
    i, j, d = [], [], []
    order = np.lexsort((size, side, group))
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else np.zeros(0, int)
    for h, z in zip(heads, np.append(heads[1:], len(order)), strict=True):
        own = order[h:z]
        x, y = own[~side[own]], own[side[own]]
        lo, hi = np.searchsorted(size[y], ratio * size[x] - 1e-9), np.searchsorted(size[y], size[x] / ratio + 1e-9, side="right")
        for s in range(0, len(x), STEP):
            e = min(s + STEP, len(x))
            for t in range(int(lo[s]), int(hi[e - 1]), 1 << 14):
                z_ = y[t : min(t + (1 << 14), int(hi[e - 1]))]
                far = sum(np.bitwise_count(prints[x[s:e], k][:, None] ^ prints[z_, k][None, :]) for k in range(2))
                a, b = np.nonzero(far <= most)
                ok = np.minimum(size[x[s + a]], size[z_[b]]) >= ratio * np.maximum(size[x[s + a]], size[z_[b]]) - 1e-9
                i.append(x[s + a[ok]]), j.append(z_[b[ok]]), d.append(far[a[ok], b[ok]])
    return tuple(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (i, j, d))  # type: ignore[return-value]


def near_pairs(nodes: DataFrame, buckets: Buckets, *, most: int, ratio: float, fine: int = 1 << 15, task_rows: int = TASK_ROWS, split: int = SPLIT_ROWS) -> DataFrame:
    """Distinct (a, b, distance), a < b, of the nodes (node, f0, f1 long, size int) that share a group, differ in at most ``most`` bits and have sizes in ratio.

    All rows of a group are compared, whatever the tasks: buckets are hashed to slots, and the slots' counts (bounded by
    SLOTS, the only thing that reaches the driver) put slots into tasks of about ``task_rows`` rows. Rows of a slot beyond
    ``split`` are dealt into g parts, and each two parts meet in a task of their own, so a hot bucket is spread over the
    cluster. Groups of over ``fine`` rows are searched by the finer keys of ``buckets.parts`` where these lose no pair
    within ``most`` bits, so what is found never depends on how many rows there are. Rows travel packed, many to a
    shuffled row. A pair that an earlier key finds is given there only.
    """
    spark = nodes.sparkSession
    keys = len(buckets.masks)
    total = nodes.count() * keys
    slots = 1 << min(max(int(total // (1 << 14)).bit_length(), SLOTS[0].bit_length() - 1), SLOTS[1].bit_length() - 1)
    where = lambda bucket: (mix(bucket) & np.uint64(slots - 1)).astype(np.int64)
    nodes = nodes.select("node", "size", "f0", "f1")
    prints_of = lambda c: np.stack([c[2].view(np.uint64), c[3].view(np.uint64)], axis=1)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
                held, n = [], 0
        if n:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for c in chunks(batches):
            n += np.bincount(where(buckets.of(prints_of(c))).ravel(), minlength=slots)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["slot", "n"])

    counted = nodes.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(slots, np.int64)
    n[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    least = max(1, min(task_rows, total // max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    deal = np.where(n > split, -(-n // split), 1)
    whole = np.where(deal == 1, n, 0)
    task_of = ((np.cumsum(whole) - whole) // least).astype(np.int32)
    tasks = int(task_of[-1]) + 1
    pairs_of = deal * (deal + 1) // 2 * (deal > 1)
    first = (tasks + np.cumsum(pairs_of) - pairs_of).astype(np.int64)
    split_tasks = {int(first[s]) + i * (2 * int(deal[s]) - i + 1) // 2 + j - i: (int(deal[s]), i, j) for s in np.flatnonzero(deal > 1) for i in range(int(deal[s])) for j in range(i, int(deal[s]))}
    kind = np.dtype([("node", "<i8"), ("f0", "<u8"), ("f1", "<u8"), ("bucket", "<u8"), ("size", "<i4")])
    part_of = lambda node, g: (mix(node.view(np.uint64) ^ np.uint64(0xA5A5A5A5)) % np.uint64(g)).astype(np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            bucket = buckets.of(prints_of(c))
            slot = where(bucket.ravel())
            row = np.repeat(np.arange(len(bucket)), keys)
            one = deal[slot] == 1
            at, task = [np.flatnonzero(one)], [task_of[slot[one]].astype(np.int64)]
            for k in np.flatnonzero(~one):  # of hot slots: to each task of the row's part
                g = int(deal[slot[k]])
                p = int(part_of(c[0][row[k] : row[k] + 1], g)[0])
                at.append(np.full(g, k))
                task.append(np.array([first[slot[k]] + min(p, q) * (2 * g - min(p, q) + 1) // 2 + abs(p - q) for q in range(g)], np.int64))
            at, task = np.concatenate(at), np.concatenate(task)
            order = np.argsort(task, kind="stable")
            at, task = at[order], task[order]
            r = np.empty(len(at), kind)
            r["bucket"] = bucket.ravel()[at]
            for name, values in zip(("node", "size", "f0", "f1"), c, strict=True):
                r[name] = values.view(kind[name])[row[at]]
            heads = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, int)
            held = [r[s:e].tobytes() for s, e in zip(heads, np.append(heads[1:], len(r)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(task[heads].astype(np.int32)), pa.array(held, pa.binary())], names=["task", "held"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_task: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for task, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by_task.setdefault(task, []).append(np.frombuffer(v.as_buffer(), kind))
        for task in sorted(by_task):
            r = np.concatenate(by_task.pop(task))
            r = r[np.argsort(r["bucket"], kind="stable")]
            prints = np.stack([r["f0"], r["f1"]], axis=1)
            group = buckets.groups(r["bucket"], prints, task not in split_tasks)
            if (parts := split_tasks.get(task)) and parts[1] != parts[2]:
                i, j, d = near_across(group, part_of(r["node"], parts[0]) == parts[2], r["size"], prints, most, ratio)
            else:
                i, j, d = _search(buckets, r, group, prints, most, ratio, fine)
            yield from _told(r, i, j, d, prints, buckets)

    def _told(r, i, j, d, prints, buckets) -> Iterator[pa.RecordBatch]:
        x = prints[i] ^ prints[j]
        new = r["node"][i] != r["node"][j]
        key = buckets.key(r["bucket"][i])
        for k in range(keys - 1):
            new &= (x & buckets.masks[k]).any(axis=1) | (key <= k)
        a, b, d = r["node"][i[new]], r["node"][j[new]], d[new].astype(np.int32)
        a, b = np.minimum(a, b), np.maximum(a, b)
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 100_000]) for v in (a, b, d)], names=["a", "b", "distance"])

    scattered = nodes.mapInArrow(scatter, "task int, held binary").repartitionById(tasks + len(split_tasks), "task")
    found = scattered.mapInArrow(pair, "a long, b long, distance int")
    return found if buckets.once else found.dropDuplicates(["a", "b"])


def _search(buckets: Buckets, r: np.ndarray, group: np.ndarray, prints: np.ndarray, most: int, ratio: float, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs within groups; those of large groups by finer keys, if these lose none within ``most`` bits."""
    order = np.argsort(group, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else np.zeros(0, int)
    length = np.diff(np.append(heads, len(order)))
    out, rest = [], np.ones(len(r), bool)
    large = (length > fine) & (most <= buckets.sure)
    for h, m in zip(heads[large], length[large], strict=True):
        own = order[h : h + m]
        if (parts := buckets.parts(prints[own], int(r["bucket"][own[0]]))) is None:
            continue
        rest[own] = False
        found = [near_within(parts[:, k], r["size"][own], prints[own], most, ratio) for k in range(parts.shape[1])]
        i, j, d = (np.concatenate([f[k] for f in found]) for k in range(3))
        _, once = np.unique(np.minimum(i, j) * len(own) + np.maximum(i, j), return_index=True)
        out.append((own[i[once]], own[j[once]], d[once]))
    own = np.flatnonzero(rest)
    i, j, d = near_within(group[own], r["size"][own], prints[own], most, ratio)
    out.append((own[i], own[j], d))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))  # type: ignore[return-value]


def linked(pairs: DataFrame, verify, best: int = 2) -> DataFrame:
    """Components (node, comp) of the pairs (a, b, distance; cut before) that ``verify`` (pairs -> those that hold) confirms.

    First each node's closest pairs, one of each of ``best`` hash classes of partners, are verified; then all pairs whose
    ends aren't connected so far. A pair within a component would change nothing, so a group of n copies costs about n
    verifications, while every pair that could join two components is verified.
    """
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "distance"))
    hashed = F.xxhash64("y")
    near = F.col("distance").cast("long") * F.lit(1 << 48) + F.shiftrightunsigned(hashed, 16)  # ties fall by the hash
    closest = ends.groupBy("x", F.pmod(hashed, F.lit(best)).alias("_p")).agg(F.min_by("y", near).alias("y"))
    first = cut(closest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    good = cut(verify(first).select("a", "b"))
    comp = components(good)
    of = lambda end: comp.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
    told = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = told.filter("coalesce(_a, a) <> coalesce(_b, b) or (_a is null) <> (_b is null)").select("a", "b")
    more = cut(verify(rest.join(first, ["a", "b"], "left_anti")).select("a", "b"))
    if more.isEmpty():
        return comp
    return components(good.unionByName(more))
