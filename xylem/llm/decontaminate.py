"""Benchmark decontamination by the q-gram lemma: count shared q-grams in overlapping diagonal bands, verify by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, pieces, text_of
from ._words import code_points, normal_form

Q = 10
#: Edits allowed, as a share of the passage's characters.
EDITS = 0.06
#: Characters of passages in one index; a larger benchmark is searched in blocks of about so many, each over all documents.
BLOCK_CHARS = 2_000_000
PIECE_CHARS = 1_000_000
MATCHES = "item_id {item}, n_places long, start long, end long, edits long"
_B = np.uint64(0x9E3779B97F4A7C15)


def normal_text(text: str) -> np.ndarray:
    """Codes of the text's words, lower-cased, with single spaces between."""
    codes, _ = code_points([text.replace("\n", " ")])
    out, _ = normal_form(codes)
    s = out.tobytes().decode("utf-32-le", "surrogatepass").strip()
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q consecutive codes; halves are combined, so it takes about log q steps."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    h, width, out, got, base = codes.astype(np.uint64) + np.uint64(1), 1, None, 0, int(_B)
    while True:
        if q & width:
            if out is None:
                out, got = h, width
            else:
                n = len(codes) - got - width + 1
                out = h[:n] * np.uint64(pow(base, got, 1 << 64)) + out[width : width + n]
                got += width
        if got == q:
            return out * np.uint64(0xD6E8FEB86659FD93)
        n = len(h) - width
        h = h[:n] * np.uint64(pow(base, width, 1 << 64)) + h[width : width + n]
        width *= 2


@dataclass
class PassageIndex:
    """q-grams of normalised passages, and for each passage its edit budget and the q-grams that a match must share."""

    ids: list
    texts: list[np.ndarray]
    q: int
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray  # distinct, ascending
    first: np.ndarray  # of each gram its first posting, and the end
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # by the upper 22 bits of a hash

    @classmethod
    def build(cls, items: list[tuple[object, str]], q: int = Q, edits: float = EDITS) -> PassageIndex:
        """A passage of m characters with at most k edits shares m - q + 1 - k q of its q-grams at least (the q-gram lemma). Its budget is the share of m asked for, or the largest that leaves one q-gram to share."""
        ids, texts = [], []
        for i, t in items:
            n = normal_text(t or "")
            if len(n):
                ids.append(i)
                texts.append(n)
        m = np.array([len(t) for t in texts], dtype=np.int64)
        budget = np.maximum(0, np.minimum(np.floor(edits * m + 1e-9).astype(np.int64), (m - q) // q)) if len(m) else m
        need = np.maximum(1, m - q + 1 - budget * q)
        h = [gram_hashes(t, q) for t in texts]
        item = np.repeat(np.arange(len(texts)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[(grams >> np.uint64(42)).astype(np.int64)] = True
        return cls(ids, texts, q, budget, need, grams, np.append(first, len(flat)), item[order], place[order].astype(np.int64), maybe)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """Of each text its matches, (passage, number of places, and of the place with the fewest edits: start, end, edits)."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        codes, begin = code_points([t.replace("\n", " ").replace("\r", " ") for t in texts])
        norm, at = normal_form(codes)
        stops = np.searchsorted(at, begin)  # of each text its first code in norm, and the end
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

        for p, lo, hi in self._regions(norm):
            d = int(np.searchsorted(stops, (lo + hi) // 2, side="right")) - 1
            for d in {d, *np.searchsorted(stops, [max(lo, 0), hi], side="right").tolist()}:
                if not 0 <= d < len(texts):
                    continue
                a, z = max(lo, int(stops[d])), min(hi, int(stops[d + 1]) - 1)
                if z - a < len(self.texts[p]) - int(self.budget[p]):
                    continue
                if (hit := banded(self.texts[p], norm[a:z], int(self.budget[p]))) is not None:
                    found.setdefault((d, p), []).append((a + hit[0], a + hit[1], hit[2]))
        for k, t in enumerate(self.texts):
            if len(t) < self.q:  # too short for a q-gram: whole words, as they are
                whole = norm.tobytes().decode("utf-32-le", "surrogatepass").replace("\n", " ")
                needle, i = " " + t.tobytes().decode("utf-32-le", "surrogatepass") + " ", -1
                padded = " " + whole
                while (i := padded.find(needle, i + 1)) >= 0:
                    d = int(np.searchsorted(stops, i, side="right")) - 1
                    if i + len(t) <= stops[d + 1]:
                        found.setdefault((d, k), []).append((i, i + len(t), 0))
        for (d, p), hits in found.items():
            places: list[tuple[int, int, int]] = []
            for h in sorted(set(hits), key=lambda h: (h[2], h[0], h[1])):
                if all(h[1] <= x[0] or h[0] >= x[1] for x in places):
                    places.append(h)
            s, e, k = places[0]
            base = int(begin[d])
            out[d].append((p, len(places), int(at[s]) - base, int(at[e - 1]) + 1 - base, k))
        return [sorted(x) for x in out]

    def _regions(self, norm: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, from, to) of bands that share enough q-grams.

        A hit at text place t and passage place p lies on diagonal t - p. A match with at most k edits stays within k + 1
        neighbouring diagonals, so bands of 2 (k + 1) diagonals that begin every k + 1 have one that holds it whole.
        """
        h = gram_hashes(norm, self.q)
        t = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)]) if len(h) and len(self.grams) else np.zeros(0, np.int64)
        if not len(t):
            return []
        g = np.searchsorted(self.grams, h[t])
        g[g == len(self.grams)] = 0
        ok = self.grams[g] == h[t]
        t, g = t[ok], g[ok]
        n = self.first[g + 1] - self.first[g]
        posting = np.repeat(self.first[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.item[posting]
        width = self.budget[item] + 1
        band = (np.repeat(t, n) - self.place[posting] + len(norm)) // width
        key = np.concatenate([item << 40 | band, item << 40 | band - 1])
        keys, count = np.unique(key, return_counts=True)
        enough = count >= self.need[keys >> 40]
        out = []
        for k in keys[enough].tolist():
            p, b = k >> 40, k & (1 << 40) - 1
            w = int(self.budget[p]) + 1
            low = b * w - len(norm)
            out.append((p, low - w, low + 2 * w + len(self.texts[p]) + w))
        return out


def banded(pattern: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the pattern's best place in the region, if it takes at most ``most`` edits.

    Edit distance with free ends in the region, in a band: only cells whose diagonals the region allows. Of equal places the first.
    """
    m, n = len(pattern), len(region)
    raw, needle, i = region.tobytes(), pattern.tobytes(), -1
    while (i := raw.find(needle, i + 1)) >= 0:
        if i % 4 == 0:
            return i // 4, i // 4 + m, 0
    if most <= 0:
        return None
    # row i holds columns i - most .. i + n - m + most, at offsets 0 .. w
    w = n - m + 2 * most + 1
    if w <= 0:
        return None
    far = 1 << 20
    offs = np.arange(w)
    col = offs - most
    cost = np.where((col >= 0) & (col <= n), 0, far)
    start = np.clip(col, 0, n)
    padded = np.concatenate([np.full(most + 1, 0xFFFFFFFF, dtype=np.uint32), region, np.full(w + most + 1, 0xFFFFFFFF, dtype=np.uint32)])
    for i in range(1, m + 1):
        c = padded[i - 1 - most + most + 1 : i - 1 - most + most + 1 + w]  # region[col - 1] of this row's columns
        diag = cost + (c != pattern[i - 1])
        up = np.append(cost[1:], far) + 1
        take_up = up < diag
        best = np.where(take_up, up, diag)
        origin = np.where(take_up, np.append(start[1:], 0), start)
        run = best - offs
        low = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == low, offs, 0))
        cost, start = low + offs, origin[source]
        col = offs - most + i
        cost = np.where((col >= 0) & (col <= n), cost, far)
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(start[k]), int(k - most + m), int(cost[k])) if cost[k] <= most else None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's passages in blocks of about ``block_chars`` characters, one at a time on the driver."""
    items = benchmark.select(benchmark[item_col].alias("i"), text_of(benchmark, text_col).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, item_col, n_places, start, end, edits): a row for each passage that a document holds whole, with at most ``edits`` of its characters changed.

    Texts and passages are compared as lower-cased words with single spaces. start and end are the span of the place with
    the fewest edits (of equal ones the first), in code points of the document's own text. Null texts count as empty and
    empty passages match nothing; passages shorter than q characters match as whole words, unchanged. Ids of either side
    may repeat or be null; each row is looked at for itself. No document moves: passages travel to the documents, in
    blocks of a bounded size.
    """
    arrow_rows(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, n_places long, start long, end long, edits long"
    rows = docs.select(docs[id_col], text_of(docs, text_col).alias("_text"))
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        index = PassageIndex.build(block, q, edits)
        sent = docs.sparkSession.sparkContext.broadcast(index)  # of bounded size: some 60 bytes a character of the block

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                texts, ids = b.column(1).to_pylist(), b.column(0)
                hits, at = [], []
                for lo, hi in pieces([len(t) for t in texts], PIECE_CHARS):
                    for k, found in enumerate(index.search(texts[lo:hi]), lo):
                        hits += [(index.ids[p], *rest) for p, *rest in found]
                        at += [k] * len(found)
                columns = [list(c) for c in zip(*hits, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(columns[0], item_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[id_col, item_col, "n_places", "start", "end", "edits"])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
