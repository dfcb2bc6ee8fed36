"""Words of many texts at once, as numpy arrays of code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters handled at a time; arrays of 8 bytes a character stay at some tens of MB.
PIECE_CHARS = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Whether a code point below 0x3100 belongs to a word: ASCII letters and digits, and beyond ASCII what isn't space, punctuation or a sign."""
    t = np.array([chr(i).isalnum() for i in range(0x3100)])
    t[ord("_")] = True
    t[0x300:0x370] = True  # combining marks
    return t


def is_word(codes: np.ndarray) -> np.ndarray:
    return word_table()[np.minimum(codes, 0x30FF)]  # 0x30FF is a letter, as nearly all beyond it are


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, a line feed after each; where each text begins, and the end)."""
    codes = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, min(2 * n, PIECE_CHARS + 100_000))
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, the same wherever the span lies."""
    up, down = powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the lower-cased texts, in order; the first word of each text, and the end)."""
    codes, begin = code_points([t.lower() for t in texts])
    s, e = runs(is_word(codes))
    return span_hashes(codes, s, e), np.searchsorted(s, begin)


@lru_cache(maxsize=1)
def folded_table() -> np.ndarray:
    """Lower case of the code points below 0x3100 that belong to words, 0 for others."""
    low = np.arange(0x3100, dtype=np.uint32)
    low[:0x600] = lower_table()
    return np.where(word_table(), low, np.uint32(0))


def folded(codes: np.ndarray) -> np.ndarray:
    """Lower-cased code points (as normal_form's) of words, 0 elsewhere."""
    table = folded_table()
    if len(codes) and codes.max() < len(table):
        return table[codes]
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)


def shingles_of(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct word shingles of every text, ascending; the first of each text, and the end).

    A shingle is ``width`` consecutive words; a text of fewer words has one, of all its words; one without words has none.
    """
    h, first = words_of(texts)
    n = np.diff(first)
    k = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), k)
    at = np.repeat(first[:-1] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    end = first[1:][doc]
    x = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        x = x * _BASE + np.where(at + j < end, padded[at + j], np.uint64(0))
    x = mix(x)
    order = np.lexsort((x, doc)) if len(x) else np.zeros(0, np.int64)
    x, doc = x[order], doc[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(texts) + 1))


_LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
_LANES = _LANES.sum(axis=1, dtype=np.uint64)


_PAIRS = np.uint64(0x00FF00FF00FF00FF)

#: Weights of a SimHash's features are below this.
WEIGHTS = 16
#: Sums of a byte that 16 bits hold.
RUNS = 257


def simhashes(hashes: np.ndarray, first: np.ndarray, words: int = 2, weight: np.ndarray | None = None) -> np.ndarray:
    """SimHash of each group of hashes, as ``words`` 64-bit numbers: a bit is set if more than half of the group's hashes, by weight, have it set.

    Bits are counted eight to a 64-bit number, a byte each, over runs short enough for a byte; then four to a number, over
    so many runs as 16 bits count; what is left are the few parts of long groups.
    """
    out = np.zeros((len(first) - 1, words), dtype=np.uint64)
    n = np.diff(first)
    if not n.sum():
        return out
    run = 255 if weight is None else 255 // (WEIGHTS - 1)
    k = -(-n // run)
    begin = np.repeat(first[:-1] - run * (np.cumsum(k) - k), k) + run * np.arange(k.sum())
    used = np.flatnonzero(n)
    k = k[used]
    parts = -(-k // RUNS)
    heads = np.repeat(np.cumsum(k) - k - RUNS * (np.cumsum(parts) - parts), parts) + RUNS * np.arange(parts.sum())
    total = n[used] if weight is None else np.add.reduceat(weight, first[:-1][used])
    table = _LANES if weight is None else (_LANES[None, :] * np.arange(WEIGHTS, dtype=np.uint64)[:, None]).ravel()
    row = None if weight is None else weight.astype(np.intp) << 8
    at, lanes = np.empty(len(hashes), np.intp), np.empty(len(hashes), np.uint64)
    count = np.empty((len(heads), 8 * words, 4, 2), np.uint16)
    for w in range(words):
        byte = (mix(hashes + np.array(w, np.uint64) * _BASE) if w else hashes).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            if row is None:
                at[:] = byte[:, b]
            else:
                np.add(row, byte[:, b], out=at)
            part = np.add.reduceat(table.take(at, out=lanes, mode="clip"), begin)
            for odd in range(2):
                count[:, 8 * w + b, :, odd] = np.add.reduceat((part >> np.uint64(8 * odd)) & _PAIRS, heads).view(np.uint16).reshape(-1, 4)
    flat = count.reshape(len(heads), 64 * words)
    if len(heads) > len(used):
        flat = np.add.reduceat(flat, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    out[used] = np.packbits(flat > (total // 2)[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of the code points below 0x600 that it maps to one code point."""
    return np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x600)], dtype=np.uint32)


def normal_form(codes: np.ndarray, keep_lines: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the normal form, where each lies in ``codes``): lower-cased words with one space between them.

    Line feeds end texts, or lines with ``keep_lines``, and stay (with ``keep_lines`` False, all must be such ends); spaces
    beside them may remain.
    """
    table = lower_table()
    low = np.where(codes < 0x600, table[np.minimum(codes, 0x5FF)], codes)
    word = is_word(codes)
    feed = codes == 10
    head = np.concatenate([[False], word[:-1]])
    keep = word | feed | head
    at = np.flatnonzero(keep)
    out = np.where(word, low, np.where(feed, np.uint32(10), np.uint32(32)))[at]
    return out, at
