"""Byte-level BPE by a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, pieces, text_of

#: The byte-level pre-tokenizer's pattern, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters and digits that the regex library knows from Unicode versions newer than that of the tokenizers library, which takes them as other signs.
NEWER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2,
    0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5,
    0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f),
    (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80,
    0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81),
    (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe,
    0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
_NEW = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
#: The pattern for texts that have such signs.
OLD_PATTERN = "(?V1)" + PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", r"[[^\p{White_Space}\p{L}\p{N}]||[@]]").replace(r" ?\p{L}", r" ?[\p{L}--[@]]").replace(r" ?\p{N}", r" ?[\p{N}--[@]]").replace("@", _NEW)
#: Words whose encodings a worker keeps; beyond it the store begins anew.
STORE_WORDS = 500_000
#: Characters encoded at a time.
PIECE_CHARS = 6_000_000


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str, store_words: int = STORE_WORDS):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, chars = j["model"], byte_chars()
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            if all(c in chars for c in token):
                self.bytes[i] = bytes(chars[c] for c in token)
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        #: Ids of the single bytes; the ranked pairs a << 20 | b, their ranks and the ids made of them.
        self.first = np.array([vocab[c] for _, c in sorted((b, c) for c, b in chars.items())], dtype=np.int64)
        ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.rank_keys = np.array(sorted(ranks), dtype=np.int64)
        self.rank_of, self.rank_to = (np.array([ranks[k][i] for k in self.rank_keys.tolist()], dtype=np.int64) for i in (0, 1))
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word, self.old_word, self.newer = regex.compile(PATTERN), regex.compile(OLD_PATTERN), regex.compile(f"[{_NEW}]")
        self.byte_len = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.store_words = store_words
        self.clear()

    def clear(self) -> None:
        """Begins the store of encoded words anew."""
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.flat_ids = np.zeros(1 << 16, dtype=np.int32)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _rank_at(self, keys: np.ndarray) -> np.ndarray:
        """Place of each pair in rank_keys; -1 where it has no rank."""
        i = np.searchsorted(self.rank_keys, keys)
        i[i == len(self.rank_keys)] = 0
        i[self.rank_keys[i] != keys] = -1
        return i

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word).

        All words lie in one chain of tokens with a stop after each. The index maps each pair that has a rank to all
        positions where it occurs; ranks in use are applied in ascending order, each to all its positions at once, and
        the lists of the pairs that a merge makes with its neighbours are extended. A pair's ids were made by lower
        ranks, so no list grows after its turn.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        if not len(ends):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        chain = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        token = self.first[chain]
        token[ends - 1] = -1
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # before the first comes index -1, the last stop
        places: dict[int, list[np.ndarray]] = {}
        active: list[tuple[int, int]] = []

        def note(keys: np.ndarray, at: np.ndarray) -> None:
            k = self._rank_at(keys)
            has = k >= 0
            k, at = k[has], at[has]
            if not len(k):
                return
            order = np.argsort(k, kind="stable")
            k, at = k[order], at[order]
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            for r, p in zip(k[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
                    heapq.heappush(active, (int(self.rank_of[r]), r))

        both = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        note(token[both] << 20 | token[both + 1], both)
        while active:
            _, r = heapq.heappop(active)
            a, b, new = int(self.rank_keys[r]) >> 20, int(self.rank_keys[r]) & 0xFFFFF, int(self.rank_to[r])
            at = places.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[token[at] == a]
            at = at[token[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping places, from the left, every other one
                take, last = [], -1
                for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                    if i != last:
                        take.append(i)
                        last = j
                at = np.array(take)
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            token[at], token[gone], after[at], before[then] = new, -2, then, at
            left, right = before[at], then
            lt, rt = token[left], token[right]
            l, r_ = lt >= 0, rt >= 0
            note(np.concatenate([lt[l] << 20 | new, new << 20 | rt[r_]]), np.concatenate([left[l], at[r_]]))
        alive = token >= 0
        word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        return token[alive].astype(np.int32), np.bincount(word[alive], minlength=len(ends)).astype(np.int64)

    def words(self, text: str) -> list[str]:
        """The text's words in order; a special token's text is a word of its own."""
        word = self.word if text.isascii() or not self.newer.search(text) else self.old_word
        if self.split is None or not any(s in text for s in self.special):
            return word.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += word.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + word.findall(text[at:])

    def learn(self, words: Iterable[str]) -> None:
        """Puts the encodings of new words into the store."""
        new = [w for w in words if w not in self.index]
        special = self.special
        ids, count = self.encode_words(["\n" if w in special else w for w in new])  # a stand-in of one id
        begin = np.cumsum(count) - count
        for k, w in enumerate(new):
            if w in special:
                ids[begin[k]] = special[w]
        had, need = len(self.index), self.used + len(ids)
        while len(self.flat_ids) < need:
            self.flat_ids = np.concatenate([self.flat_ids, np.zeros_like(self.flat_ids)])
        while len(self.count) < had + len(new):
            self.count, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.start))
        self.flat_ids[self.used : need] = ids
        self.count[had : had + len(new)], self.start[had : had + len(new)] = count, begin + self.used
        self.used = need
        self.index.update(zip(new, range(had, had + len(new)), strict=True))
        decimal, at = list(map(str, ids.tolist())), 0
        for c in count.tolist():
            self.texts.append(",".join(decimal[at : at + c]))
            at += c

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Of each text its ids, and the same in decimal, joined by commas."""
        out = []
        for lo, hi in pieces([len(t) for t in texts], PIECE_CHARS):
            if len(self.index) > self.store_words or self.used > 8 * self.store_words:
                self.clear()
            split = [self.words(t) for t in texts[lo:hi]]
            self.learn(set().union(*split))
            index, decimal = self.index, self.texts
            for ws in split:
                at = [index[w] for w in ws]
                k = np.array(at, dtype=np.int64)
                n = self.count[k]
                ends = np.cumsum(n)
                ids = self.flat_ids[np.repeat(self.start[k] - (ends - n), n) + np.arange(ends[-1])] if at else np.zeros(0, np.int32)
                out.append((ids, ",".join([decimal[i] for i in at])))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; ids outside the vocabulary are an error."""
        if not len(ids):
            return b""
        n = self.byte_len[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.byte_at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The worker's tokenizer of this file."""
    return Bpe(path)


def encode_documents(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row: the whole text's ids, as the tokenizers library gives without special tokens added.

    Null texts count as empty and have no ids; the ids of rows may repeat or be null. Special tokens' strings in a text
    are encoded as these. The file is read on each executor.
    """
    arrow_rows(df.sparkSession)
    rows = df.select(df[id_col], text_of(df, text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for b in batches:
            ids = [x for x, _ in model.encode(b.column(1).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def decode_documents(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of rows of ids; null ids give an empty text."""
    arrow_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for b in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")


def token_digests(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every whole text, and gives digests in place of the ids and the text."""
    arrow_rows(df.sparkSession)
    rows = df.select(df[id_col], text_of(df, text_col).alias("_text"))
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            texts = b.column(1).to_pylist()
            for lo, hi in pieces([len(t) for t in texts], PIECE_CHARS):
                for ids, decimal in model.encode(texts[lo:hi]):
                    n.append(len(ids))
                    ids_sha.append(hexed(decimal.encode()))
                    text_sha.append(hexed(model.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
