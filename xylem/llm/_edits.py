"""Edit distances of many pairs of strings at once, by bit-parallel columns."""

from __future__ import annotations

import numpy as np

#: 64-bit words of a column that are handled at a time, so that they stay near the processor, and numbers in a table of characters.
WORDS, TABLE = 1 << 13, 1 << 21
#: Columns after which pairs that can't hold any more are looked for.
LOOK = 64
#: Pairs of like length up to which each is compared on its own.
FEW = 12
_ONE, _TOP = np.uint64(1), np.uint64(63)


def distances_within(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its number.

    What pairs have in common at their beginning and end is cut off; if replacing words where the rest differs takes few
    enough edits the pair holds. The distances of the others are computed: of many pairs of like length by columns of
    all at once, of few by columns as one long number.
    """
    n = len(x)
    ok = np.zeros(n, bool)
    hard = []
    for i, (a, b, k) in enumerate(zip(x, y, most.tolist(), strict=True)):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > k:
            continue
        a, b = _middle(a, b)
        if len(b) <= k or by_words(a, b, k) <= k:
            ok[i] = True
        elif a:
            hard.append((-(-len(a) // 64), k, i, a, b))
    hard.sort()
    at = 0
    while at < len(hard):
        some = hard[at : at + max(1, WORDS // min(hard[at][0], hard[at][1] // 64 + 2))]
        some = [h for h in some if h[0] <= hard[at][0] * 5 // 4]
        at += len(some)
        own = [h[2] for h in some]
        if len(some) > FEW:
            far = _distances([h[3] for h in some], [h[4] for h in some], most[own])
        else:
            far = np.array([distance(h[3], h[4]) for h in some])
        ok[own] = far <= most[own]
    return ok


def by_words(a: str, b: str, most: int, ahead: int = 3) -> int:
    """Edits that turn a into b word by word, by looking a few words ahead for the next that both have: no fewer than their distance. Above most, any such number."""
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and (total := sum([max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v])) <= most:
        return total
    i = j = total = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = 1, 1
        for step in range(1, ahead + 1):  # the nearest meeting: as many words of both replaced, or some of one taken out or put in
            u, v = x[i + step] if i + step < len(x) else None, y[j + step] if j + step < len(y) else None
            if u is not None and u == v:
                p, q = step, step
            elif u == y[j]:
                p, q = step, 0
            elif v == x[i]:
                p, q = 0, step
            else:
                continue
            break
        total += sum(max(len(u), len(v)) for u, v in zip(x[i : i + p], y[j : j + q], strict=False)) if p == q else sum(len(w) + 1 for w in (x[i : i + p] or y[j : j + q]))
        if total > most:
            return total
        i, j = i + p, j + q
    return total + sum(len(w) + 1 for w in x[i:] + y[j:])


def distance(a: str, b: str) -> int:
    """Edit distance by Myers' columns, each one number of as many bits as a has characters."""
    m = len(a)
    if not m:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    all_, top = (1 << m) - 1, 1 << (m - 1)
    p, q, score = all_, 0, m
    for c in b:
        eq = peq.get(c, 0)
        h = (((eq & p) + p) ^ p) | eq
        v = eq | q
        ph, mh = q | (all_ & ~(h | p)), p & h
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | 1) & all_, (mh << 1) & all_
        p, q = mh | (all_ & ~(v | ph)), ph & v
    return score


def _middle(a: str, b: str) -> tuple[str, str]:
    """Two strings without their common beginning and end."""
    lo, hi = 0, len(a)
    if a[:hi] != b[:hi]:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid
        if a[lo : lo + 1] == b[lo : lo + 1]:
            lo += 1
    else:
        lo = hi
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:  # the longest common end
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    return a[: len(a) - lo], b[: len(b) - lo]


def _distances(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs (x no longer than y, by at most ``most``); above most, any number above it.

    Myers' columns of vertical differences, a number of 64 rows for each word of the longest x. At each step all pairs go
    a column on, and each word is a column behind the one above it, so what that one carries down is there. Only words
    that a path of at most ``most`` edits may cross are computed: one that comes in begins as if each of its rows were an
    edit more than the row above it, and above the first, rows grow by an edit a column. Both are what some path costs, so
    no distance is too small, and those of paths within are exact. Rows of x end with a word; those before its first
    character have no differences. Pairs that are over, or whose every cell so far is beyond ``most``, are left out.
    """
    n = len(x)
    m, length = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    words = -(-int(m.max()) // 64)
    codes = lambda v: np.frombuffer("".join(v).encode("utf-32-le", "surrogatepass"), np.uint32)
    cx, cy = codes(x), codes(y)
    table = np.zeros(int(max(cx.max(), cy.max())) + 1, np.int64)
    table[cx], table[cy] = 1, 1
    kinds = int(table.sum())
    if n > 1 and n * kinds * words > 4 * TABLE:  # many kinds of characters: fewer pairs at a time
        k = n // 2
        return np.concatenate([_distances(x[:k], y[:k], most[:k]), _distances(x[k:], y[k:], most[k:])])
    table = np.cumsum(table) - 1
    last = (m - 1) // 64
    pad = 64 * (last + 1) - m
    row = np.repeat(np.arange(n), m)
    at = np.arange(len(cx)) - np.repeat(np.cumsum(m) - m - pad, m)
    peq = np.zeros(words * n * kinds, np.uint64)
    np.bitwise_or.at(peq, (at // 64) * (n * kinds) + row * kinds + table[cx], _ONE << (at % 64).astype(np.uint64))
    width = int(length.max())
    text = np.zeros((width, n), np.int64)
    text[np.arange(len(cy)) - np.repeat(np.cumsum(length) - length, length), np.repeat(np.arange(n), length)] = table[cy]
    text += np.arange(n) * kinds
    begin = (np.arange(words) * (n * kinds))[:, None]
    p, q = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    p[0] <<= pad.astype(np.uint64)
    up, down = np.zeros((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)  # out of the word before, a step ago
    score = np.zeros((words, n), np.uint64)  # of each word's last row
    turn = (most - (length - m)) // 2  # edits that a path may stray from its diagonals, and come back
    below, above = int((turn + pad).max()), int((length - m + turn - pad).max())
    end = length - 1 + last
    steps = set(end.tolist())
    out, own = most + 1, np.arange(n)
    lo = hi = 0
    for t in range(width + words - 1):
        was, had = lo, hi
        lo, hi = max(0, t - width + 1, -((63 + above - t) // 65)), min(words, t + 1, (t + below + 63) // 65 + 1)
        if lo >= hi:
            break
        if lo == was:
            up[lo], down[lo] = _ONE, 0
        if hi > had:
            w = hi - 1
            score[w] = score[w - 1] + np.uint64(64) - up[w] + down[w] if w else 64 - pad
        eq = peq.take(text[t - hi + 1 : t - lo + 1][::-1] + begin[lo:hi])
        pv, over, under = p[lo:hi], up[lo:hi], down[lo:hi]
        v = eq | q[lo:hi]
        eq |= under
        h = eq & pv
        h += pv
        h ^= pv
        h |= eq
        ph = h | pv
        np.invert(ph, out=ph)
        ph |= q[lo:hi]
        h &= pv  # where the row's differences are negative
        nup, ndown = ph >> _TOP, h >> _TOP
        score[lo:hi] += nup
        score[lo:hi] -= ndown
        ph <<= _ONE
        ph |= over
        h <<= _ONE
        h |= under
        np.bitwise_and(ph, v, out=q[lo:hi])
        v |= ph
        np.invert(v, out=v)
        np.bitwise_or(v, h, out=p[lo:hi])
        up[lo + 1 : hi + 1], down[lo + 1 : hi + 1] = nup, ndown
        if t in steps:
            over_ = np.flatnonzero(end == t)
            out[own[over_]] = score[last[over_], over_]
        if t % LOOK == LOOK - 1 and hi <= t:  # a path's next cell follows one of these, or one beside the last row of a word
            least = (score[lo:hi] - np.bitwise_count(p[lo:hi])).min(axis=0).view(np.int64) - 1
            held = np.flatnonzero((end > t) & (least <= most))
            if 4 * len(held) <= 3 * len(own):
                if not len(held):
                    break
                own, most, last, end, pad, text = own[held], most[held], last[held], end[held], pad[held], text.take(held, axis=1)
                p, q, up, down, score = (v.take(held, axis=1) for v in (p, q, up, down, score))
    return out
