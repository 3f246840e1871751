"""Compressed FM-index of a shard: a level-wise wavelet tree over the Burrows-Wheeler transform, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank over a sequence of symbols: one packed bit vector for each bit of the symbols, high bits first, zeros before ones."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            words, before = packed(bit)
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position; start: where the symbol's leaf begins (see leaves)."""
        at = at.copy()
        for i, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros, strict=True)):
            ones = ones_before(words, before, at)
            at = np.where((symbol >> (self.bits - 1 - i)) & 1, zeros + ones, at - ones)
        return at - start

    def leaves(self, sigma: int) -> np.ndarray:
        """Where each symbol's leaf begins: the image of position 0."""
        return self.rank(np.arange(sigma), np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))


def packed(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector as 64-bit words, and the ones before each word."""
    words = np.zeros((len(bit) >> 6) + 1, np.uint64)
    raw = np.packbits(bit, bitorder="little")
    words.view(np.uint8)[: len(raw)] = raw
    return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)


def ones_before(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    w = at >> 6
    return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FmIndex:
    """FM-index of texts (symbols >= 1, laid end to end with 0 after each) for matching statistics up to `depth` symbols.

    Suffixes are sorted by their first symbols, the least power of two that is not below depth. What is kept: the wavelet tree of the
    transform, common prefixes of neighbours in suffix order (a byte each, cut at depth) with their range minima, and for each interval
    of depth symbols the least owner. The suffix array itself is not kept: intervals are owned, not located.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        if not 1 < depth < 256:
            raise ValueError("depth must be from 2 to 255.")
        n, self.depth = len(text), depth
        sigma = int(text.max(initial=0)) + 1
        rank, span, ranks = text.astype(np.int64), 1, []
        while True:
            ranks.append(np.append(rank, np.full(2 * depth, -1)).astype(np.int32))
            if span >= depth:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - span)] = rank[span:]
            key = rank * (int(ahead.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            span *= 2
        sa = order
        lcp = np.zeros(n + 1, np.int64)  # of the suffixes at i - 1 and i
        for k in range(len(ranks) - 1, -1, -1):
            a, b = sa[:-1] + lcp[1:n], sa[1:] + lcp[1:n]
            lcp[1:n] += (ranks[k][np.minimum(a, n + depth)] == ranks[k][np.minimum(b, n + depth)]) * (1 << k) * ((a < n) & (b < n))
        del ranks
        self.n = n
        self.mins = [np.minimum(lcp, depth).astype(np.uint8)]
        while (1 << len(self.mins)) <= n:
            m, half = self.mins[-1], 1 << (len(self.mins) - 1)
            self.mins.append(np.minimum(m[:-half], m[half:]))
        new = self.mins[0][:n] < depth
        self.classes = packed(new)
        self.least = np.minimum.reduceat(owner[sa], np.flatnonzero(new)) if n else np.zeros(0, np.int64)
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.leaf = self.tree.leaves(sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)

    def widened(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first `size` (1 or more) symbols of the suffixes at `at`."""
        lo, hi = at.copy(), at + 1
        for k in range(len(self.mins) - 1, -1, -1):
            m, step = self.mins[k], 1 << k
            back = np.maximum(lo - step + 1, 0)
            lo = np.where((lo >= step) & (m[back] >= size), lo - step, lo)
            ahead = np.minimum(hi, len(m) - 1)
            hi = np.where((hi + step <= self.n) & (m[ahead] >= size), hi + step, hi)
        return lo, hi

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.leaf[c]
        return self.less[c] + self.tree.rank(c, lo, start), self.less[c] + self.tree.rank(c, hi, start)

    def matches(self, patterns: np.ndarray, size: np.ndarray):
        """Matching statistics of all patterns in step, from their last symbols to their first. patterns: rows of symbols (0: not in
        the index), `size` of them; sizes descend. Yields (rows, start in the pattern, length of the longest match there, cut at depth,
        least owner where the length is depth).

        A match that a symbol cannot extend is cut at its end to its parent interval, as often as needed; one of depth symbols is cut
        to depth - 1 before the next symbol.
        """
        n, depth = self.n, self.depth
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), n, np.int64), np.zeros(len(size), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))  # sizes > t
            rows = np.arange(live)
            c = patterns[rows, size[:live] - 1 - t]
            todo = rows[c > 0]
            gone = rows[c <= 0]
            lo[gone], hi[gone], length[gone] = 0, n, 0
            full = todo[length[todo] >= depth]
            if len(full):
                lo[full], hi[full] = self.widened(lo[full], np.full(len(full), depth - 1))
                length[full] = depth - 1
            while len(todo):
                a, b = self.step(c[todo], lo[todo], hi[todo])
                ok = b > a
                good, bad = todo[ok], todo[~ok]
                lo[good], hi[good] = a[ok], b[ok]
                length[good] += 1
                shorter = np.maximum(self.mins[0][lo[bad]], self.mins[0][hi[bad]]).astype(np.int64)
                whole = (shorter == 0) & (length[bad] > 0)
                some = bad[shorter > 0]
                if len(some):
                    lo[some], hi[some] = self.widened(lo[some], shorter[shorter > 0])
                    length[some] = shorter[shorter > 0]
                out = bad[whole]
                lo[out], hi[out], length[out] = 0, n, 0
                todo = np.concatenate([some, out])
            found = np.full(live, np.iinfo(np.int64).max)
            deep = rows[length[:live] >= depth]
            if len(deep):
                found[deep] = self.least[ones_before(*self.classes, lo[deep] + 1) - 1]
            yield rows, size[:live] - 1 - t, length[:live].copy(), found


def window_minima(buf: np.ndarray, off: np.ndarray, owner: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each text (bytes buf[off[i]:off[i+1]], words between ASCII white space) and each of its windows of `depth` words, the least
    owner of a text in which the window occurs. Rows: texts, columns: window starts; unused cells hold the largest integer.

    group ascends. Of each group, all texts but the one of the latest owner are indexed, and all but that of the earliest are streamed
    through the index: what the latest holds is earlier than nothing, and nothing is earlier than the earliest.
    """
    raw = buf.tobytes()
    words = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    size = np.array([len(w) for w in words], np.int64)
    rows = len(size)
    out = np.full((rows, max(1, int(size.max(initial=0)) - depth + 1)), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1])[None] <= (size - depth)[:, None]] = 0
    out = np.where(out == 0, owner[:, None], out)
    order = np.lexsort((owner, group))
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if rows else np.zeros(0, bool)
    last = np.append(head[1:], True) if rows else head
    indexed, streamed = order[~last], order[~head]
    if not len(indexed) or not len(streamed):
        return out
    names: dict[bytes, int] = {}
    text = np.zeros(int(size[indexed].sum()) + len(indexed), np.int64)
    at = 0
    for i in indexed.tolist():
        text[at : at + size[i]] = [names.setdefault(w, len(names) + 1) for w in words[i]]
        at += int(size[i]) + 1
    index = FmIndex(text, np.repeat(owner[indexed], size[indexed] + 1), depth)
    streamed = streamed[np.argsort(-size[streamed], kind="stable")]
    pad = np.zeros((len(streamed), int(size[streamed].max())), np.int64)
    for r, i in enumerate(streamed.tolist()):
        pad[r, : size[i]] = [names.get(w, 0) for w in words[i]]
    for r, start, length, least in index.matches(pad, size[streamed]):
        hit = length >= depth
        i, s = streamed[r[hit]], start[hit]
        out[i, s] = np.minimum(out[i, s], least[hit])
    return out
