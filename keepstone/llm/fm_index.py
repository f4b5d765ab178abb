"""FM-index over integer sequences: a wavelet matrix of the Burrows-Wheeler transform, searched for many streams at once."""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits with rank in constant time: 64-bit words and a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """One bit string for each bit of a symbol, most significant first; zeros go before ones at each level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[RankBits, int]] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            ones = (now >> level) & 1
            self.levels.append((RankBits(ones.astype(np.uint8)), int(len(now) - ones.sum())))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        self.base = self._follow(np.arange(size), np.zeros(size, np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i symbols."""
        return self._follow(symbol, i) - self.base[symbol]


class FmIndex:
    """Index of sequences for runs of up to ``depth`` symbols, read from left to right.

    The sequences are stored reversed, so one backward-search step appends a symbol on the right of a run; cutting an
    interval to a shorter common prefix drops symbols on the left. Suffixes are sorted by prefix doubling to a power of
    two beyond ``depth``, which orders all runs that can be asked for. ``owner`` gives each sequence a number; a full
    run reports the least owner among its occurrences.
    """

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.asarray([len(s) + 1 for s in sequences], np.int64)
        stop = np.zeros(1, np.uint64)
        flat = np.concatenate([np.concatenate([s[::-1].astype(np.uint64), stop]) for s in sequences])
        stops = np.cumsum(sizes) - 1
        inner = np.ones(len(flat), bool)
        inner[stops] = False
        self.alphabet, codes = np.unique(flat[inner], return_inverse=True)
        text = np.zeros(len(flat), np.int64)
        text[inner] = codes + 1
        n = len(text)
        ranks = [text]
        step = 1
        while step <= depth:
            now = ranks[-1]
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = now[step:] + 1 if n > step else 0
            key = now * (n + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            ranks.append(fresh)
            step *= 2
        suffix = order
        # Common prefix of neighbours, up to depth, from the ranks of all doublings.
        a, b, common = suffix[:-1].copy(), suffix[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            ok = (a < n) & (b < n)
            same = ok.copy()
            same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
            same &= np.maximum(a, b) + (1 << k) <= n
            common += same << k
            a, b = a + (same << k), b + (same << k)
        self.lcp = np.concatenate([[-1], np.minimum(common, depth), [-1]])
        self._parents()
        self.wavelet = WaveletMatrix(text[suffix - 1], len(self.alphabet) + 1)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.first = np.cumsum(counts) - counts
        starts = np.flatnonzero(self.lcp[:-1] < depth)
        self.group = np.cumsum(self.lcp[:-1] < depth) - 1  # suffixes that share their first ``depth`` symbols
        self.group_start = np.append(starts, n)
        owners = np.repeat(np.asarray(owner, np.int64), sizes)[suffix]
        self.group_owner = np.minimum.reduceat(owners, starts)
        self.size = n

    def _parents(self) -> None:
        """For each boundary: the nearest ones before and behind whose common prefix is shorter."""
        n = len(self.lcp)
        self.before, self.behind = np.zeros(n, np.int64), np.full(n, n - 1, np.int64)
        at = np.arange(n)
        for value in np.unique(self.lcp[1:-1]):
            here = self.lcp == value
            lower = self.lcp < value
            self.before[here] = np.maximum.accumulate(np.where(lower, at, 0))[here]
            self.behind[here] = np.minimum.accumulate(np.where(lower, at, n - 1)[::-1])[::-1][here]

    def stream(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of many sequences in step.

        Returns, for every position of the concatenated sequences, the length of the longest run that ends there and
        occurs in the index (at most depth), the least owner of full runs (-1 elsewhere), and the first position of
        each sequence.
        """
        sizes = np.asarray([len(s) for s in sequences], np.int64)
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        length_out, owner_out = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        if not total or not len(self.alphabet):
            return length_out, owner_out, at
        flat = np.concatenate([s.astype(np.uint64) for s in sequences])
        code = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[code] == flat, code + 1, 0)
        lanes = np.argsort(-sizes, kind="stable")
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.size, np.int64)
        run = np.zeros(len(lanes), np.int64)
        for t in range(int(sizes.max())):
            live = int(np.searchsorted(-sizes[lanes], -t))  # lanes whose sequence is longer than t
            where = at[lanes[:live]] + t
            symbol = symbols[where]
            todo = np.arange(live)
            unknown = symbol == 0
            lo[:live][unknown], hi[:live][unknown], run[:live][unknown] = 0, self.size, 0
            todo = todo[~unknown]
            while len(todo):
                c = symbol[todo]
                ranks = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                new_lo, new_hi = self.first[c] + ranks[: len(c)], self.first[c] + ranks[len(c) :]
                hit = new_hi > new_lo
                done = todo[hit]
                lo[done], hi[done], run[done] = new_lo[hit], new_hi[hit], run[done] + 1
                todo = todo[~hit]
                if len(todo):  # drop symbols on the left until the run occurs with another symbol behind it
                    wider = np.where(self.lcp[lo[todo]] >= self.lcp[hi[todo]], lo[todo], hi[todo])
                    run[todo] = np.maximum(self.lcp[wider], 0)
                    lo[todo], hi[todo] = self.before[wider], self.behind[wider]
            full = np.flatnonzero(run[:live] >= self.depth)
            group = self.group[lo[full]]
            lo[full], hi[full], run[full] = self.group_start[group], self.group_start[group + 1], self.depth
            length_out[where] = run[:live]
            owner_out[where[full]] = self.group_owner[group]
        return length_out, owner_out, at
