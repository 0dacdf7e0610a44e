"""A compressed FM-index over sequences of integers: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are sorted by their first 16 symbols, so intervals of patterns of up to `DEPTH` symbols are exact. Searches run
backward for many sequences at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 15


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b); equal pairs have equal ranks."""
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(len(key), np.int32)
    new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else []
    return new


class Bits:
    """Packed bits with counts of the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = int(len(bits) - self.before[-1])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """A wavelet matrix: rank of a symbol before a place in a level's bits per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.height = max(1, int(alphabet - 1).bit_length())
        self.levels: list[Bits] = []
        now = symbols
        for level in range(self.height - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            self.levels.append(Bits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = self.walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for i, bits in enumerate(self.levels):
            ones = bits.ones(places)
            places = np.where((symbols >> (self.height - 1 - i)) & 1 == 1, bits.zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.walk(symbols, places) - self.first[symbols]


class FMIndex:
    """An index of sequences of symbols 1..alphabet-1, given end to end with a 0 after each."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        pad = np.zeros(16, np.int32)
        self.n = n
        by = {1: np.concatenate([text.astype(np.int32), pad])}
        for k in (1, 2, 4, 8):
            by[2 * k] = np.concatenate([_ranked(by[k][:n], by[k][k : n + k]), pad])
        suffix = np.argsort(by[16][:n], kind="stable")
        self.row_of = np.empty(n, np.int64)
        self.row_of[suffix] = np.arange(n)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.wavelet = Wavelet(text[suffix - 1], alphabet)
        a, b = suffix[:-1], suffix[1:]
        same = np.zeros(max(n - 1, 0), np.int64)
        for k in (8, 4, 2, 1):
            same += k * (by[k][a + same] == by[k][b + same])
        #: Of each row and the one before it: how many first symbols are the same (15 at most).
        self.common = np.concatenate([[0], same, [0]])
        self._edges: dict[int, np.ndarray] = {}

    def widened(self, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of rows that share their first `depth` symbols with these rows."""
        if depth not in self._edges:
            self._edges[depth] = np.flatnonzero(self.common < depth) if depth else np.array([0, self.n])
        edges = self._edges[depth]
        i = np.searchsorted(edges, rows, "right")
        return edges[i - 1], edges[i]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, given those of pattern."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.counts[symbols] + both[: len(low)], self.counts[symbols] + both[len(low) :]

    def matching_statistics(self, text: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the sequences text[first[i]:first[i + 1]]: how many symbols from there occur in the index, up to
        `most`, and a row of theirs. Symbols that the index doesn't have are -1."""
        if not 0 < most <= DEPTH:
            raise ValueError(f"most is from 1 to {DEPTH}")
        lens = np.diff(first)
        length, row = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        order = np.argsort(-lens, kind="stable")
        low, high, q = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64), np.zeros(len(lens), np.int64)
        for back in range(1, int(lens.max(initial=0)) + 1):
            lanes = order[: np.searchsorted(-lens[order], -back, "right")]
            at = first[lanes + 1] - back
            cut = lanes[q[lanes] == most]
            low[cut], high[cut] = self.widened(low[cut], most - 1)
            q[cut] = most - 1
            c = text[at]
            unknown = c < 0
            low[lanes[unknown]], high[lanes[unknown]], q[lanes[unknown]] = 0, self.n, 0
            todo = lanes[~unknown]
            while len(todo):
                sym = text[first[todo + 1] - back]
                lo, hi = self.step(sym, low[todo], high[todo])
                ok = hi > lo
                done = todo[ok]
                low[done], high[done] = lo[ok], hi[ok]
                q[done] += 1
                todo = todo[~ok]
                todo = todo[q[todo] > 0]
                if len(todo):  # the pattern's longest shorter beginning that has more rows
                    depth = np.minimum(q[todo] - 1, np.maximum(self.common[low[todo]], self.common[high[todo]]))
                    for d in np.unique(depth):
                        some = todo[depth == d]
                        low[some], high[some] = self.widened(low[some], int(d))
                        q[some] = d
            length[at], row[at] = q[lanes], low[lanes]
        return length, row
