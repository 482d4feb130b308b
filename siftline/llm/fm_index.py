"""An FM-index over word numbers, as numpy arrays: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks of symbols in prefixes of a sequence, by one bit of the symbols per level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        first, last = np.zeros_like(ends), ends
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbols >> level) & 1
            ones, zeros = self.ones[k], self.zeros[k]
            first = np.where(bit, zeros + ones[first], first - ones[first])
            last = np.where(bit, zeros + ones[last], last - ones[last])
        return last - first

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out = np.zeros_like(places)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[places + 1] - ones[places]
            out = 2 * out + bit
            places = np.where(bit, zeros + ones[places], places - ones[places])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``; its zeros are separators, each smaller than any later one and than all words."""
    n = len(text)
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum()).astype(np.int64)
    reach = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (2 * n + int(text.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        reach *= 2


class FmIndex:
    """Backward search and location of word phrases in ``text`` (word numbers from 1; 0 separates and ends it).

    Suffix positions are kept for every ``sample``-th word of a run between separators, its first word
    included, so that stepping back from an occurrence meets one before it leaves its run.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        order = suffix_array(text)
        self.wavelet = Wavelet(text[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        gap = np.concatenate([[-1], np.flatnonzero(text == 0)])
        in_run = np.arange(len(text)) - gap[np.searchsorted(gap, np.arange(len(text)), side="left") - 1] - 1
        sampled = (in_run % sample == 0)[order]
        self.known = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each phrase; row ``i`` holds ``lengths[i]`` words at its right end."""
        width = phrases.shape[1]
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.before[-1], np.int64)
        for step in range(width):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            word = phrases[live, width - 1 - step]
            low[live] = self.before[word] + self.wavelet.rank(word, low[live])
            high[live] = self.before[word] + self.wavelet.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the nearest kept position."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            kept = self.known[at + 1] > self.known[at]
            out[live[kept]] = self.positions[self.known[at[kept]]] + steps
            live, at = live[~kept], at[~kept]
            word = self.wavelet.access(at)
            at = self.before[word] + self.wavelet.rank(word, at)
            steps += 1
        return out
