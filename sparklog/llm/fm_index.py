"""An FM-index over sequences of word numbers: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling, for symbols that end in a 0.

    Zeros are separators, each one different from all others and ordered by place, so comparisons
    end at the next zero, and the rounds are as many as the longest stretch has binary digits.
    """
    separator = symbols == 0
    order = np.argsort(np.where(separator, 0, symbols), kind="stable")
    zeros = int(separator.sum())
    rank = np.empty(len(symbols), np.int64)
    rank[order[:zeros]] = np.arange(zeros)
    open_ = order[zeros:]
    keys = symbols[open_]
    step, slots = 1, np.arange(zeros, len(symbols))
    while True:
        # `open_` is in order of `keys` and fills `slots`; equal keys share their first slot
        fresh = np.empty(len(keys), np.bool_)
        fresh[:1] = True
        fresh[1:] = keys[1:] != keys[:-1]
        rank[open_] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))] if len(keys) else 0
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        order[slots] = open_
        open_, slots = open_[~alone], slots[~alone]
        if not len(open_):
            return order
        keys = (rank[open_] << 32) | rank[open_ + step]
        by = np.argsort(keys, kind="stable")
        keys, open_ = keys[by], open_[by]
        step *= 2


class Ranks:
    """A wavelet matrix: how often a symbol occurs before a row."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for level in range(max(int(top).bit_length(), 1) - 1, -1, -1):
            bits = (symbols >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = len(bits) - int(bits.sum())
            self.levels.append((level, words, before, zeros))
            ones = bits.astype(np.bool_)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def count(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        start = np.zeros_like(row)
        for level, words, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(np.bool_)
            moved = []
            for at in (start, row):
                block = at >> 6
                below = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
                ones = before[block] + np.bitwise_count(below)
                moved.append(np.where(one, zeros + ones, at - ones))
            start, row = moved
        return row - start


class FmIndex:
    """Over symbols 0 (separator, also the last one) to `top`."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        self.last = symbols[order - 1]
        self.begin = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.begin[1:])
        self.ranks = Ranks(self.last, top)
        # positions are kept for each SAMPLE-th place, and where a stretch begins
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.kept = kept
        self.before = np.cumsum(kept) - kept
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the rows low:high of the suffixes that begin with it."""
        symbol = patterns[:, -1]
        low, high = self.begin[symbol], self.begin[symbol + 1]
        alive = np.flatnonzero(low < high)
        for column in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.begin[symbol] + self.ranks.count(symbol, low[alive])
            high[alive] = self.begin[symbol] + self.ranks.count(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, stepping back to the nearest kept one."""
        found, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows, waiting = rows.copy(), np.arange(len(rows))
        while len(waiting):
            done = self.kept[rows[waiting]]
            here = waiting[done]
            found[here] = self.positions[self.before[rows[here]]] + steps[here]
            waiting = waiting[~done]
            symbol = self.last[rows[waiting]]
            rows[waiting] = self.begin[symbol] + self.ranks.count(symbol, rows[waiting])
            steps[waiting] += 1
        return found
