"""An FM-index over a collection of sequences: matching statistics of other sequences by backward search. All by arrays."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank queries on a sequence of integers, kept in about the bits of its zero-order entropy.

    Symbols have prefix-free codes of ceil(log2(total / occurrences)) bits, in canonical order. A node of the tree holds
    the next bit of all values whose code starts with the node's prefix. All nodes' bits are one packed vector with a
    count per 64 bits.
    """

    def __init__(self, values: np.ndarray) -> None:
        occurrences = np.bincount(values)
        there = np.flatnonzero(occurrences)
        sizes = np.maximum(np.ceil(np.log2(len(values) / occurrences[there])), 1).astype(np.int64)
        there, sizes = there[np.argsort(sizes, kind="stable")], np.sort(sizes)
        self.depth = int(sizes.max(initial=1))
        steps = np.left_shift(np.int64(1), self.depth - sizes)
        self.codes, self.sizes = np.zeros(len(occurrences), np.int64), np.zeros(len(occurrences), np.int8)
        self.codes[there], self.sizes[there] = np.cumsum(steps) - steps, sizes
        bits, starts, children, total, nodes = [], [], [], 0, 0
        node = np.zeros(len(values), np.int64)  # of each value that is left, which are in order of their nodes
        many = 1
        for level in range(self.depth):
            bit = (self.codes[values] >> (self.depth - 1 - level)) & 1
            bits.append(bit.astype(np.uint8))
            starts.append(total + np.searchsorted(node, np.arange(many)))
            total, nodes = total + len(values), nodes + many
            left = self.sizes[values] > level + 1
            values, node, bit = values[left], node[left], bit[left]
            key = 2 * node + bit
            counts = np.bincount(key, minlength=2 * many)
            numbers = np.cumsum(counts > 0) - 1
            children.append(np.where(counts > 0, nodes + numbers, 0).reshape(many, 2))
            # a stable sort by key: zeros of a node first
            order = np.empty(len(values), np.int64)
            first = np.cumsum(counts) - counts
            for b in (0, 1):
                some = np.flatnonzero(bit == b)
                own = counts[b::2]
                order[first[key[some]] + np.arange(len(some)) - (np.cumsum(own) - own)[node[some]]] = some
            values, node, many = values[order], numbers[key[order]], int((counts > 0).sum())
        packed = np.packbits(np.concatenate(bits), bitorder="little")
        self.words = np.zeros(total // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)
        self.starts, self.children = np.concatenate(starts).astype(np.int64), np.concatenate(children).astype(np.int32)
        self.ones_before = self._ones(self.starts)

    def _ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block].astype(np.int64) + np.bitwise_count(self.words[block] & below)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol, one that occurs, stands before each place; ``places`` may have a row for each of several places."""
        found, at = places.copy(), places
        lanes, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        codes, sizes = self.codes[symbols], self.sizes[symbols]
        for level in range(self.depth):
            bit = (codes >> (self.depth - 1 - level)) & 1
            ones = self._ones(self.starts[node] + at) - self.ones_before[node]
            at = np.where(bit == 1, ones, at - ones)
            node = self.children[node, bit]
            left = sizes > level + 1
            if not left.all():
                found[..., lanes[~left]] = at[..., ~left]
                lanes, node, codes, sizes, at = lanes[left], node[left], codes[left], sizes[left], at[..., left]
                if not len(lanes):
                    break
        return found


class FMIndex:
    """The index of sequences of symbols from 1 up, each closed by a separator, 0.

    It keeps the wavelet tree of the Burrows-Wheeler transform and the lengths of the common prefixes of neighbouring
    suffixes, which lead from a match to the longest shorter one; texts and suffix array are not kept. Of every
    ``depth`` symbols that occur it has the least of the ``owners`` (a number per sequence).
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, owners: np.ndarray, depth: int) -> None:
        """symbols: the sequences one after another; first: where each starts, and the end of the last."""
        many = len(first) - 1
        ends = first[1:] + np.arange(many)
        inside = np.ones(len(symbols) + many, bool)
        inside[ends] = False
        text = np.zeros(len(inside), np.int64)
        text[inside] = symbols
        distinct = np.where(inside, text + many, 0)
        distinct[ends] = np.arange(many)  # in the order, separators all differ and come before all symbols
        rows, ranks = self._suffix_order(distinct, int(np.diff(first).max(initial=0)) + 1)
        self.size = len(rows)
        self.common = self._common_prefixes(rows, ranks)
        new = self.common[:-1] < depth
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        sequence = np.searchsorted(ends, rows)
        self.least_owner = np.minimum.reduceat(owners[sequence], np.flatnonzero(new))
        self.smaller_before, self.smaller_after = self._neighbours(self.common)
        self.wavelet = WaveletTree(text[rows - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.depth = depth

    @staticmethod
    def _suffix_order(text: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes in order, by prefix doubling, and their ranks by the first 1, 2, 4, ... symbols."""
        n, span, ranks = len(text), 1, [text]
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - span, 0)] = ranks[-1][span:] + 1
            key = ranks[-1] * (int(ranks[-1].max(initial=0)) + 2) + ahead
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
            span *= 2
            if span >= longest:
                return order, ranks
            ranks.append(rank)

    @staticmethod
    def _common_prefixes(rows: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """How many first symbols each suffix has in common with the one before it; -1 before the first and after the last."""
        a, b, many = rows[:-1].copy(), rows[1:].copy(), np.zeros(len(rows) - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = np.where(ranks[k][a] == ranks[k][b], 1 << k, 0)
            a, b, many = a + same, b + same, many + same
        return np.concatenate([[-1], many, [-1]]).astype(np.int32)

    @staticmethod
    def _neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place the last place before and the first after it that has a smaller value."""
        before, after = np.zeros(len(values), np.int32), np.full(len(values), len(values) - 1, np.int32)
        for value in range(int(values.max(initial=0)) + 1):
            at = np.flatnonzero(values == value)
            smaller = np.flatnonzero(values < value)
            to = np.searchsorted(smaller, at)
            before[at], after[at] = smaller[to - 1], smaller[to]
        return before, after

    def step(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows whose suffixes are the symbol followed by a suffix of rows low to high."""
        low, high = self.before[symbols] + self.wavelet.rank(symbols, np.stack([low, high]))
        return low, high

    def shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval of rows with a common prefix, and that prefix's length."""
        left, right = self.common[low], self.common[high]
        length = np.maximum(left, right)
        return np.where(left == length, self.smaller_before[low], low), np.where(right == length, self.smaller_after[high], high), length

    def occurs(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which of the given sequences are somewhere in the index, whole: a backward search that a mismatch ends."""
        found = np.ones(len(first) - 1, bool)
        lanes, low, high = np.arange(len(found)), np.zeros(len(found), np.int64), np.full(len(found), self.size)
        back = 0
        while len(lanes):
            back += 1
            left = first[lanes + 1] - first[lanes] >= back
            lanes, low, high = lanes[left], low[left], high[left]
            symbol = symbols[first[lanes + 1] - back]
            known = symbol > 0
            found[lanes[~known]] = False
            lanes = lanes[known]
            low, high = self.step(low[known], high[known], symbol[known])
            found[lanes[low >= high]] = False
            lanes, low, high = lanes[low < high], low[low < high], high[low < high]
        return found

    def matching_statistics(self, symbols: np.ndarray, first: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the given sequences (symbols that the index lacks are 0) the length of the longest match
        that starts there and the first row of its interval. All sequences are streamed backward at once: a match is
        prolonged by the symbol before it, or shortened until it can be. With ``least`` a sequence is left, and all
        before is 0, where no match that starts further on can have so many symbols."""
        length, row = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        starts, ends = first[:-1], first[1:]
        low, high, matched = np.zeros(len(starts), np.int64), np.full(len(starts), self.size), np.zeros(len(starts), np.int64)
        back = 0
        while len(starts):
            back += 1
            left = (ends - back >= starts) & ((back == 1) | (ends - back + 1 + matched - starts >= least))
            if not left.all():
                starts, ends, low, high, matched = (x[left] for x in (starts, ends, low, high, matched))
            symbol = symbols[ends - back]
            unknown = np.flatnonzero(symbol == 0)
            low[unknown], high[unknown], matched[unknown] = 0, self.size, 0
            open_ = np.flatnonzero(symbol > 0)
            while len(open_):
                a, b = self.step(low[open_], high[open_], symbol[open_])
                found = a < b
                to = open_[found]
                low[to], high[to], matched[to] = a[found], b[found], matched[to] + 1
                open_ = open_[~found]
                low[open_], high[open_], matched[open_] = self.shorter(low[open_], high[open_])
                short = ends[open_] - back + 1 + matched[open_] - starts[open_] < least
                matched[open_[short]] = 0
                open_ = open_[~short]
            length[ends - back], row[ends - back] = matched, low
        return length, row

    def least_owners(self, length: np.ndarray, row: np.ndarray, none: int) -> np.ndarray:
        """For every place the least owner of the first ``depth`` symbols from there, ``none`` where no match is that long."""
        return np.where(length >= self.depth, self.least_owner[self.group[row]], none)
