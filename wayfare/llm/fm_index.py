"""A compressed full-text index over word numbers: suffix order, transform, wavelet tree, backward search in batches.

The index holds a set of word sequences. Its transform is kept in a wavelet tree, stored level by level: one packed
bit per word and level, with the count of one bits before every 64 of them. A rank is a few array operations a
level, so a backward step is taken for thousands of streamed sequences at a time.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

WORD = 64


def flat_positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, position in it) of every entry of sequences laid end to end."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit plane per level, highest bit first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        rest = symbols
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((rest >> shift) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(-len(bits) % WORD + WORD, np.uint8)), bitorder="little").view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int64))
            self.levels.append((shift, packed, before, len(bits) - int(bits.sum())))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        # After the last level equal symbols lie together: where each symbol's part starts.
        self.starts = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, before, zeros in self.levels:
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbols[k] stands before place at[k], for all k."""
        return self._descend(symbols, at) - self.starts[symbols]

    @cached_property
    def n_bytes(self) -> int:
        return sum(packed.nbytes + before.nbytes for _, packed, before, _ in self.levels)


def _suffix_order(text: np.ndarray, n_ends: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, number of the suffix's class by its first `depth` symbols, for each row of it).

    `text` holds different numbers below n_ends as ends of sequences, so no two suffixes are equal. Suffixes are
    sorted by one, two, four, ... symbols until all differ; only those that are not settled are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    at_depth, span, rank = None, 1, np.empty(n, np.int64)
    new = np.append(True, text[order][1:] != text[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        if at_depth is None and 2 * span > depth:
            # Classes by `depth` symbols: two overlapping spans.
            second = np.minimum(np.arange(n) + max(depth - span, 0), n - 1)
            at_depth = (rank.copy(), rank[second])
        first = rank[order]
        size = np.bincount(rank, minlength=n)[first]
        open_rows = np.flatnonzero(size > 1)
        if not len(open_rows):
            break
        suffixes = order[open_rows]
        key = first[open_rows] * n + rank[np.minimum(suffixes + span, n - 1)]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[open_rows] = suffixes
        new = np.append(True, key[1:] != key[:-1])
        rank[suffixes] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        span *= 2
    if at_depth is None:  # settled before `depth` symbols were looked at: every suffix is its own class
        return order, np.arange(n)
    first, second = at_depth[0][order], at_depth[1][order]
    return order, np.cumsum(np.append(False, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))


class FmIndex:
    """Index of word sequences, each with a number (`owner`); finds stretches of `length` words in streamed sequences.

    `words` are the sequences end to end (unsigned 64-bit names of words), `lengths` their lengths. An interval of
    rows stands for all places of one stretch; `least_owner` gives the smallest owner among them. There is one sequence at least.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, length: int) -> None:
        self.length = length
        self.names, numbers = np.unique(words, return_inverse=True)
        n_ends = len(lengths)
        stops = np.cumsum(lengths + 1) - 1
        text = np.empty(len(words) + n_ends, np.int64)
        inside = np.ones(len(text), bool)
        inside[stops] = False
        text[stops] = np.arange(n_ends)
        text[inside] = numbers + n_ends
        order, prefix_class = _suffix_order(text, n_ends, length - 1)
        if length == 1:  # nothing is left of a match without its last word: all rows
            prefix_class = np.zeros(len(text), np.int64)
        owner = np.repeat(owners, lengths + 1)[order]
        symbols = np.maximum(text - n_ends + 1, 0)  # all ends are symbol 0
        self.tree = WaveletTree(symbols[order - 1], len(self.names) + 1)
        counts = np.bincount(symbols, minlength=len(self.names) + 1)
        self.below = np.cumsum(counts) - counts
        self.n = len(text)
        # The rows of one class by length - 1 words: where a full stretch goes back to when its last word is dropped.
        starts = np.flatnonzero(np.append(True, prefix_class[1:] != prefix_class[:-1]))
        self.class_start = starts[prefix_class].astype(np.int32)
        self.class_stop = np.append(starts[1:], self.n)[prefix_class].astype(np.int32)
        self._owner = owner

    def _least(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The smallest owner in rows first[k] to stop[k], the intervals being equal or apart."""
        if not len(first):
            return self._owner[:0]
        order = np.argsort(first, kind="stable")
        a, b = first[order], stop[order]
        new = np.append(True, a[1:] != a[:-1])
        starts, stops = a[new], b[new]
        edges = np.column_stack([starts, stops]).ravel()
        padded = np.append(self._owner, self._owner[-1:])  # an interval may stop at the end
        found = np.minimum.reduceat(padded, edges)[::2]
        out = np.empty(len(first), self._owner.dtype)
        out[order] = found[np.cumsum(new) - 1]
        return out

    def stretches(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, least owner) of every stretch of `length` streamed words that the index holds.

        Matching statistics cut at `length`: each sequence is read from its end; a word is put before the match by a
        backward step; a match of `length` words is reported and loses its last word. Where a step fails, no stretch
        from here on can reach the last word of the match, so matching starts again one word before it.
        """
        length = self.length
        numbers = np.searchsorted(self.names, words)
        known = np.zeros(len(words), bool)
        if len(self.names):
            known = self.names[np.minimum(numbers, len(self.names) - 1)] == words
        symbols = np.where(known, numbers + 1, 0)
        begin = np.cumsum(lengths) - lengths
        lanes = np.flatnonzero(lengths >= length)
        begin, at = begin[lanes], (begin + lengths)[lanes] - 1
        first, stop, held = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n), np.zeros(len(lanes), np.int64)
        places, firsts, stops = [], [], []
        while len(at):
            symbol = symbols[at]
            moved = self.below[symbol] + self.tree.rank(symbol, first)
            ends = self.below[symbol] + self.tree.rank(symbol, stop)
            good = (moved < ends) & (symbol > 0)
            full = good & (held + 1 == length)
            if full.any():
                places.append(at[full])
                firsts.append(moved[full])
                stops.append(ends[full])
            # A full match is widened to all rows that share its words but the last.
            row = np.where(full, moved, 0)
            last = np.where(full, ends - 1, 0)
            new_first = np.where(full, self.class_start[row], moved)
            new_stop = np.where(full, self.class_stop[last], ends)
            again = ~good & (held > 0) & (symbol > 0)
            next_at = np.where(again, at + held - 1, at - 1)
            first, stop = np.where(good, new_first, 0), np.where(good, new_stop, self.n)
            held = np.where(good, np.where(full, held, held + 1), 0)
            at = next_at
            live = at - begin + 1 + held >= length  # words left and words held can still make a stretch
            live &= at >= begin
            if not live.all():
                begin, at, first, stop, held = (x[live] for x in (begin, at, first, stop, held))
        if not places:
            return np.zeros(0, np.int64), self._owner[:0]
        place, first, stop = np.concatenate(places), np.concatenate(firsts), np.concatenate(stops)
        return place, self._least(first, stop)
