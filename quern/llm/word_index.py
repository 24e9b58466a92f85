"""FM-index of a shard of texts over their words.

A shard's texts follow one another, each ended by the symbol 0; a word's symbol
is its place in the shard's vocabulary, from 1. Suffixes are sorted by packed
symbols and then by doubling only those that are still equal. The last column of
the sorted suffixes is held as a wavelet matrix: a bit vector a level, from the
highest bit of the symbols, with counts of ones before each 64 of them. A suffix
whose text position is a multiple of SAMPLED, or which starts a text, has its
position stored; others are found by steps back to one of these.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A suffix position in so many is stored.
SAMPLED = 8
#: A-Z lower-cased; 1 where a byte is part of a word: digits, letters and all beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts that stand one after another in buf, and how many each text has."""
    low = LOWER[buf]
    solid = WORD_BYTE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[offsets < len(buf)]
    first[cuts] = solid[cuts]
    begins, places = np.flatnonzero(first), np.flatnonzero(solid)
    borders = np.append(np.searchsorted(places, begins), len(places)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(borders), pa.py_buffer(low[places])])
    return words, np.diff(np.searchsorted(begins, offsets))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols in their order, a shorter one first where it is a prefix."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    per = 62 // bits
    padded = np.append(symbols.astype(np.uint64), np.zeros(per, np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(per):
        key = key << np.uint64(bits) | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    places, step = np.arange(n), per
    while True:
        # a group is ranked by its first place; groups of one are done
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(key)))
        rank[order[places]] = np.repeat(places[first], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        if not len(places):
            return order
        own = order[places]
        later = own + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)], n - 1 - later)
        key = rank[own] << 32 | second + step + 1
        by = np.argsort(key)
        order[places], key = own[by], key[by]
        step *= 2


class Bits(NamedTuple):
    """A bit vector with counts of ones before each word of 64."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        packed = np.packbits(flags, bitorder="little")
        return cls.packed(np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64))

    @classmethod
    def packed(cls, words: np.ndarray) -> Bits:
        return cls(words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet(NamedTuple):
    """Symbols as a bit vector for each of their bits, the highest first; each level orders them by the bits before it."""

    levels: list[Bits]
    zeros: list[int]

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> Wavelet:
        levels, zeros = [], []
        for bit in reversed(range(depth)):
            flags = (symbols >> bit & 1).astype(bool)
            levels.append(Bits.of(flags))
            low = symbols[~flags]
            zeros.append(len(low))
            symbols = np.append(low, symbols[flags])
        return cls(levels, zeros)

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the part of the last level that lies before `at` ends, among those with the given symbols."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(at)
            at = np.where(symbols >> (len(self.levels) - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that stand at some places, and where they are in the last level."""
        symbols = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.has(at), level.ones(at)
            symbols = symbols << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at


class WordIndex(NamedTuple):
    vocabulary: pa.Array
    last: Wavelet
    #: How many symbols are smaller than each symbol, and where each one's run starts in the last level.
    smaller: np.ndarray
    runs: np.ndarray
    marks: Bits
    samples: np.ndarray
    length: int

    @classmethod
    def of(cls, words: pa.Array, sizes: np.ndarray) -> WordIndex:
        """Of texts with `sizes` words each; none is empty."""
        coded = words.dictionary_encode()
        symbols = np.zeros(len(words) + len(sizes), np.int64)
        starts = np.append(0, np.cumsum(sizes + 1)[:-1]) if len(sizes) else np.zeros(0, np.int64)
        symbols[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy().astype(np.int64) + 1
        order = suffix_order(symbols)
        sampled = np.arange(len(symbols)) % SAMPLED == 0
        sampled[starts] = True
        marked = sampled[order]
        depth = len(coded.dictionary).bit_length()
        counts = np.bincount(symbols, minlength=len(coded.dictionary) + 1)
        return cls.ready(coded.dictionary, Wavelet.of(symbols[order - 1], depth), counts, Bits.of(marked), order[marked], len(symbols))

    @classmethod
    def ready(cls, vocabulary: pa.Array, last: Wavelet, counts: np.ndarray, marks: Bits, samples: np.ndarray, length: int) -> WordIndex:
        every = np.arange(len(counts))
        return cls(vocabulary, last, np.append(0, np.cumsum(counts)[:-1]), last.follow(every, np.zeros(len(every), np.int64)), marks, samples, length)

    def columns(self) -> tuple[bytes, bytes, bytes, bytes, bytes, bytes, int]:
        """vocabulary, word ends, counts, levels, marks, samples and length; `from_columns` reads them."""
        ends = np.append(0, np.cumsum(pc.binary_length(self.vocabulary).to_numpy())).astype(np.int64)
        counts = np.diff(np.append(self.smaller, self.length)).astype(np.uint32)
        levels = b"".join(x.words.tobytes() for x in self.last.levels)
        data = b"".join(self.vocabulary.to_pylist())
        return data, ends.tobytes(), counts.tobytes(), levels, self.marks.words.tobytes(), self.samples.astype(np.uint32).tobytes(), self.length

    @classmethod
    def from_columns(cls, data: bytes, ends: bytes, counts: bytes, levels: bytes, marks: bytes, samples: bytes, length: int) -> WordIndex:
        vocabulary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) // 8 - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        each = len(marks) // 8
        words = np.frombuffer(levels, np.uint64).reshape(-1, each)
        vectors = [Bits.packed(x) for x in words]
        zeros = [length - int(np.bitwise_count(x).sum()) for x in words]
        return cls.ready(vocabulary, Wavelet(vectors, zeros), np.frombuffer(counts, np.uint32).astype(np.int64), Bits.packed(np.frombuffer(marks, np.uint64)), np.frombuffer(samples, np.uint32).astype(np.int64), length)

    def symbols_of(self, words: pa.Array) -> np.ndarray:
        """0 for a word that the shard doesn't have, which no phrase's search outlives."""
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first, end) of the suffixes that begin with each phrase that occurs; phrases are rows of symbols, the first `sizes` of a row."""
        alive = np.flatnonzero(sizes > 0)
        low, high, done = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length, np.int64), np.zeros(len(phrases), bool)
        back = 0
        while len(alive):
            symbol = phrases[alive, sizes[alive] - 1 - back]
            run = self.smaller[symbol] - self.runs[symbol]
            low[alive] = run + self.last.follow(symbol, low[alive])
            high[alive] = run + self.last.follow(symbol, high[alive])
            back += 1
            found = (symbol > 0) & (low[alive] < high[alive])
            done[alive[found & (sizes[alive] == back)]] = True
            alive = alive[found & (sizes[alive] > back)]
        which = np.flatnonzero(done)
        return which, low[which], high[which]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of sorted suffixes."""
        out, walking, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(walking):
            there = self.marks.has(at)
            out[walking[there]] = self.samples[self.marks.ones(at[there])] + steps
            walking = walking[~there]
            symbols, place = self.last.read(at[~there])
            at, steps = self.smaller[symbols] + place - self.runs[symbols], steps + 1
        return out
