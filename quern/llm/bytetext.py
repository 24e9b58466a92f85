"""Vectorised byte-level text primitives shared by the operators.

Arrow string columns are handled as one byte buffer with offsets, so words are
found, lower-cased and hashed by whole-array numpy steps rather than per row.
Range hashes are two polynomials modulo the prime 2**31 - 1, each with a random
base, mixed to 64 bits: two different ranges of n bytes agree
with a probability of about (n / 2**31)**2 over the bases, whatever they hold
(modulo a power of two there are texts that agree for every base), and random
ones with 2**-62. No caller needs it to be zero except where it says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.Generator(np.random.PCG64(20261127))
PRIME = np.uint64(2**31 - 1)
BASES = [int(x) for x in _RNG.integers(2**20, 2**31 - 2, 2)]
#: Powers of each base and of its inverse.
_POWERS = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]


def folded(x: np.ndarray) -> np.ndarray:
    """x, a fresh array, in place to less than PRIME + 12 with the same remainder."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= PRIME
        x += high
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x, a fresh array, in place modulo PRIME, without a division."""
    x = folded(x)
    return np.subtract(x, PRIME, out=x, where=x >= PRIME)


def powers(k: int, n: int) -> np.ndarray:
    """BASES[k]**i and BASES[k]**-i for i in 0..n."""
    if _POWERS[k].shape[1] <= n:
        known, size = _POWERS[k], max(n + 1, 1 << 19)
        while known.shape[1] < size:
            step = known.shape[1]
            ahead = np.array([[pow(BASES[k], step, int(PRIME))], [pow(BASES[k], -step, int(PRIME))]], np.uint64)
            known = np.concatenate([known, reduced(known * ahead)], axis=1)
        _POWERS[k] = known
    return _POWERS[k]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def running_sums(codes: np.ndarray) -> np.ndarray:
    """For each base running sums s with s[j] - s[i] = sum of codes[x] * base**x for i <= x < j, up to multiples of PRIME; the bases take different bits of a code of 64 bits."""
    out = np.zeros((2, len(codes) + 1), np.uint64)
    for k, part in enumerate((codes & PRIME, codes >> np.uint64(33))):
        part *= powers(k, len(codes))[0, : len(codes)]
        np.cumsum(folded(part), out=out[k, 1:])
        folded(out[k])
    return out


#: Bytes whose sums of powers fit into 64 bits without a fold.
_FOLD_FREE = 1 << 24


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums over bytes, each counted from 1."""
    if len(buf) > _FOLD_FREE:
        return running_sums((buf.astype(np.uint64) + np.uint64(1)) * np.uint64(1 + (1 << 33)))
    out, codes = np.zeros((2, len(buf) + 1), np.uint64), buf.astype(np.uint64)
    codes += np.uint64(1)
    for k in range(2):
        np.cumsum(codes * powers(k, len(buf))[0, : len(buf)], out=out[k, 1:])
        folded(out[k])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of what was summed, independent of where it stands."""
    parts = []
    for k in range(2):
        d = sums[k][end]
        d += np.uint64(2) * PRIME
        d -= sums[k][start]
        d *= powers(k, sums.shape[1])[1][start]
        parts.append(reduced(d))
    first, second = parts
    first <<= np.uint64(33)
    first += second
    first += (end - start).astype(np.uint64)
    return mix(first)


def string_slices(column: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of runs of rows of about most_bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before &= ~cut[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return np.frombuffer(buf.tobytes().translate(LOWER), np.uint8)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_sums(buf), starts, ends)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, ignoring row borders; entry i stands for words i..i+size-1."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count]
    for k in range(1, size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count] + np.uint64(k))
    return out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its `size`-word shingles over lower-cased words.

    A row with fewer words has one shingle, its whole sequence; without words it has none.
    """
    buf = lowered(buf)
    starts, ends, first = find_words(buf, offsets)
    words = word_hashes(buf, starts, ends)
    runs = run_hashes(words, size)
    for row in range(len(offsets) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield run_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
